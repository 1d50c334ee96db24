"""Tables survive writes that fail or are broken off."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files as B
from tidemark.sources import replacing as R


def rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("k", "p", "v").collect())


def failing(df):
    """df whose last rows cannot be worked out, so that some tasks have written when the job fails."""
    return df.withColumn("v", F.when(F.col("v") < 0, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))


@pytest.fixture
def old(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    R.replace_table(spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], "k long, p string, v double"), path, ["p"])
    return path


def test_a_failed_write_leaves_the_old_table(spark, old, tmp_path):
    before = rows(spark, old)
    broken = failing(spark.createDataFrame([(9, "a", 9.0), (8, "b", 1.0), (7, "c", -1.0)], "k long, p string, v double").repartition(3, "k"))
    for write in (lambda: R.replace_table(broken, old, ["p"]), lambda: R.upsert(broken, old, ["k"], ["p"])):
        with pytest.raises(Exception, match="broken"):
            write()
        assert rows(spark, old) == before and [f.name for f in tmp_path.iterdir()] == ["table"]


def test_a_merge_killed_while_it_writes_leaves_the_old_table(spark, old, monkeypatch):
    before = rows(spark, old)
    # the merged rows themselves fail when they are written over the partitions
    calls = []

    def broken(df):
        calls.append(df)
        return B.materialize(df) if len(calls) == 1 else failing(df.withColumn("v", F.when(F.col("k") == 3, -1.0).otherwise(F.col("v"))).repartition(2, "k"))

    monkeypatch.setattr(R, "materialize", broken)
    with pytest.raises(Exception, match="broken"):
        R.upsert(spark.createDataFrame([(1, "a", 10.0), (4, "b", 4.0)], "k long, p string, v double"), old, ["k"], ["p"])
    assert len(calls) == 2 and rows(spark, old) == before


def test_settling_a_replacement_that_was_broken_off(spark, old, tmp_path):
    before, table, aside = rows(spark, old), tmp_path / "table", tmp_path / "table.old"
    table.rename(aside)  # broken off between the two renamings
    assert R.exists(spark, old) and rows(spark, old) == before
    R.replace_table(spark.createDataFrame([(5, "c", 5.0)], "k long, p string, v double"), old)
    assert rows(spark, old) == [(5, "c", 5.0)] and not aside.exists()
    aside.mkdir()  # broken off before the old one went
    R.settle(spark, old)
    assert rows(spark, old) == [(5, "c", 5.0)] and not aside.exists()


def test_upsert_touches_its_partitions_alone(spark, old, tmp_path):
    untouched = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "table" / "p=b").iterdir()}
    new = spark.createDataFrame([(2, "a", 20.0), (4, "a", 4.0), (4, "a", 5.0), (6, "c", 6.0), (None, "c", 7.0)], "k long, p string, v double")
    assert R.upsert(new, old, ["k"], ["p"], [F.desc("v")]) == 5
    got = spark.read.parquet(old).select("k", "p", "v").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, "a", 1.0), (2, "a", 20.0), (3, "b", 3.0), (4, "a", 5.0), (6, "c", 6.0), (None, "c", 7.0)]))
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "table" / "p=b").iterdir()} == untouched


def test_refused_writes(spark, old):
    before = rows(spark, old)
    with pytest.raises(ValueError, match="nothing"):
        B.write_bronze(spark.createDataFrame([(1, "a", None), (2, "a", float("nan"))], "k long, p string, v double"), old, ["k"], ["k"], "v")
    with pytest.raises(ValueError, match="missing"):
        B.write_bronze(spark.createDataFrame([(1, 1.0)], "k long, v double"), old, ["p"], ["k"], "v")
    assert rows(spark, old) == before


def test_bronze_dates_are_normalised(spark, tmp_path):
    df = spark.createDataFrame([(1, "2001-03-05 10:00:00", 1.0), (2, "2001-3-5", 1.0), (3, "soon", 1.0)], "k long, date string, value double")
    assert B.write_bronze(df, f"file://{tmp_path}/b", ["date"], ["k"], dates=["date"]) == 3
    assert [r.date for r in spark.read.parquet(f"file://{tmp_path}/b").orderBy("k").collect()] == ["2001-03-05", "2001-03-05", None]


def test_refresh_wants_lacking_and_last_periods(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    df = spark.createDataFrame([(m, float(m)) for m in range(202401, 202407)], "ym long, v double")
    assert R.refresh(spark, df, path, "ym", 2).count() == 6
    R.replace_table(df.where("ym not in (202402, 202406)"), path)
    assert sorted(r.ym for r in R.refresh(spark, df, path, "ym", 2).collect()) == [202402, 202405, 202406]
