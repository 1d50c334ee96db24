"""The staged build of a catalogue: restart, log, and what each stage does."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import building as B

DAY = dt.date(2001, 1, 1)


def catalogue(spark, rows):
    full = [(i, t, u, f, p, n, DAY, DAY, False) for i, t, u, f, p, n in rows]
    return spark.createDataFrame(full, "series_id string, title string, unit string, freq string, priority int, n_obs long, first date, last date, protected boolean")


def test_a_broken_build_goes_on_after_its_last_whole_stage(spark, tmp_path):
    cat = catalogue(spark, [("a", "x", None, "monthly", 0, 9), ("b", "y", None, "monthly", 1, 9), ("c", "z", None, "monthly", 1, 2)])
    ran = []

    def stage(name, gone, broken=False):
        def run(c):
            ran.append(name)
            c = c.withColumn("reason", F.when(F.col("series_id") == gone, F.lit(f"went in {name}")))
            return c.withColumn("title", F.raise_error(F.lit("lost"))) if broken else c

        return name, run

    with pytest.raises(Exception, match="lost"):
        B.run_stages(cat, [stage("one", "b"), stage("two", "c", broken=True)], f"file://{tmp_path}/build")
    left, log = B.run_stages(cat, [stage("one", "b"), stage("two", "c"), stage("three", "none")], f"file://{tmp_path}/build")
    assert ran == ["one", "two", "two", "three"]
    assert [r.series_id for r in left.collect()] == ["a"] and "reason" not in left.columns
    assert {tuple(r) for r in log.collect()} == {("b", "y", "one", "went in one"), ("c", "z", "two", "went in two")}


def test_stages_of_the_catalogue(spark):
    rows = [
        ("n", "012_native", None, "monthly", 0, 1), ("few", "t", None, "monthly", 1, 2), ("code", "044_item", None, "monthly", 1, 9), ("p", "GDP,current US$,millions,seas. adj.,", None, "monthly", 1, 9), ("u", "031. Share (% of GDP)", "odd", "monthly", 1, 9),
        ("wb/A.BRA", "t", None, "annual", 1, 9), ("wb/A_M.BRA", "t", None, "monthly", 1, 9), ("ilostat/EAR_X_NB.A", "t", None, "annual", 1, 5), ("ilostat/EAR_X_SEX_NB.A", "t", None, "annual", 1, 9), ("ilostat/EAR_Y_SEX_NB.A", "t", None, "annual", 1, 9),
    ]
    cat = catalogue(spark, rows)
    gone = lambda df: {r.series_id: r.reason for r in df.where("reason is not null").collect()}
    assert gone(B.curated(cat, 3, r"^\d{2,3}_")) == {"few": "fewer than 3 observations", "code": "questionnaire item or by-product"}
    clean = {r.series_id: (r.title, r.unit) for r in B.cleaned(cat).collect()}
    assert clean["p"] == ("GDP (seas. adj.)", "current US$, millions") and clean["u"] == ("Share (% of GDP)", "% of GDP") and clean["n"] == ("012_native", None)
    assert gone(B.without_annual_copies(cat, F.col("series_id").like(r"%\_M.BRA"), F.replace("series_id", F.lit("_M.BRA"), F.lit(".BRA")))) == {"wb/A.BRA": "annual copy of a monthly series"}
    families = B.merged_families(cat, "ilostat/")
    assert gone(families) == {"ilostat/EAR_X_SEX_NB.A": "merged into ilostat/EAR_X_NB.A"}
    assert {r.series_id for r in families.where("protected").collect()} == {"ilostat/EAR_X_NB.A", "ilostat/EAR_X_SEX_NB.A"} and families.count() == len(rows)
    pairs = spark.createDataFrame([("few", "n", "monthly", "removed"), ("code", "p", "monthly", "words")], "dup string, keep string, basis string, outcome string")
    twins = B.without_twins(cat, pairs)
    assert gone(twins) == {"few": "duplicate of n (monthly)"} and {r.series_id for r in twins.where("role = 'canonical'").collect()} == {"n"}
    assert {r.agg for r in B.with_rule(cat).collect()} == {"mean"}
