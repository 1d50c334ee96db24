import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import joins as J
from tidemark.operators import timeseries as T
from tidemark.operators.rollups import year_to_date


def series(spark, rows):
    return spark.createDataFrame([("a", dt.date.fromisoformat(d), v) for d, v in rows], "series_id string, date date, value double")


def test_densify_and_fill(spark):
    df = T.densify(series(spark, [("2000-01-01", 1.0), ("2000-04-01", 4.0)]))
    got = [(r.date.month, r.value, r.filled) for r in T.interpolate_inside(df).orderBy("date").collect()]
    assert [m for m, *_ in got] == [1, 2, 3, 4] and got[1][1] is None
    assert abs(got[1][2] - (1 + 3 * 31 / 91)) < 1e-9


def test_asof_sides_and_tie(spark):
    left = series(spark, [("2000-01-10", 0.0), ("2000-01-20", 0.0)]).drop("value")
    right = series(spark, [("2000-01-05", 5.0), ("2000-01-15", 15.0), ("2000-01-20", 20.0)])
    back = J.asof(left, right, "series_id").orderBy("date").collect()
    assert [r.asof_value for r in back] == [5.0, 20.0]
    strict = J.asof(left, right, "series_id", direction="forward", strict=True).orderBy("date").collect()
    assert [r.asof_value for r in strict] == [15.0, None]
    near = J.asof_nearest(left, right, "series_id").orderBy("date").collect()
    assert [r.asof_value for r in near] == [15.0, 20.0]  # a tie goes to the later one


def test_significant_and_numbers(spark):
    row = spark.createDataFrame([("1.234,56", 123456.789)], "t string, v double").select(S.br_number(T.F.col("t")).alias("n"), S.significant(T.F.col("v"), 3).alias("s"), S.br_number(T.F.lit("x")).alias("bad")).first()
    assert (row.n, row.s, row.bad) == (1234.56, 123000.0, None)


def test_entry_lists_sql_for_known_queries_only():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_year_to_date_meets_the_same_months(spark):
    rows = [("a", "1999-01-01", 10.0), ("a", "1999-02-01", 10.0), ("a", "1999-12-01", 50.0), ("a", "2000-01-01", 12.0), ("a", "2000-02-01", 18.0), ("b", "1998-01-01", 5.0), ("b", "2000-01-01", None), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double").withColumn("t", F.to_date("t"))
    got = {(r.k, r.year): (r.months, r.total, r.to_date, r.change) for r in year_to_date(df, ["k"], "t", "v").collect()}
    assert got == {("a", 1999): (3, 70.0, 20.0, None), ("a", 2000): (2, 30.0, 30.0, 50.0), ("b", 1998): (1, 5.0, 5.0, None), ("b", 2000): (1, None, None, None)}
    assert year_to_date(df.limit(0), ["k"], "t", "v").count() == 0
