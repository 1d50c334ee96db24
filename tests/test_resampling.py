from datetime import date

from tidemark.operators import resampling as S


def test_line_breaks_marks_long_gaps_only(spark):
    days = [date(2000, m, 1) for m in range(1, 7)] + [date(2001, 6, 1)]
    df = spark.createDataFrame([("a", x, float(i)) for i, x in enumerate(days)] + [("b", date(2000, 1, 1), 1.0)], "series_id string, date date, value double")
    got = S.line_breaks(df).where("value is null").collect()
    assert [(r.series_id, r.date) for r in got] == [("a", date(2000, 6, 2))]
    assert S.line_breaks(df).count() == 9


def test_ytd_to_quarter_needs_the_quarter_before(spark):
    rows = [("a", 2000, 1, 10.0), ("a", 2000, 2, 15.0), ("a", 2000, 4, 40.0), ("a", 2001, 2, 7.0)]
    got = S.ytd_to_quarter(spark.createDataFrame(rows, "series_id string, year int, quarter int, ytd double")).collect()
    assert sorted((r.year, r.quarter, r.value) for r in got) == [(2000, 1, 10.0), (2000, 2, 5.0)]


def test_step_annual_mean_splits_spans_at_new_year(spark):
    rows = [("a", date(2000, 12, 22), 1.0), ("a", date(2001, 1, 11), 5.0), ("a", date(2001, 1, 21), 9.0)]
    got = {r.year: (r.mean, r.days) for r in S.step_annual_mean(spark.createDataFrame(rows, "series_id string, date date, value double")).collect()}
    assert got == {2000: (1.0, 10), 2001: (3.0, 20)}


def test_nearest_to_breaks_ties_and_keeps_the_tolerance(spark):
    rows = [("x", 24.0, 2), ("x", 26.0, 1), ("y", 40.0, 3)]
    got = S.nearest_to(spark.createDataFrame(rows, "k string, v double, id int"), ["k"], "v", 25, 3.5, ["id"]).collect()
    assert [tuple(r) for r in got] == [("x", 26.0, 1)]
