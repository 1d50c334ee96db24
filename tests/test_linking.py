from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import linking as L
from tidemark.operators import panel as P
from tidemark.operators import parsing as A
from tidemark.operators import quality as Q
from tidemark.operators import resampling as S


def test_twin_match_wants_level_scale_and_changes(spark):
    rows = [("a", "t", y, float((y * 37) % 11 + y)) for y in range(1, 9)]
    df = spark.createDataFrame(rows, "series_id string, topic string, year int, value double")
    other = spark.createDataFrame([("thousand", t, y, v * 1000) for _, t, y, v in rows] + [("flat", t, y, float(y)) for _, t, y, _ in rows], df.schema)
    got = [(r.a, r.b, r.power) for r in L.twin_match(df, other, ["topic"]).collect()]
    assert got == [("a", "thousand", 3)]


def test_capped_top_k_caps_reasons_before_it_counts(spark):
    rows = [("s", f"r{i}", "list", 1 - i / 10) for i in range(5)] + [("s", "q", "topic", 0.1)]
    got = L.capped_top_k(spark.createDataFrame(rows, "series_id string, related_id string, reason string, score double"), 2, 3).orderBy("pos").collect()
    assert [r.related_id for r in got] == ["r0", "r1", "q"]


def test_score_edges_keeps_the_heaviest_reason_both_ways(spark):
    edges = spark.createDataFrame([("a", "b", "x", 0.5), ("a", "b", "y", 0.9)], "a string, b string, reason string, weight double")
    rank = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "series_id string, rank double")
    got = {(r.series_id, r.related_id, r.reason, r.score) for r in L.score_edges(edges, rank).collect()}
    assert got == {("a", "b", "y", 0.9), ("b", "a", "y", 0.72)}


def test_fixed_width_makes_bad_numbers_null(spark):
    df = spark.createDataFrame([("01ab 12",), ("02cdx9y",)], "line string")
    got = A.fixed_width(df, "line", {"kind": (1, 2, "int"), "name": (3, 2, "string"), "n": (5, 3, "int")}).orderBy("kind").collect()
    assert [tuple(r) for r in got] == [(1, "ab", 12), (2, "cd", None)]


def test_unnest_lookup_keeps_order_rows_and_unknown_codes(spark):
    df = spark.createDataFrame([(1, "B|A"), (2, "B|A"), (3, "Z"), (4, None)], "id int, codes string")
    labels = spark.createDataFrame([("A", "one"), ("B", "two")], "code string, label string")
    assert [r.labels for r in A.unnest_lookup(df, "codes", labels).orderBy("id").collect()] == ["two, one", "two, one", "Z", None]


def test_reference_equality_counts_each_kind(spark):
    make = lambda rows: spark.createDataFrame([("a", date(2000, m, 1), v) for m, v in rows], "series_id string, date date, value double")
    got = Q.reference_equality(make([(1, 1.0), (2, 2.5), (4, 1.0)]), make([(1, 1.0), (2, 2.0), (3, 1.0)])).first()
    assert (got.equal, got.unequal, got.missing, got.extra) == (1, 1, 1, 1)


def test_carried_class_looks_only_back(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False)], "k string, t int, f boolean")
    assert [r.predicted for r in Q.carried_class(df, "k", ["t"], F.col("f")).orderBy("t").collect()] == [False, False, True]


def test_split_adjust_is_strict_at_the_split_day(spark):
    df = spark.createDataFrame([("a", date(2000, 1, d), 12.0) for d in (1, 2, 3)], "series_id string, date date, value double")
    splits = spark.createDataFrame([("a", date(2000, 1, 2), 2.0), ("a", date(2000, 1, 3), 3.0)], "series_id string, date date, ratio double")
    assert [round(r.adjusted, 9) for r in S.split_adjust(df, splits).orderBy("date").collect()] == [2.0, 4.0, 12.0]


def test_twfe_finds_the_planted_effect(spark):
    rows = [(u, t, 3.0 * u + 2.0 * t + (5.0 if u < 2 and t > 2 else 0.0), int(u < 2 and t > 2)) for u in range(4) for t in range(5)]
    got = P.twfe(spark.createDataFrame(rows, "u int, t int, y double, x int"), "u", "t", "y", "x").first()
    assert got.n == 20 and abs(got.beta - 5) < 1e-9


def test_event_windows_leave_out_what_runs_over_the_ends(spark):
    df = spark.createDataFrame([("a", date(2000, 1, d), float(d + (10 if d >= 8 else 0))) for d in range(1, 13)], "series_id string, date date, value double")
    events = spark.createDataFrame([("a", date(2000, 1, 8)), ("a", date(2000, 1, 2))], "series_id string, date date")
    got = P.event_windows(df, events, 1, 2, 3).collect()
    assert [(r.date, r.car) for r in got] == [(date(2000, 1, 8), 10.0)]


def test_flat_series_give_null_correlations(spark):
    from tidemark.operators import rollups as R
    from tidemark.operators import timeseries as T

    df = spark.createDataFrame([("a", date(2000, 1, d), 1.0, float(d)) for d in range(1, 6)], "series_id string, date date, x double, y double")
    got = R.pair_stats(df).first()
    assert (got.n, got["corr"]) == (5, None)
    assert R.regress(df).first().slope is None
    assert [r.roll_corr for r in T.rolling_pair(df, 3).collect()] == [None] * 5
