"""Pairs with a least overlap, and the rules by which copies go."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import overlap as O
from tidemark.operators import twins as W


def made(spark, n, seed, dates=40):
    rng = random.Random(seed)
    rows = [(b, f"{seed}-{i:03d}", d, rng.random()) for i in range(n) for b in ("x", "y") for d in rng.sample(range(dates), rng.randint(1, 12))]
    # a date that nearly all have, and a series that has nearly all dates
    rows += [("x", f"{seed}-{i:03d}", 99, rng.random()) for i in range(n)] + [("x", f"{seed}-long", d, 0.5) for d in range(dates)]
    return rows, spark.createDataFrame(rows, "block string, series_id string, t int, value double")


def shared(left, right, least):
    of = lambda rows: {(b, s): {t for b2, s2, t, _ in rows if (b2, s2) == (b, s)} for b, s, _, _ in rows}
    x, y = of(left), of(right)
    return {(b, a, c, len(x[b, a] & y[b2, c])) for b, a in x for b2, c in y if b == b2 and (left is not right or a < c) and len(x[b, a] & y[b2, c]) >= least}


@pytest.mark.parametrize(("least", "part_rows"), [(1, 500), (3, 500), (4, 3), (7, 500)])
def test_overlapping_equals_brute_force(spark, least, part_rows):
    rows, df = made(spark, 40, 1)
    other, df2 = made(spark, 25, 2)
    own = {tuple(r) for r in O.overlapping(df, None, ["block"], "series_id", "t", least, part_rows).collect()}
    assert own == shared(rows, rows, least)
    assert {tuple(r) for r in O.overlapping(df, df2, ["block"], "series_id", "t", least, part_rows).collect()} == shared(rows, other, least)


def test_candidates_leave_out_pairs_that_cannot_reach_the_overlap(spark):
    # 200 series share one frequent date and little else; a group of five shares eight rare ones
    rows = [("x", f"s{i}", t, 1.0) for i in range(200) for t in (0, 1000 + 8 * i, 1001 + 8 * i, 1002 + 8 * i, 1003 + 8 * i)]
    rows += [("x", f"g{i}", t, 1.0) for i in range(5) for t in range(1, 9)]
    df = spark.createDataFrame(rows, "block string, series_id string, t int, value double")
    found = O.candidates(df, None, ["block"], "series_id", "t", 4).collect()
    assert len(found) == 10  # of 20910 pairs of the block


def test_overlapping_of_repeated_and_missing_dates(spark):
    rows = [("x", "a", 1, 1.0), ("x", "a", 1, 2.0), ("x", "a", None, 1.0), ("x", "b", 1, 1.0), ("x", "b", None, 1.0), (None, "c", 1, 1.0)]
    df = spark.createDataFrame(rows, "block string, series_id string, t int, value double")
    assert [tuple(r) for r in O.overlapping(df, None, ["block"], "series_id", "t", 1).collect()] == [("x", "a", "b", 1)]
    assert O.overlapping(df.limit(0), None, ["block"], "series_id", "t", 1).count() == 0


def test_comoving_counts_known_values_alone(spark):
    rows = [("x", s, t, None if t == 3 and s == "a" else float(v)) for s, vs in (("a", [1, 2, 3, 4, 5]), ("b", [5, 4, 9, 9, 1]), ("c", [2, 2, 2, 2, 2])) for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "block string, series_id string, t int, value double")
    got = {(r.a, r.b): (r.n, round(r.corr, 3)) for r in O.comoving(df, ["block"], "series_id", "t", "value", 2, 0.1).collect()}
    assert got == {("a", "b"): (4, -0.428)}  # c is flat; -7.25 over the root of 8.75 * 32.75


def test_rules_by_which_copies_stay(spark):
    cat = spark.createDataFrame(
        [
            ("n", "unemployment rate", "pct", 0, 9.0, False), ("a", "unemployment", "pct", 1, 5.0, False), ("b", "unemployment rate", "pct", 1, 4.0, False), ("c", "other words", "pct", 1, 4.0, False),
            ("d", "unemployment rate female", "pct", 1, 4.0, False), ("e", "unemployment rate", "persons", 1, 4.0, False), ("p", "unemployment rate", "pct", 2, 1.0, True), ("q", "unemployment rate", "pct", 2, 1.0, False),
        ],
        "series_id string, title string, unit string, priority int, rank double, protected boolean",
    )
    pairs = [("a", "n", 0.99, 1.0), ("b", "n", 0.98, 1.0), ("b", "a", 0.999, 1.0), ("a", "b", 0.999, 1.0), ("c", "n", 0.99, 1.0), ("d", "n", 0.99, 1.0), ("e", "n", 0.99, 1000.0), ("p", "b", 0.99, 1.0), ("q", "b", 0.99, 1.0)]
    df = spark.createDataFrame([(d, k, "monthly mean", 30, c, r) for d, k, c, r in pairs], "dup string, keep string, basis string, n long, corr double, ratio double")
    got = {(r.dup, r.keep): r.outcome for r in W.judged(df, cat, ["female"], ["rate"], "same title").collect()}
    # b and q share one word with each other once "rate" is a stop word: too few for a kept series that is not native
    assert got == {("a", "n"): "removed", ("b", "n"): "removed", ("b", "a"): "words", ("a", "b"): "words", ("c", "n"): "words", ("d", "n"): "qualifier", ("e", "n"): "rate", ("p", "b"): "words", ("q", "b"): "words"}
    got = {(r.dup, r.keep): r.outcome for r in W.judged(df, cat, ["female"], [], "same title").collect()}
    assert got["b", "n"] == "kept" and got["p", "b"] == "protected" and got["q", "b"] == "removed" and got["a", "b"] == "words" and got["a", "n"] == "removed"


def test_candidates_want_level_scale_and_changes(spark):
    base = [float((i * 37) % 11 + i) for i in range(30)]
    rows = [("t", "n", i, v) for i, v in enumerate(base)] + [("t", "k", i, v * 1000) for i, v in enumerate(base)] + [("t", "flat", i, float(i)) for i in range(30)] + [("t", "off", i, v * 3) for i, v in enumerate(base)]
    df = W.with_changes(spark.createDataFrame(rows, "topic string, series_id string, t int, value double"), "series_id", "t", "value", F.col("t") - 1)
    native, copies = df.where("series_id = 'n'"), df.where("series_id <> 'n'")
    got = [(r.dup, r.keep, r.n, r.ratio) for r in W.twin_candidates(native, copies, ["topic"], "t", 24, 0.9, 0.02, True, "monthly").collect()]
    assert got == [("k", "n", 30, 1000.0)]
    assert W.twin_candidates(native, copies, ["topic"], "t", 24, 0.9, 0.02, False, "monthly").count() == 0


def test_neighbours_refill_level_by_level(spark):
    from tidemark.operators import relating as E

    rows = [("a", "d1", "t", 5.0), ("b", "d1", "t", 4.0), ("c", "d1", "t", 3.0), ("lone", "d2", "t", 1.0), ("hub", "d3", "u", 9.0), ("only", "d4", "v", 1.0)]
    cat = spark.createDataFrame(rows, "id string, dataset string, topic string, rank double")
    edges = spark.createDataFrame([("a", x, "text", 0.5) for x in ("b", "c", "hub")] + [("hub", "a", "text", 0.5)], "a string, b string, reason string, strength double")
    levels = [{"group": ["dataset", "topic"], "few": 3, "best": 6, "top": 4, "strength": 0.8}, {"group": ["topic"], "few": 1, "best": 2, "top": 4, "strength": 0.6}]
    got = {(r.a, r.b, r.strength) for r in E.refilled(edges, cat, "id", "rank", levels).where("reason = 'neighbor'").collect()}
    # a has enough, b and c are filled from their dataset, lone has none there and gets the leaders of the topic, hub has an edge, only has nobody
    assert got == {("b", "a", 0.8), ("b", "c", 0.8), ("c", "a", 0.8), ("c", "b", 0.8), ("lone", "a", 0.6), ("lone", "b", 0.6)}


def test_points_of_a_pair_are_its_common_dates(spark):
    left = spark.createDataFrame([("x", "a", 1, 1.0), ("x", "a", 2, None), ("x", "a", 4, 4.0), ("x", "a", 4, 4.5), ("x", "a", None, 9.0)], "block string, series_id string, t int, v double")
    right = spark.createDataFrame([("x", "b", 1, 10.0), ("x", "b", 2, 20.0), ("x", "b", 3, 30.0), ("x", "b", 4, 40.0), ("x", "b", None, 9.0)], left.schema)
    pairs = spark.createDataFrame([("x", "a", "b"), ("x", "a", "none")], "block string, a string, b string")
    got = sorted((r.a, r.b, r.t, r.v_a, r.v_b) for r in O.points(pairs, left, right, ["block"], "series_id", "t", ["v"]).collect())
    assert got == [("a", "b", 1, 1.0, 10.0), ("a", "b", 2, None, 20.0), ("a", "b", 4, 4.5, 40.0)]


@pytest.mark.parametrize("part_rows", [None, 4])
def test_meeting_in_groups_equals_sums_over_points(spark, part_rows):
    rng = random.Random(5)
    made_of = lambda name, n: [("x", f"{name}{i:02d}", t, None if rng.random() < 0.1 else float(t) + rng.random() * 9, None if rng.random() < 0.2 else rng.random()) for i in range(n) for t in rng.sample(range(30), 20)]
    left = spark.createDataFrame(made_of("a", 13) + [("x", "flat", t, 0.1, 1.0) for t in range(30)] + [(None, "z", 1, 1.0, 1.0)], "block string, series_id string, t int, v double, c double")
    right = spark.createDataFrame(made_of("b", 9), left.schema)
    pairs = left.select("block", F.col("series_id").alias("a")).distinct().join(right.select("block", F.col("series_id").alias("b")).distinct(), "block")
    from tidemark.functions.scalars import correlation

    ratio = F.median(F.when(F.col("v_a") != 0, F.col("v_b") / F.col("v_a")))
    each = O.points(pairs, left, right, ["block"], "series_id", "t", ["v", "c"]).groupBy("block", "a", "b").agg(F.count("*").alias("n"), correlation("v_a", "v_b").alias("corr"), correlation("c_a", "c_b").alias("changes"), ratio.alias("ratio"))
    want = {(r.a, r.b): r for r in each.where("n >= 12 and corr >= 0.8 and changes >= -0.1").collect()}
    got = {(r.a, r.b): r for r in O.met(left, right, ["block"], "series_id", "t", 12, ["v", "c"], 0.8, changes=-0.1, part_rows=part_rows).where("corr >= 0.8 and changes >= -0.1").collect()}
    assert len(want) > 10 and got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].n == r.n and got[k][4:] == pytest.approx((r.corr, r.changes, r.ratio))


def test_lists_meet_like_their_points_and_lists_stay_in_place(spark):
    left, right = (made(spark, n, seed)[1].withColumn("c", F.col("value") * 2) for n, seed in ((30, 3), (20, 4)))
    listed = lambda df: O.listed(df, ["series_id", "block"], "t", ["value", "c"])
    run = lambda x, y: O.met(x, y, ["block"], "series_id", "t", 3, ["value", "c"], 0.2, changes=0.2, part_rows=7)
    rows = lambda df: sorted((r.a, r.b, r.block, r.n, round(r.corr, 9), round(r.ratio, 9)) for r in df.collect())
    want = rows(run(left, right))
    out = run(listed(left), listed(right))
    assert len(want) > 10 and rows(out) == want
    # no side of a join is sorted: lists are neither shuffled nor sorted to learn how many groups their block has
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_pairs_leave_the_task_tile_by_tile(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(O, "PAIRS", 1)
    monkeypatch.setattr(O, "TILE_ROWS", 16)
    table = pa.table({"_id": [f"s{i:02d}" for i in range(40)], "_t": [[1, 2, 3]] * 40, "_side": [0] * 40})
    parts = [list(zip(a.to_pylist(), b.to_pylist(), strict=True)) for a, b, _ in O._pairs(("x", 0, 0), table, True, 2, 0, -1.0, False, -1.0)]
    assert len(parts) == 3 and len({p for part in parts for p in part}) == sum(map(len, parts)) == 780


def test_judging_makes_each_pair_once(spark):
    made_pairs = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([("a", "n", "monthly", 30, 0.99, 1.0), ("b", "n", "monthly", 30, 0.98, 1.0), ("b", "a", "monthly", 30, 0.97, 1.0)], "dup string, keep string, basis string, n long, corr double, ratio double")

    def seen(batches):
        for batch in batches:
            made_pairs.add(batch.num_rows)
            yield batch

    cat = spark.createDataFrame([(i, "some title", "usd", p, 1.0, False) for p, i in enumerate("nab")], "series_id string, title string, unit string, priority int, rank double, protected boolean")
    got = {(r.dup, r.keep): r.outcome for r in W.judged(df.mapInArrow(seen, df.schema), cat, [], [], "same").collect()}
    assert got == {("a", "n"): "removed", ("b", "n"): "removed", ("b", "a"): "second"} and made_pairs.value == 3


def test_edges_are_dealt_out_by_their_number(spark, monkeypatch):
    from tidemark.operators import relating as E

    monkeypatch.setattr(E, "ROWS", 10)
    cat = spark.range(60).select("id", F.lit("d").alias("ds"), F.lit(1.0).alias("rank"), F.lit(False).alias("stale"))
    edges = spark.range(60).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("s")).selectExpr("a", "(a + s) % 60 AS b", "'text' AS reason", "0.5D AS strength")
    out = E.related(edges, cat, "id", "rank", "ds", "stale", {"text": 1.0}, {"text": 3}, 5, 10)
    assert out.count() == 180
    assert out.rdd.getNumPartitions() == 24  # of few bytes, left to themselves a single one
    near = E.neighbor_edges(cat, edges.limit(0), "id", ["ds"], "rank")
    assert near.count() == 240 and near.rdd.getNumPartitions() == 36
