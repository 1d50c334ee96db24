"""Two-way effects against a regression on dummies, projections against copied rows, placebo means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import projections as J
from tidemark.operators import sampling as S
from tidemark.operators import twoway as W
from tidemark.operators.regression import ols


def panel(seed, units=14, times=9):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        for t in range(times):
            if rng.random() < 0.6 or t == u % times:  # most units lack some times
                g, r = ("g" if u % 3 == 0 else "h" if u % 3 == 1 else None), ("r" if t > 5 else "q" if t > 2 else None)
                rows.append((f"u{u}", t, float(rng.normal() + u + t * t), g, r, float(1 + u % 4), float(rng.normal())))
    return rows


SCHEMA = "u string, t int, y double, g string, r string, w double, x double"


@pytest.mark.parametrize("weighted", [False, True])
def test_two_way_effects_equal_a_regression_on_dummies(spark, weighted):
    rows = panel(3)
    df, names = W.dummies(spark.createDataFrame([*rows, ("u1", None, 1.0, "g", "r", 1.0, 1.0), ("u1", 2, 5.0, "g", "r", 0.0, 1.0)], SCHEMA), "g", "r", ["g", "h"], ["q", "r"])
    got = {r.term: (r.beta, r.n) for r in W.two_way(df if weighted else df.where("w > 0"), "u", "t", "y", [*names, "x"], "w" if weighted else None).collect()}
    us, ts = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    design = np.array([[*[float(r[0] == u) for u in us], *[float(r[1] == t) for t in ts[1:]], *[float((r[3], r[4]) == tuple(n.split(":"))) for n in names], r[6]] for r in rows])
    root = np.sqrt([r[5] if weighted else 1.0 for r in rows])
    want, *_ = np.linalg.lstsq(design * root[:, None], np.array([r[2] for r in rows]) * root, rcond=None)
    assert names == ["g:q", "g:r", "h:q", "h:r"] and {n for _, n in got.values()} == {len(rows)}
    assert [got[n][0] for n in [*names, "x"]] == pytest.approx(want[-5:].tolist(), abs=1e-7)


def test_two_way_effects_without_variation(spark):
    df = spark.createDataFrame(panel(4), SCHEMA).withColumns({"twice": 2 * F.col("x"), "flat": F.lit(1.0), "by_unit": F.col("w")})
    got = {r.term: r.beta for r in W.two_way(df, "u", "t", "y", ["x", "twice", "flat", "by_unit"]).collect()}
    assert got["x"] is not None and got["twice"] is None and got["flat"] is None and got["by_unit"] is None
    assert [tuple(r) for r in W.two_way(df.limit(0), "u", "t", "y", ["x"]).collect()] == [("x", None, 0)]


def test_projections_equal_samples_of_copied_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, t, float(v), float(c)) for k, n in (("a", 50), ("b", 37)) for t, v, c in zip(range(n), np.cumsum(rng.normal(size=n)), rng.normal(size=n), strict=True)]
    df = spark.createDataFrame(rows, "k string, t int, v double, c double").withColumn("s", (F.col("t") % 7).cast("double"))
    got = {(r.k, r.h): r for r in J.local_projections(df, "k", "t", "v", "s", ["c"], 3, 20, 8).collect()}
    ahead = J.horizons(df, "k", "t", "v", 3)
    copied = S.block_bootstrap(ahead, ["k", "h"], ["t"], 20, 8)
    beta = ols(copied, ["k", "h", "rep"], "response", ["s", "c"]).select("k", "h", F.get("beta", F.lit(0)).alias("b"))
    want = {(r.k, r.h): r for r in beta.groupBy("k", "h").agg(F.percentile("b", F.lit(0.05)).alias("low"), F.percentile("b", F.lit(0.95)).alias("high"), F.avg((F.col("b") <= 0).cast("int")).alias("below")).collect()}
    assert set(got) == set(want) and len(got) == 8
    for key, r in got.items():
        assert r.n == (50 if key[0] == "a" else 37) - 1 - key[1]
        assert [r.low, r.high] == pytest.approx([want[key].low, want[key].high], abs=1e-9)
        assert r.p == pytest.approx(min(1, 2 * min(want[key].below, 1 - want[key].below)))


def test_projections_of_short_series_are_null(spark):
    df = spark.createDataFrame([("a", t, float(t * t % 5), float(t % 3)) for t in range(12)], "k string, t int, v double, s double")
    got = J.local_projections(df, "k", "t", "v", "s", [], 2, 5, 4).collect()
    assert [(r.h, r.n, r.beta, r.low) for r in sorted(got)] == [(0, 11, None, None), (1, 10, None, None), (2, 9, None, None)]


def test_placebo_means_draw_one_row_an_event(spark):
    free = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", 0, 100.0)], "k string, pos int, effect double")
    events = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "g"), ("a", "only")], "k string, grp string")
    got = S.placebo_means(free, events, "k", "grp", 50).collect()
    of = lambda g: [r["mean"] for r in got if r.grp == g]
    assert len(of("g")) == 50 and {m for m in of("g")} <= {(100 + i) / 2 for i in range(5)} and len({*of("only")}) == 5
