from datetime import date
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.operators import joins as J
from tidemark.operators import regression as G
from tidemark.operators import relating as E
from tidemark.operators import rollups as R
from tidemark.operators import sampling as S
from tidemark.operators import timeseries as T
from tidemark.sources import files as B


def test_ols_equals_numpy_and_leaves_singular_keys_null(spark):
    rng = np.random.default_rng(0)
    rows = [("a", *map(float, rng.normal(size=4) + 1e6)) for _ in range(50)] + [("b", 1.0, float(i), 2.0 * i, 3.0) for i in range(9)] + [("c", 1.0, 2.0, 3.0, 4.0), ("a", None, 1.0, 1.0, 1.0)]
    got = {r.k: r for r in G.ols(spark.createDataFrame(rows, "k string, y double, p double, q double, z double"), ["k"], "y", ["p", "q", "z"]).collect()}
    own = np.array([r[1:] for r in rows if r[0] == "a" and r[1] is not None])
    x = np.hstack([np.ones((50, 1)), own[:, 1:] - own[:, 1:].mean(axis=0)])
    beta, rest, *_ = np.linalg.lstsq(x, own[:, 0], rcond=None)
    assert got["a"].beta == pytest.approx(beta[1:].tolist(), rel=1e-6) and got["a"].n == 50
    assert got["a"].r2 == pytest.approx(1 - rest[0] / ((own[:, 0] - own[:, 0].mean()) ** 2).sum(), rel=1e-6)
    se = np.sqrt(rest[0] / 46 * np.diag(np.linalg.inv(x.T @ x)))
    assert got["a"].t == pytest.approx((beta / se)[1:].tolist(), rel=1e-5)
    assert got["b"].beta is None and got["c"].beta is None and got["c"].n == 1


def test_shapley_blocks_add_up(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("a", *map(float, rng.normal(size=4))) for _ in range(40)], "k string, y double, p double, q double, z double")
    r = G.shapley_blocks(df, ["k"], "y", ["p", "q"], ["z"]).first()
    assert r.shapley_1 + r.shapley_2 == pytest.approx(r.r2_both) and r.r2_both >= max(r.r2_1, r.r2_2)


@pytest.mark.parametrize("circular", [False, True])
def test_block_bootstrap_draws_consecutive_rows(spark, circular):
    df = spark.createDataFrame([(k, i, i) for k, n in (("a", 17), ("b", 3), ("c", 1)) for i in range(n)], "k string, t int, v int")
    drawn = {}
    for r in S.block_bootstrap(df, ["k"], ["t"], 20, 5, circular).collect():
        drawn.setdefault((r.k, r.rep), []).append((r["at"], r.v))
    assert len(drawn) == 60
    for (k, _), rows in drawn.items():
        n = {"a": 17, "b": 3, "c": 1}[k]
        values = [v for _, v in sorted(rows)]
        assert len(values) == n and [a for a, _ in sorted(rows)] == list(range(n))
        steps = [(b - a) % n for i, (a, b) in enumerate(zip(values, values[1:], strict=False)) if (i + 1) % min(5, n)]
        assert all(s == 1 % n for s in steps)
    assert S.block_bootstrap(df.limit(0), ["k"], ["t"], 3, 2).count() == 0


@pytest.mark.parametrize(("length", "circular"), [(1, False), (5, True)])
def test_wide_bootstrap_draws_alike_without_sending_rows_everywhere(spark, length, circular):
    df = spark.createDataFrame([(k, i, i * 7) for k, n in (("a", 211), ("b", 3), ("c", 1)) for i in range(n)], "k string, t int, v int").repartition(5)
    drawn = lambda wide: S.block_bootstrap(df, ["k"], ["t"], 4, length, circular, wide=wide)
    assert sorted(map(tuple, drawn(True).collect())) == sorted(map(tuple, drawn(False).collect()))
    plan = drawn(True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plan  # the sizes of keys alone
    assert S.block_bootstrap(df.limit(0), ["k"], ["t"], 3, length, circular, wide=True).count() == 0


def test_cluster_bootstrap_keeps_sizes(spark):
    df = spark.createDataFrame([("g", c, i) for c in "xyz" for i in range(4)], "g string, c string, t int")
    rows = S.cluster_bootstrap(df, ["g"], "c", ["t"], 6).groupBy("rep", "draw").agg(F.count("*").alias("n"), F.count_distinct("c").alias("c")).collect()
    assert len(rows) == 18 and all((r.n, r.c) == (4, 1) for r in rows)


def test_shuffle_keeps_the_values_of_a_key(spark):
    df = spark.createDataFrame([("a", i, i * i) for i in range(9)] + [("b", 0, 7)], "k string, t int, x int")
    for r in S.shuffled(df, ["k"], "x", ["t"], 5).groupBy("k", "rep").agg(F.array_sort(F.collect_list("x")).alias("x")).collect():
        assert r.x == ([i * i for i in range(9)] if r.k == "a" else [7])


def test_exact_permutation_equals_all_relabellings(spark):
    values = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6]
    flags = [True, False, True, False, True, False]
    df = spark.createDataFrame([("g", i, f, v) for i, (f, v) in enumerate(zip(flags, values, strict=True))] + [("one", 0, True, 1.0)], "g string, u int, f boolean, v double")
    got = S.permutation_exact(df, ["g"], "u", "f", "v").collect()
    diff = lambda on: np.mean([values[i] for i in on]) - np.mean([v for i, v in enumerate(values) if i not in on])
    own = diff((0, 2, 4))
    every = [diff(c) for c in combinations(range(6), 3)]
    assert len(got) == 1 and got[0]["diff"] == pytest.approx(own) and got[0].relabellings == 20
    assert got[0].p == pytest.approx(np.mean([abs(d) >= abs(own) - 1e-9 for d in every]))


def test_exact_permutation_of_large_values_holds_the_observed_one(spark):
    values = [113196746.14, 98765432.1, 123456789.01, 87654321.09, 100000000.07]
    flags = [(i + 1) % 5 == 0 for i in range(5)]
    for scale in (1.0, 1e3, 1e6):  # the observed labels are one of the relabellings, and the largest of these here
        df = spark.createDataFrame([("g", i, f, v * scale / 3) for i, (f, v) in enumerate(zip(flags, [*values[:4], 1.0], strict=True))], "g string, u int, f boolean, v double")
        assert S.permutation_exact(df.repartition(3), ["g"], "u", "f", "v").first().p == pytest.approx(0.2)
    x = 1e8 / 3  # by hand: twice 0.1, as observed, twice 0.2 and twice 0
    df = spark.createDataFrame([("g", 0, True, x), ("g", 1, False, x + 0.1), ("g", 2, True, x + 0.2), ("g", 3, False, x + 0.3)], "g string, u int, f boolean, v double")
    assert S.permutation_exact(df, ["g"], "u", "f", "v").first().p == pytest.approx(2 / 3)


def test_halves_are_rounded_up_whatever_sums_leave(spark):
    from tidemark.functions import scalars as X

    cases = [(0.125, "0.13"), (1.005, "1.01"), (1.0049999999, "1.01"), (113196746.145, "113196746.15"), (2.00494, "2.00"), (-0.125, "-0.12"), (None, None)]
    df = spark.createDataFrame([(v, s) for v, s in cases], "v double, s string").withColumn("got", F.when(F.col("v").isNotNull(), F.format_string("%.2f", X.half_up("v"))))
    assert [(r.got, r.s) for r in df.collect()] == [(s, s) for _, s in cases]
    rows = spark.createDataFrame([("a", 0.12), ("a", 0.13), ("b", 1.0), ("b", 1.01), ("b", 1.01)], "k string, v double")
    got = {r.k: r.m for r in rows.groupBy("k").agg(X.mean_cents("v").alias("m")).collect()}
    assert got == {"a": 13, "b": 101}
    base = spark.createDataFrame([("a", 1234.5), ("a", 2345.0), ("b", 0.1), ("b", 0.4)], "k string, v double")
    got = {r.k: (r.s, r.m) for r in base.groupBy("k").agg(X.thousands("v").alias("s"), X.thousands("v", mean=True).alias("m")).collect()}
    assert got == {"a": (3.58, 1.79), "b": (0.001, 0.0)}


def test_benjamini_hochberg_runs_once_along_each_group(spark):
    ps = [0.01, 0.04, 0.04, 0.03, None, 0.9, 0.0001]
    df = spark.createDataFrame([("g", i, p) for i, p in enumerate(ps)], "g string, i int, p double")
    out = R.benjamini_hochberg(df, "p", ["g"])
    known = sorted(p for p in ps if p is not None)
    want = {p: min([1.0] + [q * 6 / (k + 1) for k, q in enumerate(known) if q >= p]) for p in known}
    assert {r.i: r.p_adj for r in out.collect() if r.p is not None} == pytest.approx({i: want[p] for i, p in enumerate(ps) if p is not None})
    # a frame up to the last row is gone through for every row
    frames = [x for x in out._jdf.queryExecution().analyzed().toString().split("specifiedwindowframe")[1:] if "p_adj" in x or "_raw" in x]
    assert frames and not any("unboundedfollowing" in x.split("windowspec")[0] and "currentrow" in x.split(")")[0] for x in frames)


def test_holm_and_tail(spark):
    df = spark.createDataFrame([("g", 0.01), ("g", 0.04), ("g", 0.03), ("g", None)], "g string, p double")
    got = {r.p: r.p_holm for r in S.holm(df, "p", ["g"]).collect()}
    assert got == {0.01: pytest.approx(0.03), 0.03: pytest.approx(0.06), 0.04: pytest.approx(0.06), None: None}
    tails = spark.createDataFrame([(k, n) for n in (1, 5, 40) for k in range(n + 1)], "k long, n long").withColumn("p", S.binomial_tail(F.col("k"), F.col("n")))
    assert all(r.p == pytest.approx(sum(comb(r.n, i) for i in range(r.k, r.n + 1)) / 2**r.n) for r in tails.collect())


def test_placebo_takes_dates_away_from_events(spark):
    days = [(date(2000, 1, 1 + i), float(i)) for i in range(20)]
    df = spark.createDataFrame([("s", d, v) for d, v in days], "k string, date date, effect double")
    events = spark.createDataFrame([("s", date(2000, 1, 10))], "k string, date date")
    r = S.placebo(df, events, "k", 3, 100).first()
    free = [v for d, v in days if abs((d - date(2000, 1, 10)).days) > 3]
    assert r.n == len(free) and r.p == pytest.approx(np.mean([v >= 9 for v in free])) and r.z == pytest.approx((9 - np.mean(free)) / np.std(free, ddof=1))


def test_cleaning_rules(spark):
    df = spark.createDataFrame([("ilostat/EAR_EMTA_SEX_AGE_CUR_NB_M.BRA", "revenue[PETR,VALE], brent_usd,", "C34X", "31/1/1999", "044.Share of �x�")], "id string, refs string, code string, day string, title string")
    family, dims = C.family_key(F.col("id"))
    r = df.select(family.alias("f"), dims.alias("d"), C.input_refs(F.col("refs")).alias("r"), C.code_group(F.col("code")).alias("g"), C.dmy(F.col("day")).alias("day"), C.clean_title(F.col("title")).alias("t")).first()
    assert (r.f, r.d, r.r, r.g, r.day, r.t) == ("EAR_EMTA_NB_M", ["SEX", "AGE", "CUR"], ["revenue@PETR", "revenue@VALE", "brent_usd"], ["lung", "ncd"], date(1999, 1, 31), "Share of 'x'")


def test_headline_rows_fall_back_to_the_smallest_code(spark):
    df = spark.createDataFrame([("a", "T|T"), ("a", "T|x"), ("b", "y|x"), ("b", "x|y"), ("b", "x|y")], "k string, codes string")
    assert sorted((r.k, r.codes) for r in R.headline(df, ["k"], "codes", "^T$").collect()) == [("a", "T|T"), ("b", "x|y"), ("b", "x|y")]


def test_prefix_codes_cover_leaves(spark):
    leaves = spark.createDataFrame([("0101210001",), ("0101210002",), ("0101300000",), ("9999999999",)], "leaf string")
    codes = spark.createDataFrame([("010121", 1.0), ("0101210001", 0.5), ("0101300000", 0.5)], "code string, f double")
    got = {r.parent: (r.leaves, r.covered) for r in J.cover_by_prefix(leaves, "leaf", codes, (4, 6, 8, 10), 6).collect()}
    assert got == {"010121": (2, 1.0), "010130": (1, 0.5), "999999": (1, 0.0)}


def test_text_edges_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{c}" for c in "abcdefghijkl"]
    rows = [(i, "xy"[i % 2], list(map(str, rng.choice(words, size=5)))) for i in range(40)]
    got = {(r.a, r.b): r.strength for r in E.text_edges(spark.createDataFrame(rows, "id int, t string, w array<string>"), "id", "t", F.col("w"), common=25).collect()}
    sets = {i: set(w) for i, _, w in rows}
    df = {w: sum(w in s for s in sets.values()) for w in words}
    idf = {w: np.log(40 / (1 + df[w])) for w in words}
    norm = {i: np.sqrt(sum(idf[w] ** 2 for w in s)) for i, s in sets.items()}
    want = {}
    for i in sets:
        near = []
        for j in sets:
            if i != j and i % 2 == j % 2 and (common := [w for w in sets[i] & sets[j] if df[w] < 25]):
                c = round(float(sum(idf[w] for w in common) / (norm[i] * norm[j])), 9)
                if c >= 0.35:
                    near.append((c, j))
        want |= {(i, j): pytest.approx(c) for c, j in sorted(near, reverse=True)[:4]}
    assert got == want


def test_family_and_neighbor_edges_are_bounded(spark):
    cat = spark.createDataFrame([(i, "big" if i < 70 else "small" if i < 73 else "lone", float(i)) for i in range(74)], "id int, f string, r double")
    family = E.family_edges(cat, F.col("f"), "id", "r")
    assert {(r.a, r.b) for r in family.collect()} == {(a, b) for a in (70, 71, 72) for b in (70, 71, 72) if a != b}
    near = E.neighbor_edges(cat, family, "id", ["f"], "r").groupBy("a").agg(F.count("*").alias("n")).collect()
    assert {r.a: r.n for r in near if r.a < 70} == dict.fromkeys(range(70), 4) and {r.a for r in near} == set(range(73))


def test_window_did_is_null_where_a_month_is_missing(spark):
    months = [date(1998 + m // 12, 1 + m % 12, 1) for m in range(36)]
    rows = [("a", d, 100.0 + i) for i, d in enumerate(months)] + [("b", d, 5.0) for d in months if d != date(2000, 2, 1)]
    breaks = spark.createDataFrame([(date(2000, 1, 1),)], "at date")
    got = {r.series_id: r.did for r in T.window_did(spark.createDataFrame(rows, "series_id string, date date, value double"), breaks, 3).collect()}
    v = {d: x for _, d, x in rows[:36]}
    growth = lambda ds: sum(v[d] for d in ds) / sum(v[d.replace(year=d.year - 1)] for d in ds)
    want = 100 * (growth([date(2000, m, 1) for m in (1, 2, 3)]) - growth([date(1999, m, 1) for m in (10, 11, 12)]))
    assert got == {"a": pytest.approx(want), "b": None}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "drift").mkdir()
    (tmp_path / "drift" / "a.csv").write_text("note\n\nA; PERIOD ;B\nx;2000/01;1\nx;total;9\n")
    (tmp_path / "drift" / "b.csv").write_text("PERIOD;A;B\r\n2001/12;y;2\r\nend\r\n")
    got = sorted(tuple(r)[1:] for r in B.read_drifting(spark, f"file://{tmp_path}/drift", ["PERIOD", "A", "B"]).collect())
    assert got == [("2000/01", "x", "1"), ("2001/12", "y", "2")]
    (tmp_path / "l.csv").write_bytes("﻿".encode() + "nome ; valor\nSão;1.234,5\n;\n".encode("latin-1", "replace"))
    assert [tuple(r) for r in B.read_locale(spark, f"file://{tmp_path}/l.csv", ["valor"]).na.drop(subset=["valor"]).select("valor").collect()] == [(1234.5,)]
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", float("nan"))], "k string, value double")
    assert B.write_bronze(df, f"file://{tmp_path}/out", ["k", "value"], ["k"]) == 1
    with pytest.raises(ValueError, match="nothing"):
        B.write_bronze(df.where("value is null"), f"file://{tmp_path}/none", ["k"], ["k"])
    with pytest.raises(ValueError, match="missing"):
        B.write_bronze(df, f"file://{tmp_path}/none", ["x"], ["k"])


def test_sums_before_run_over_ranges(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n")).repartition(5)
    got = {r.k: r.s for r in B.sum_before(df, "k", "n", "s").collect()}
    assert got == {k: sum(i % 7 for i in range(k)) for k in range(1000)}
