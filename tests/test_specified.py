"""Measures and tests given as data."""

import datetime as dt

from tidemark.operators import specified as S

MEASURE = "test string, part int, kind string, x string, x_transform string, y string, y_transform string, lead int, start date, cut double"
TEST = "test string, least int, op1 string, bound1 double, op2 string, bound2 double, mixed_op string, mixed_bound double"
OLD = dt.date(1990, 1, 1)


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def base(spark):
    rows = [("e", "x", month(i), float(2 ** (i / 12))) for i in range(36)]  # doubles each year
    rows += [("e", "y", month(i), float(i % 5)) for i in range(36)] + [("f", "x", month(i), 1.0) for i in range(13)]
    return spark.createDataFrame(rows, "entity string, metric string, date date, value double")


def test_transforms_and_ratios(spark):
    df = S.with_ratios(base(spark), spark.createDataFrame([("y_by_x", "y", "x")], "metric string, numerator string, denominator string"))
    wanted = spark.createDataFrame([("x", t) for t in ("level", "log", "pct12", "sum12", "change12", "odd")] + [("y_by_x", "level")], "metric string, transform string")
    got = {}
    for r in S.transformed(df, wanted).where("entity = 'e'").collect():
        got.setdefault((r.metric, r.transform), {})[r.date] = r.v
    assert set(got) == {("x", "level"), ("x", "log"), ("x", "pct12"), ("x", "sum12"), ("x", "change12"), ("y_by_x", "level")}
    assert len(got["x", "pct12"]) == 24 and all(abs(v - 100) < 1e-9 for v in got["x", "pct12"].values()) and len(got["x", "sum12"]) == 25
    assert abs(got["y_by_x", "level"][month(13)] - (13 % 5) / 2 ** (13 / 12)) < 1e-12


def test_measures_of_every_kind(spark):
    measures = [
        ("a", 1, "trend", "x", "log", None, None, 0, OLD, None), ("b", 1, "corr", "x", "level", "x", "level", 3, OLD, None), ("c", 1, "ratio", "y", "level", "x", "level", 0, OLD, 3.0),
        ("d", 1, "gap", "x", "level", "y", "level", 0, OLD, None), ("e", 1, "corr", "x", "level", "none", "level", 0, OLD, None), ("g", 1, "ratio", "y", "level", "x", "level", 0, OLD, 0.0),
    ]
    got = {(r.test, r.entity): r for r in S.measured(base(spark), spark.createDataFrame(measures, MEASURE)).collect()}
    x = [2 ** (i / 12) for i in range(36)]
    assert abs(got["a", "e"].statistic - 69.3147) < 0.01 and got["a", "e"].n == 36 and got["a", "f"].statistic == 0
    assert got["b", "e"].n == 33 and abs(got["b", "e"].statistic - 1) < 1e-9 and got["b", "e"].as_of == month(32)
    low, high = [v for i, v in enumerate(x) if i % 5 < 3], [v for i, v in enumerate(x) if i % 5 >= 3]
    assert abs(got["c", "e"].statistic - sum(low) / len(low) * len(high) / sum(high)) < 1e-9
    assert abs(got["d", "e"].statistic - (x[35] - 0)) < 1e-9 and got["g", "e"].statistic is None
    assert ("e", "e") not in got and ("c", "f") not in got


def test_verdicts(spark):
    rows = [("t", 1, "corr", "p", 30, 0.8), ("t", 2, "trend", "p", 30, 1.0), ("t", 1, "corr", "q", 30, 0.8), ("t", 2, "trend", "q", 30, 9.0), ("t", 1, "corr", "r", 30, 0.1), ("t", 2, "trend", "r", 30, 9.0), ("t", 1, "corr", "s", 5, 0.8), ("t", 2, "trend", "s", 30, 1.0), ("t", 1, "corr", "u", 30, 0.9)]
    rows += [("one", 1, "corr", k, 30, v) for k, v in (("p", 0.8), ("q", 0.6), ("r", 0.2), ("s", None))]
    measures = spark.createDataFrame([(*r, OLD) for r in rows], "test string, part int, kind string, entity string, n long, statistic double, as_of date")
    tests = spark.createDataFrame([("t", 12, ">=", 0.7, "within", 2.0, None, None), ("one", 12, ">", 0.7, None, None, ">=", 0.5)], TEST)
    got = {(r.test, r.entity): r for r in S.verdicts(measures, tests).collect()}
    assert {k[1]: r.verdict for k, r in got.items() if k[0] == "t"} == {"p": "Supported", "q": "Mixed", "r": "Not supported", "s": "Insufficient data", "u": "Insufficient data"}
    assert {k[1]: r.verdict for k, r in got.items() if k[0] == "one"} == {"p": "Supported", "q": "Mixed", "r": "Not supported", "s": "Insufficient data"}
    assert got["t", "p"].evidence == "corr 0.80 >= 0.70 over 30 dates; trend 1.00 within 2.00 over 30 dates" and got["t", "s"].evidence is None
