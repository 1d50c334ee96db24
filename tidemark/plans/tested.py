"""Registered queries of measures and tests given as data, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import thousands
from tidemark.operators import specified as S
from tidemark.sources import tables as X

from .warehouse import query

#: test, part, kind, x, its transform, y, its transform, lead, start, cut
MEASURES = [
    ("T1", 1, "corr", "sales", "log", "orders", "log", 0, "1995-01-01", None), ("T1", 2, "trend", "price", "log", None, None, 0, "1995-01-01", None),
    ("T2", 1, "trend", "sales", "sum12", None, None, 0, "1996-01-01", None), ("T2", 2, "trend", "orders", "mean12", None, None, 0, "1996-01-01", None),
    ("T3", 1, "corr", "sales", "pct12", "price", "pct12", 0, "1996-01-01", None), ("T3", 2, "trend", "orders", "log", None, None, 0, "1996-01-01", None),
    ("T4", 1, "ratio", "orders", "level", "sales", "level", 0, "1995-01-01", 7.0), ("T4", 2, "ratio", "orders", "level", "price", "level", 0, "1995-01-01", 7.0),
    ("T5", 1, "gap", "sales", "mean12", "sales", "level", 0, "1996-01-01", None), ("T6", 1, "corr", "sales", "pct1", "orders", "pct1", 0, "1995-01-01", None),
    ("T6", 2, "corr", "price", "pct1", "orders", "pct1", 0, "1995-01-01", None), ("T7", 1, "corr", "price", "change12", "sales", "pct12", 6, "1996-01-01", None),
    ("T8", 1, "corr", "orders", "mean12", "sales", "change12", 12, "1996-01-01", None), ("T9", 1, "corr", "sales", "level", "sales", "level", 1, "2001-06-01", None),
    ("T10", 1, "trend", "per_order", "log", None, None, 0, "1995-01-01", None),
]
#: test, least, op1, bound1, op2, bound2, mixed_op, mixed_bound
TESTS = [
    ("T1", 12, ">=", 0.7, "within", 2.0, ">=", 0.5), ("T2", 12, ">=", 50000.0, "within", 20.0, None, None), ("T3", 12, ">", 0.4, "within", 2.0, ">=", 0.2), ("T4", 6, "<", 0.7, "within", 1.0, None, None), ("T5", 12, ">", 0.0, None, None, None, None),
    ("T6", 24, ">", 0.8, "<", 0.0, None, None), ("T7", 24, "<", -0.1, None, None, "<", 0.0), ("T8", 18, "<", -0.2, None, None, "<", 0.0), ("T9", 24, ">", 0.1, None, None, None, None), ("T10", 24, "<=", 1.0, None, None, "<=", 2.0),
]
RATIOS = [("per_order", "sales", "orders")]
SPECS = [
    ("growth", "sales", "pct12", "whole"), ("growth", "sales", "pct12", "late"), ("activity", "orders", "mean12", "whole"), ("worth", "per_order", "level", "early"), ("worth", "per_order", "level", "late"), ("worth, log", "per_order", "log", "late"), ("pace", "orders", "change12", "late"), ("turnover", "sales", "sum12", "early"),
]
SAMPLES = [("whole", "1995-01-01", "2002-01-01"), ("early", "1995-01-01", "1998-07-01"), ("late", "1998-07-01", "2002-01-01")]


def _values(rows: list[tuple], name: str, columns: str) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns}))"


BASE = f"""bs AS (SELECT n_name AS entity, date_trunc('month', o_orderdate)::DATE AS date, (2 * sum(round(o_totalprice * 100)::BIGINT)::BIGINT + 100) // 200 / 1000 AS sales, count(*)::DOUBLE AS orders, (2 * sum(round(o_totalprice * 100)::BIGINT)::BIGINT + 100 * count(*)) // (200 * count(*)) / 1000 AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
bl AS (SELECT entity, metric, date, value FROM (UNPIVOT bs ON sales, orders, price INTO NAME metric VALUE value) UNION ALL SELECT entity, 'per_order', date, sales / orders FROM bs),
bt AS (SELECT entity, metric, date, unnest(['level', 'log', 'change12', 'pct1', 'pct12', 'sum12', 'mean12']) AS transform, unnest([value, CASE WHEN value > 0 THEN ln(value) END, value - lag(value, 12) OVER w, 100 * value / lag(value) OVER w - 100, 100 * value / lag(value, 12) OVER w - 100, CASE WHEN count(*) OVER y = 12 THEN sum(value) OVER y END, CASE WHEN count(*) OVER y = 12 THEN avg(value) OVER y END]) AS v
  FROM bl WINDOW w AS (PARTITION BY entity, metric ORDER BY date), y AS (PARTITION BY entity, metric ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""
HOLDS = "CASE {op} WHEN '>=' THEN {v} >= {b} WHEN '>' THEN {v} > {b} WHEN '<=' THEN {v} <= {b} WHEN '<' THEN {v} < {b} WHEN 'within' THEN abs({v}) <= {b} END"
C1, C2, CM = (HOLDS.format(op=o, v=v, b=b) for o, v, b in (("op1", "s1", "bound1"), ("op2", "s2", "bound2"), ("mixed_op", "s1", "mixed_bound")))
SHORT = "(n1 < least OR s1 IS NULL OR (op2 IS NOT NULL AND (s2 IS NULL OR n2 < least)))"
SAID = "format('{{}} {{:.2f}} {{}} {{:.2f}} over {{}} dates', k{k}, floor(round(s{k} * 100000) / 1000 + 0.5) / 100, op{k}, bound{k}::DOUBLE, n{k})"


def _base(spark, d):
    o = X.table(spark, d, "orders").join(X.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = o.groupBy("c_nationkey", F.to_date(F.trunc("o_orderdate", "month")).alias("date")).agg(thousands("o_totalprice").alias("sales"), F.count("*").cast("double").alias("orders"), thousands("o_totalprice", mean=True).alias("price"))
    named = m.join(X.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("entity"), "date", "sales", "orders", "price")
    long = named.unpivot(["entity", "date"], ["sales", "orders", "price"], "metric", "value")
    return S.with_ratios(long, spark.createDataFrame(RATIOS, "metric string, numerator string, denominator string"))


@query(f"""WITH {BASE}, {_values(MEASURES, 'me', 'test, part, kind, x, xt, y, yt, lead, start, cut')}, {_values(TESTS, 'te', 'test, least, op1, bound1, op2, bound2, mixed_op, mixed_bound')},
mr AS (SELECT me.*, a.entity, a.date, a.v AS vx, b.v AS vy, year(a.date) + (month(a.date) - 1) / 12 AS years FROM me JOIN bt a ON a.metric = x AND a.transform = xt AND a.v IS NOT NULL AND a.date >= start::DATE LEFT JOIN bt b ON b.metric = y AND b.transform = yt AND b.entity = a.entity AND b.v IS NOT NULL AND b.date = (a.date + lead * INTERVAL 1 MONTH)::DATE WHERE y IS NULL OR b.v IS NOT NULL),
ms AS (SELECT test, part, kind, entity, count(*) AS n, max(date) AS as_of, CASE kind WHEN 'corr' THEN CASE WHEN count(*) > 1 THEN corr(vx, vy) END WHEN 'trend' THEN 100 * regr_slope(vx, years) WHEN 'ratio' THEN CASE WHEN count(*) FILTER (vx < cut) >= 3 AND count(*) FILTER (vx >= cut) >= 3 THEN avg(vy) FILTER (vx < cut) / avg(vy) FILTER (vx >= cut) END WHEN 'gap' THEN arg_max(vx - vy, date) END AS s FROM mr GROUP BY 1, 2, 3, 4),
mv AS (SELECT te.*, a.entity, a.kind AS k1, a.n AS n1, a.s AS s1, a.as_of, b.kind AS k2, b.n AS n2, b.s AS s2 FROM ms a LEFT JOIN ms b ON b.test = a.test AND b.entity = a.entity AND b.part = 2 JOIN te ON te.test = a.test WHERE a.part = 1)
SELECT test, entity, CASE WHEN {SHORT} THEN 'Insufficient data' WHEN {C1} AND (op2 IS NULL OR {C2}) THEN 'Supported' WHEN CASE WHEN mixed_op IS NOT NULL THEN {CM} ELSE op2 IS NOT NULL AND ({C1} OR {C2}) END THEN 'Mixed' ELSE 'Not supported' END AS verdict, round(s1, 5) + 0.0 AS statistic, n1 AS n, as_of,
CASE WHEN NOT {SHORT} THEN {SAID.format(k=1)} || CASE WHEN op2 IS NOT NULL THEN '; ' || {SAID.format(k=2)} ELSE '' END END AS evidence FROM mv""")
def tests_as_data(spark, d):
    """Ten tests, each a row of thresholds on one or two measures, for every nation, with verdict and evidence."""
    measures = spark.createDataFrame(MEASURES, "test string, part int, kind string, x string, x_transform string, y string, y_transform string, lead int, start string, cut double").withColumn("start", F.col("start").cast("date"))
    tests = spark.createDataFrame(TESTS, "test string, least int, op1 string, bound1 double, op2 string, bound2 double, mixed_op string, mixed_bound double")
    return S.verdicts(S.measured(_base(spark, d), measures), tests).withColumn("statistic", F.round("statistic", 5) + F.lit(0.0))


@query(f"""WITH {BASE}, {_values(SPECS, 'sp', 'spec, metric, transform, sample')}, {_values(SAMPLES, 'sa', 'sample, start, "end"')}
SELECT spec, sample, entity, count(*) AS n, round(avg(v), 5) + 0.0 AS mean, round(arg_min(v, date), 5) + 0.0 AS first, round(arg_max(v, date), 5) + 0.0 AS last FROM sp JOIN sa USING (sample) JOIN bt USING (metric, transform) WHERE v IS NOT NULL AND date >= start::DATE AND date < "end"::DATE GROUP BY 1, 2, 3""")
def metric_registry(spark, d):
    """Outcomes by specification: a metric or ratio, its transform and its sample, all in one plan."""
    specs = spark.createDataFrame(SPECS, "spec string, metric string, transform string, sample string")
    samples = spark.createDataFrame(SAMPLES, "sample string, start string, end string").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    return S.panel(_base(spark, d), specs, samples).withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("mean", "first", "last")})
