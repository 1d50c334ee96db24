"""Registered queries of the resampling operators over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import resampling as S
from tidemark.sources import tables as X

from .warehouse import FD, FX, query


@query(f"WITH {FX} SELECT series_id, date_trunc('quarter', date)::DATE AS date, round(avg(value), 4) AS mean, arg_max(value, date) AS last, round(sum(value), 2) AS total, count(value) AS n FROM fx GROUP BY 1, 2")
def resample_agg(spark, d):
    return S.resample(X.nation_series(spark, d), "quarter").withColumns({"mean": F.round("mean", 4), "total": F.round("total", 2)})


@query(f"""WITH {FD}, m AS (SELECT series_id, last_day(date) AS month, max(date) AS seen, arg_max(value, date) AS value FROM fd GROUP BY 1, 2)
SELECT series_id, CASE WHEN month = max(month) OVER (PARTITION BY series_id) THEN seen ELSE month END AS date, value FROM m""")
def month_last_partial(spark, d):
    return S.month_last_partial(X.daily_prices(spark, d))


@query(f"WITH {FD} SELECT series_id, last_day(date) AS month, round(sum(value), 2) AS total, count(*) AS days FROM fd GROUP BY 1, 2 HAVING max(date) = last_day(date)")
def complete_months_only(spark, d):
    return S.complete_months(X.daily_prices(spark, d)).withColumn("total", F.round("total", 2))


@query(f"""WITH {FX}, s AS (SELECT *, lead(date) OVER (PARTITION BY series_id ORDER BY date) AS until FROM fx),
y AS (SELECT *, unnest(range(year(date), year(until - 1) + 1)) AS yr FROM s WHERE until IS NOT NULL),
z AS (SELECT series_id, yr, value, date_diff('day', greatest(date, make_date(yr, 1, 1)), least(until, make_date(yr + 1, 1, 1))) AS days FROM y)
SELECT series_id, yr::INTEGER AS year, round(sum(value * days) / sum(days), 4) AS mean, sum(days)::BIGINT AS days FROM z GROUP BY 1, 2""")
def step_function_annual_mean(spark, d):
    return S.step_annual_mean(X.nation_series(spark, d)).withColumn("mean", F.round("mean", 4))


@query(f"""WITH {FX}, s AS (SELECT *, date_diff('day', date, lead(date) OVER (PARTITION BY series_id ORDER BY date)) AS step FROM fx),
g AS (SELECT *, step > greatest(45.0, 4 * median(step) OVER (PARTITION BY series_id)) AS gap FROM s)
SELECT series_id, date, value FROM g UNION ALL SELECT series_id, date + 1, NULL FROM g WHERE gap""")
def line_breaks(spark, d):
    return S.line_breaks(X.nation_series(spark, d))


@query("""WITH q AS (SELECT o_orderpriority AS series_id, year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS quarter, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2, 3)
SELECT series_id, year, quarter, value FROM q""")
def ytd_to_quarter(spark, d):
    o = X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.sum("o_totalprice").alias("v"))
    ytd = o.withColumn("ytd", F.sum("v").over(S.Window.partitionBy("series_id", "year").orderBy("quarter"))).drop("v")
    return S.ytd_to_quarter(ytd).withColumn("value", F.round("value", 2))


@query("""SELECT day, l_quantity, l_orderkey, l_linenumber FROM (
SELECT l_shipdate::DATE AS day, l_quantity, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_shipdate::DATE ORDER BY abs(l_quantity - 25), l_orderkey, l_linenumber) AS k
FROM lineitem WHERE abs(l_quantity - 25) <= 3.5) WHERE k = 1""")
def constant_maturity(spark, d):
    rows = X.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_quantity", "l_orderkey", "l_linenumber")
    return S.nearest_to(rows, ["day"], "l_quantity", 25, 3.5, ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, round(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 30.44, 6) AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def duration_months(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    both = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o, "l_orderkey")
    return both.select("l_orderkey", "l_linenumber", F.round(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) / 30.44, 6).alias("months"))


def _custkeys(spark, d, year):
    return X.table(spark, d, "orders").where(F.year("o_orderdate") == year).select("o_custkey")


@query("SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997")
def set_difference(spark, d):
    return _custkeys(spark, d, 1996).subtract(_custkeys(spark, d, 1997))


@query("SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997")
def set_intersection(spark, d):
    return _custkeys(spark, d, 1996).intersect(_custkeys(spark, d, 1997))
