"""Registered queries of data quality, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.sources import tables as X

from .warehouse import FD, FX, W12, query

#: Another edition of the series: no Januaries, Junes one per mille higher, dates before 2001-06.
ALT = "fa AS (SELECT series_id, date, CASE WHEN month(date) = 6 THEN value * 1.001 ELSE value END AS value FROM fx WHERE month(date) <> 1 AND date < DATE '2001-06-01')"


def _alt(spark, d):
    fx = X.nation_series(spark, d).where((F.month("date") != 1) & (F.col("date") < F.lit("2001-06-01").cast("date")))
    return fx.withColumn("value", F.when(F.month("date") == 6, F.col("value") * 1.001).otherwise(F.col("value")))


@query(f"""WITH {FX}, l AS (SELECT *, lag(date) {W12} AS p FROM fx), g AS (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE (year(date) - year(p)) * 12 + month(date) - month(p) > 1) AS gaps FROM l GROUP BY 1)
SELECT *, CASE WHEN gaps = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM g""")
def gap_scan(spark, d):
    return Q.gap_scan(X.nation_series(spark, d))


@query("SELECT o_orderpriority AS theme, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS total, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS share FROM orders GROUP BY 1")
def coverage_report(spark, d):
    o = X.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "theme")
    return Q.coverage(o, "theme", F.col("o_orderstatus") == "F").withColumn("share", F.round("share", 6))


@query(f"""WITH {FX}, {ALT}, j AS (SELECT series_id, fa.value AS a, fx.value AS b FROM fa FULL JOIN fx USING (series_id, date))
SELECT series_id, count(*) FILTER (WHERE abs(a - b) <= 1e-9 * abs(b)) AS equal, count(*) FILTER (WHERE abs(a - b) > 1e-9 * abs(b)) AS unequal, count(*) FILTER (WHERE a IS NULL) AS missing, count(*) FILTER (WHERE b IS NULL) AS extra FROM j GROUP BY 1""")
def reference_equality(spark, d):
    return Q.reference_equality(_alt(spark, d), X.nation_series(spark, d))


@query(f"""WITH {FX}, {ALT} SELECT series_id, count(*) AS n, round(median(100 * abs(fa.value / fx.value - 1)), 6) AS median_pct, round(max(100 * abs(fa.value / fx.value - 1)), 6) AS max_pct FROM fx JOIN fa USING (series_id, date) WHERE fx.value <> 0 GROUP BY 1""")
def cross_source_deviation(spark, d):
    return Q.deviation(X.nation_series(spark, d), _alt(spark, d)).withColumns({c: F.round(c, 6) for c in ("median_pct", "max_pct")})


@query("""WITH p AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS parts FROM lineitem GROUP BY 1)
SELECT k AS o_orderkey, round(parts, 2) AS parts, o_totalprice AS total FROM p JOIN orders ON k = o_orderkey WHERE abs(parts - o_totalprice) > 1.0""")
def parts_sum_check(spark, d):
    part = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    parts = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), part.alias("part"))
    totals = X.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"))
    return Q.parts_sum(parts, totals, "o_orderkey", 1.0).withColumn("parts", F.round("parts", 2))


VERSIONS = "v AS (SELECT l_suppkey, year(l_shipdate)::INTEGER AS year, l_linenumber, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1, 2, 3)"


def _versions(spark, d):
    return X.table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year"), "l_linenumber").agg(F.round(F.avg("l_extendedprice"), 4).alias("value"))


@query(f"""WITH {VERSIONS}, r AS (SELECT l_suppkey, year, arg_min(value, l_linenumber) AS original, arg_max(value, l_linenumber) AS restated, count(*) AS versions FROM v GROUP BY 1, 2)
SELECT * FROM r WHERE abs(restated / original - 1) > 0.005""")
def restatement_report(spark, d):
    return Q.restated(_versions(spark, d), ["l_suppkey", "year"], "l_linenumber", "value")


@query(f"WITH {VERSIONS} SELECT l_suppkey, year, max(l_linenumber) AS version, arg_max(value, l_linenumber) AS value FROM v GROUP BY 1, 2")
def latest_version(spark, d):
    return _versions(spark, d).groupBy("l_suppkey", "year").agg(F.max("l_linenumber").alias("version"), F.max_by("value", "l_linenumber").alias("value"))


@query(f"WITH {FD}, l AS (SELECT *, value / lag(value) {W12} - 1 AS c FROM fd) SELECT series_id, date, value, round(c, 6) AS change FROM l WHERE abs(c) > 0.2")
def outlier_returns(spark, d):
    return Q.outliers(X.daily_prices(spark, d).drop("y")).withColumn("change", F.round("change", 6))


@query(f"""WITH {FX}, {ALT}, a AS (SELECT count(DISTINCT series_id) AS new_series, count(*) AS new_points FROM fa), b AS (SELECT count(DISTINCT series_id) AS old_series, count(*) AS old_points FROM fx)
SELECT *, new_series >= 0.9 * old_series AND new_points >= 0.9 * old_points AS ok FROM a, b""")
def shrink_gate(spark, d):
    return Q.shrink_gate(_alt(spark, d), X.nation_series(spark, d))


@query(f"""WITH {FX}, y AS (SELECT series_id, year(date)::INTEGER AS year, count(*) AS n FROM fx GROUP BY 1, 2), w AS (SELECT *, min(year) OVER (PARTITION BY series_id) AS a, max(year) OVER (PARTITION BY series_id) AS b FROM y)
SELECT series_id, year, n FROM w WHERE n < 12 AND year > a AND year < b""")
def completeness_assert(spark, d):
    return Q.incomplete_years(X.nation_series(spark, d))


CARRIED = """c AS (SELECT *, o_totalprice > 300000 AS flag, coalesce(bool_or(o_totalprice > 300000) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS predicted FROM orders)"""


def _carried(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return Q.carried_class(o, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_totalprice") > 300000)


@query(f"WITH {CARRIED} SELECT o_orderkey, flag, predicted FROM c")
def carry_forward_class(spark, d):
    return _carried(spark, d).select("o_orderkey", "flag", "predicted")


@query(f"WITH {CARRIED} SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, count(*) FILTER (WHERE flag = predicted) AS agree FROM c GROUP BY 1")
def out_of_sample_validation(spark, d):
    return _carried(spark, d).groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("flag") == F.col("predicted")).alias("agree"))


@query("SELECT s_suppkey, s_acctbal, s_acctbal BETWEEN -500 + 100 * n_regionkey AND 9000 AS ok FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def range_checks(spark, d):
    bounds = F.broadcast(X.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (-500 + 100 * F.col("n_regionkey")).alias("lo")))
    return X.table(spark, d, "supplier").join(bounds, "s_nationkey").select("s_suppkey", "s_acctbal", F.col("s_acctbal").between(F.col("lo"), 9000).alias("ok"))


@query("SELECT p_partkey, p_type, p_name FROM part WHERE p_type = 'ECONOMY' AND NOT regexp_matches(p_name, 'ring|widget')")
def description_check(spark, d):
    return X.table(spark, d, "part").where((F.col("p_type") == "ECONOMY") & ~F.col("p_name").rlike("ring|widget")).select("p_partkey", "p_type", "p_name")
