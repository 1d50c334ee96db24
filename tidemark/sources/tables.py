"""Series tables that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (nation), date (month start), value (sum of orders)."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    # summed by key before the small dimension is met
    monthly = o.groupBy("c_nationkey", F.trunc("o_orderdate", "month").alias("date")).agg(F.sum("o_totalprice").alias("value"))
    nations = F.broadcast(table(spark, sf_dir, "nation"))
    return monthly.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("series_id"), "date", F.round("value", 2).alias("value"))


NATION_SERIES = """fx AS (
  SELECT n_name AS series_id, date_trunc('month', o_orderdate)::DATE AS date, round(sum(o_totalprice), 2) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (return flag), date (ship day), value (mean price), y (quantity)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("date")).agg(F.round(F.avg("l_extendedprice"), 4).alias("value"), F.round(F.sum("l_quantity"), 2).alias("y"))


DAILY_PRICES = """fd AS (
  SELECT l_returnflag AS series_id, l_shipdate::DATE AS date, round(avg(l_extendedprice), 4) AS value, round(sum(l_quantity), 2) AS y
  FROM lineitem GROUP BY 1, 2)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rule = F.element_at(F.array(F.lit("sum"), F.lit("last"), F.lit("mean")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return n.select(F.col("n_name").alias("series_id"), F.initcap("n_name").alias("title"), F.col("r_name").alias("topic"), rule.alias("agg"))


CATALOGUE = """fc AS (
  SELECT n_name AS series_id, r_name AS topic, CASE n_nationkey % 3 WHEN 0 THEN 'sum' WHEN 1 THEN 'last' ELSE 'mean' END AS agg
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

#: Half-open terms of office, used as a small interval dimension, with a gap between the last two.
TERMS = [("1995-01-01", "1997-07-01", "left"), ("1997-07-01", "1999-06-01", "right"), ("1999-10-01", "2003-01-01", "centre")]


def terms(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(TERMS, "start string, end string, lean string")
    return rows.select(F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"), "lean")


TERMS_SQL = "ft AS (SELECT * FROM (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}', '{c}')" for a, b, c in TERMS) + ') t(start, "end", lean))'


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, topic (nation), kind, date, value: a supplier's monthly sales (s/), a thousandfold edition (m/) and one close to that (x/)."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.to_date(F.trunc("l_shipdate", "month")).alias("date")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = li.join(s.select(F.col("s_suppkey").alias("k"), F.col("n_name").alias("topic")), "k")
    thousand = F.col("v") * 1000 + F.month("date")
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.round(v, 2).alias("value")) for kind, v in (("s", F.col("v")), ("m", thousand), ("x", thousand * 1.001))])
    return rows.select("k", "topic", "date", F.explode(kinds).alias("e")).select(F.concat_ws("/", "e.kind", "k").alias("series_id"), "topic", "e.kind", "date", "e.value")


def edition_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, title, unit, priority, rank, protected for each series of `editions`."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    plain = F.concat_ws(" ", F.lower("n_name"), F.lit("sales"))
    other = F.when(F.col("s_acctbal") < 500, F.concat(F.lit("bulletin "), F.col("s_suppkey"))).when(F.col("s_acctbal") < 1500, F.concat(plain, F.lit(" rural"))).otherwise(plain)
    edition = F.when(F.col("s_acctbal") < 4000, F.concat(other, F.lit(" edition"))).otherwise(other)
    bal = F.col("s_acctbal")
    of = lambda kind, title, unit, priority, rank, protected: F.struct(F.concat_ws("/", F.lit(kind), "s_suppkey").alias("series_id"), title.alias("title"), unit.alias("unit"), F.lit(priority).cast("int").alias("priority") if isinstance(priority, int) else priority.alias("priority"), rank.alias("rank"), protected.alias("protected"))
    usd, no = F.lit("usd"), F.lit(False)
    rows = F.array(
        of("s", plain, F.when(bal > 8000, "pct").otherwise("usd"), 0, bal, no),
        of("m", other, usd, 1, bal, no),
        of("x", edition, usd, F.when(bal < 6000, 1).otherwise(2), F.when(bal < 2500, bal + 1).otherwise(bal - 1), (bal > 5000) & (bal < 5500)),
    )
    return s.select(F.explode(rows).alias("r")).select("r.*")


EDITIONS = """li AS (SELECT l_suppkey AS k, date_trunc('month', l_shipdate)::DATE AS date, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1, 2),
ed AS (SELECT kind || '/' || k AS series_id, n_name AS topic, kind, date, round(CASE kind WHEN 's' THEN v WHEN 'm' THEN v * 1000 + month(date) ELSE (v * 1000 + month(date)) * 1.001::DOUBLE END, 2) AS value
  FROM li JOIN supplier ON s_suppkey = k JOIN nation ON n_nationkey = s_nationkey, (SELECT unnest(['s', 'm', 'x']) AS kind)),
eo AS (SELECT s_suppkey AS k, s_acctbal AS bal, lower(n_name) || ' sales' AS plain, CASE WHEN s_acctbal < 500 THEN 'bulletin ' || s_suppkey WHEN s_acctbal < 1500 THEN lower(n_name) || ' sales rural' ELSE lower(n_name) || ' sales' END AS other FROM supplier JOIN nation ON n_nationkey = s_nationkey),
et AS (SELECT 's/' || k AS series_id, plain AS title, CASE WHEN bal > 8000 THEN 'pct' ELSE 'usd' END AS unit, 0 AS priority, bal AS rank, false AS protected FROM eo
  UNION ALL SELECT 'm/' || k, other, 'usd', 1, bal, false FROM eo
  UNION ALL SELECT 'x/' || k, CASE WHEN bal < 4000 THEN other || ' edition' ELSE other END, 'usd', CASE WHEN bal < 6000 THEN 1 ELSE 2 END, CASE WHEN bal < 2500 THEN bal + 1 ELSE bal - 1 END, bal > 5000 AND bal < 5500 FROM eo)"""
