"""Registered queries of linking, curation and ranking, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import linking as L
from tidemark.operators import overlap as O
from tidemark.operators import rollups as R
from tidemark.operators import timeseries as T
from tidemark.sources import tables as X

from .warehouse import FC, FT, FX, W12, query


def _with_topic(df, spark, d):
    return df.join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic")), "series_id")


@query(f"""WITH {FX}, {FC}, l AS (SELECT series_id, topic, date, 100 * (value / lag(value, 12) {W12} - 1) AS v FROM fx JOIN fc USING (series_id))
SELECT x.series_id AS a, y.series_id AS b, count(*) AS n, round(corr(x.v, y.v), 6) AS corr FROM l x JOIN l y ON x.topic = y.topic AND x.date = y.date AND x.series_id < y.series_id
WHERE x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 36 AND abs(corr(x.v, y.v)) >= 0.1""")
def edges_comove(spark, d):
    yoy = _with_topic(T.yoy_positional(X.nation_series(spark, d)), spark, d).select("series_id", "topic", "date", F.col("yoy").alias("value"))
    return O.comoving(yoy, ["topic"], "series_id", "date", "value", 36, 0.1).withColumn("corr", F.round("corr", 6))


@query(f"""WITH {FX}, {FC}, y AS (SELECT series_id, topic, year(date)::INTEGER AS year, round(sum(value), 2) AS v, round(sum(value), 2) * 1000 + year(date) AS w FROM fx JOIN fc USING (series_id) GROUP BY series_id, topic, year(date)),
x AS (SELECT *, CASE WHEN lag(year) OVER k = year - 1 THEN v - lag(v) OVER k END AS dv, CASE WHEN lag(year) OVER k = year - 1 THEN w - lag(w) OVER k END AS dw FROM y WINDOW k AS (PARTITION BY series_id ORDER BY year)),
p AS (SELECT a.series_id AS a, 'alt/' || b.series_id AS b, count(*) AS n, corr(a.v, b.w) AS corr, median(b.w / a.v) AS ratio, corr(a.dv, b.dw) AS change FROM x a JOIN x b ON a.topic = b.topic AND a.year = b.year GROUP BY 1, 2)
SELECT a, b, n, round(corr, 6) AS corr, round(log10(ratio))::INTEGER AS power FROM p WHERE n >= 5 AND corr >= 0.9999 AND ratio > 0 AND abs(ratio / pow(10, round(log10(ratio))) - 1) <= 0.02 AND change >= least(0.9, corr)""")
def twin_match(spark, d):
    fx = _with_topic(X.nation_series(spark, d), spark, d)
    y = fx.groupBy("series_id", "topic", F.year("date").alias("year")).agg(F.round(F.sum("value"), 2).alias("value"))
    alt = y.withColumns({"series_id": F.concat(F.lit("alt/"), "series_id"), "value": F.col("value") * 1000 + F.col("year")})
    return L.twin_match(y, alt, ["topic"], least_corr=0.9999).select("a", "b", "n", F.round("corr", 6).alias("corr"), "power")


@query("""SELECT p_brand || '/' || p_type AS family, p_partkey, first_value(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS representative, count(*) OVER (PARTITION BY p_brand, p_type) AS members FROM part""")
def family_merge(spark, d):
    return L.families(X.table(spark, d, "part"), F.concat_ws("/", "p_brand", "p_type"), [F.desc("p_retailprice"), F.col("p_partkey")], "p_partkey")


SPENT = "s AS (SELECT c_custkey, c_nationkey, c_acctbal, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3)"


def _spent(spark, d):
    o = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return X.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(o, "c_custkey", "left").fillna(0, ["n", "spent"])


@query(f"WITH {SPENT} SELECT c_custkey, n, CASE WHEN n < 5 THEN 'sparse' ELSE 'negative' END AS reason FROM s WHERE n < 5 OR c_acctbal < 0")
def exclusion_log(spark, d):
    return L.exclusions(_spent(spark, d), [("sparse", F.col("n") < 5), ("negative", F.col("c_acctbal") < 0)]).select("c_custkey", "n", "reason")


@query(f"WITH {SPENT} SELECT c_custkey, n, spent FROM s WHERE n >= 5 AND c_acctbal >= 0")
def curate_series(spark, d):
    s = _spent(spark, d)
    gone = L.exclusions(s, [("sparse", F.col("n") < 5), ("negative", F.col("c_acctbal") < 0)]).select("c_custkey")
    return s.join(gone, "c_custkey", "left_anti").select("c_custkey", "n", "spent")


@query(f"WITH {SPENT}, r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC) AS r FROM s) SELECT c_nationkey, round(sum(spent) FILTER (WHERE r <= 5) / sum(spent), 6) AS share FROM r GROUP BY 1")
def top_share(spark, d):
    return L.top_share(_spent(spark, d), "c_nationkey", "spent", 5).withColumn("share", F.round("share", 6))


RANK = """fr AS (SELECT series_id, round_even((ln(1 + count(value)) + ln(1 + date_diff('day', min(date), max(date)) / 365.25)) * CASE WHEN date_diff('day', max(date), DATE '2001-09-01') <= 60 THEN 1.0 ELSE 0.5 END, 3) AS rank FROM fx GROUP BY 1)"""
EDGES = """m AS (SELECT n_name AS id, n_nationkey % 4 AS l FROM nation), e AS (
SELECT x.id AS a, y.id AS b, 'list' AS reason, 0.9 AS weight FROM m x JOIN m y ON x.l = y.l AND x.id < y.id
UNION ALL SELECT x.series_id, y.series_id, 'topic', 0.5 FROM fc x JOIN fc y ON x.topic = y.topic AND x.series_id < y.series_id)"""


def _rank(spark, d):
    return L.rank_score(R.series_stats(X.nation_series(spark, d)), "2001-09-01").select("series_id", "rank")


def _edges(spark, d):
    lists = X.table(spark, d, "nation").select((F.col("n_nationkey") % 4).alias("l"), F.col("n_name").alias("id"))
    return L.comembers(lists, "l", "id", "list", 0.9).unionByName(L.comembers(X.catalogue(spark, d), "topic", "series_id", "topic", 0.5))


@query(f"WITH {FX}, {RANK} SELECT * FROM fr")
def rank_score(spark, d):
    return _rank(spark, d)


@query(f"WITH {FC}, {EDGES} SELECT a, b, reason, weight::DOUBLE AS weight FROM e")
def comembership_join(spark, d):
    return _edges(spark, d)


SCORED = f"""{FX}, {FC}, {RANK}, {EDGES}, o AS (SELECT a, b, max((weight, reason)) AS w FROM e GROUP BY 1, 2), u AS (SELECT a AS series_id, b AS related_id, w FROM o UNION ALL SELECT b, a, w FROM o),
z AS (SELECT u.series_id, related_id, w[2] AS reason, round_even(w[1]::DOUBLE * (0.6 + 0.4 * rank / (SELECT max(rank) FROM fr)), 4) AS score FROM u JOIN fr ON related_id = fr.series_id)"""


@query(f"WITH {SCORED} SELECT * FROM z")
def score_edges(spark, d):
    return L.score_edges(_edges(spark, d), _rank(spark, d))


@query(f"""WITH {SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY series_id, reason ORDER BY score DESC, related_id) AS r FROM z),
p AS (SELECT series_id, related_id, reason, score, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, related_id)::INTEGER AS pos FROM c WHERE r <= 3) SELECT * FROM p WHERE pos <= 5""")
def related_graph(spark, d):
    return L.capped_top_k(L.score_edges(_edges(spark, d), _rank(spark, d)), 3, 5)


@query(f"""WITH {FX}, y AS (SELECT series_id, year(date)::INTEGER AS year, round(sum(value), 2) AS value FROM fx GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value, year)::INTEGER AS pos FROM y) SELECT * FROM r WHERE pos <= 2""")
def extreme_years(spark, d):
    y = X.nation_series(spark, d).groupBy("series_id", F.year("date").alias("year")).agg(F.round(F.sum("value"), 2).alias("value"))
    return y.withColumn("pos", F.row_number().over(T.Window.partitionBy("series_id").orderBy("value", "year"))).where("pos <= 2")


@query(f"""WITH {FX}, {FT}, y AS (SELECT series_id, year(date)::INTEGER AS year, round(sum(value), 2) AS value FROM fx GROUP BY 1, 2)
SELECT series_id, year, value, lean FROM y LEFT JOIN ft ON make_date(year, 7, 1) >= start AND make_date(year, 7, 1) < "end\"""")
def anchor_date_attribution(spark, d):
    y = X.nation_series(spark, d).groupBy("series_id", F.year("date").alias("year")).agg(F.round(F.sum("value"), 2).alias("value"))
    return J.interval_join(y.withColumn("date", F.make_date("year", F.lit(7), F.lit(1))), X.terms(spark)).select("series_id", "year", "value", "lean")


@query(f"""WITH {FX}, {FT} SELECT series_id, date, value, lean FROM fx LEFT JOIN ft ON (date - INTERVAL 1 YEAR)::DATE >= start AND (date - INTERVAL 1 YEAR)::DATE < "end\"""")
def lag_attribution_join(spark, d):
    fx = X.nation_series(spark, d).withColumn("_lag", F.add_months("date", -12))
    return J.interval_join(fx, X.terms(spark), "_lag").select("series_id", "date", "value", "lean")


@query("""SELECT r_name AS region, n_name AS nation, CASE n_regionkey WHEN 0 THEN 'south' ELSE 'north' END AS half FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)""")
def anti_join(spark, d):
    n = X.table(spark, d, "nation").join(F.broadcast(X.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    low = X.table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    half = F.when(F.col("n_regionkey") == 0, "south").otherwise("north")
    return n.join(low, "n_nationkey", "left_anti").select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), half.alias("half"))
