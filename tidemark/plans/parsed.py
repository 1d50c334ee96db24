"""Registered queries of parsing, classifying and packing, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as C
from tidemark.operators import parsing as P
from tidemark.operators import timeseries as T
from tidemark.sources import tables as X

from .warehouse import FX, query


@query("SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, round(l_extendedprice, 2) AS price FROM lineitem")
def parse_fixed_width(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    line = F.concat(F.lit("01"), F.date_format("l_shipdate", "yyyyMMdd"), F.rpad(F.col("l_orderkey").cast("string"), 12, " "), F.rpad(F.col("l_linenumber").cast("string"), 3, " "), F.lpad(cents, 13, "0"))
    lines = X.table(spark, d, "lineitem").select(line.alias("line"))
    out = P.fixed_width(lines, "line", {"kind": (1, 2, "string"), "d": (3, 8, "string"), "l_orderkey": (11, 12, "long"), "l_linenumber": (23, 3, "int"), "cents": (26, 13, "long")})
    return out.where("kind = '01'").select("l_orderkey", "l_linenumber", F.to_date("d", "yyyyMMdd").alias("day"), (F.col("cents") / 100).alias("price"))


@query(f"WITH {FX} SELECT series_id, make_date(year(date), 12, 31) AS date, round(sum(value), 1) AS value FROM fx WHERE year(date) BETWEEN 1995 AND 2001 GROUP BY ALL")
def melt_periods(spark, d):
    years = [str(y) for y in range(1995, 2002)]
    wide = X.nation_series(spark, d).withColumn("y", F.year("date").cast("string")).groupBy("series_id").pivot("y", years).agg(F.sum("value"))
    text = wide.select("series_id", *[F.coalesce(F.col(y).cast("string"), F.lit("..")).alias(y) for y in years])
    return P.melt_periods(text, ["series_id"], years).select("series_id", C.period_end(F.col("period")).alias("date"), F.round("value", 1).alias("value"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def flatten_json_rows(spark, d):
    return X.table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages")
def strip_html(spark, d):
    return X.table(spark, d, "pages").select("page_id", P.strip_html(F.col("html")).alias("text"))


@query("SELECT event_type || '@' || user_id AS series_id, ts::DATE AS date, year(ts)::INTEGER AS year, value FROM events WHERE value IS NOT NULL AND isfinite(value)")
def conform_schema(spark, d):
    return P.conform(X.table(spark, d, "events"), "value", series_id=F.concat_ws("@", "event_type", F.col("user_id").cast("string")), date=F.to_date("ts"), year=F.year("ts"))


@query("SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'first' WHEN p_brand LIKE 'Brand#2%' THEN 'second' ELSE 'Other' END AS label FROM part")
def prefix_rule(spark, d):
    return X.table(spark, d, "part").select("p_partkey", P.first_rule(F.col("p_brand"), [("^Brand#1", "first"), ("^Brand#2", "second")], "Other").alias("label"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'rings' WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'colours' WHEN contains(p_type, 'ECON') THEN 'economy' ELSE 'Other' END AS topic FROM part")
def keyword_fold(spark, d):
    by_type = P.first_rule(F.col("p_type"), [("ECON", "economy")], "Other")
    by_name = P.first_rule(F.col("p_name"), [("ring", "rings"), ("red|blue", "colours")], "")
    return X.table(spark, d, "part").select("p_partkey", F.when(by_name != "", by_name).otherwise(by_type).alias("topic"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE o_totalprice END AS value FROM orders")
def to_number_coerce(spark, d):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return X.table(spark, d, "orders").select("o_orderkey", text.try_cast("double").alias("value"))


@query("SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS epoch_day, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 25569)::INTEGER AS serial FROM orders")
def epoch_day(spark, d):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    return X.table(spark, d, "orders").select("o_orderkey", day.alias("epoch_day"), (day + 25569).alias("serial"))


@query("SELECT p_partkey, lpad(p_size::VARCHAR, 6, '0') AS code, substr(lpad(p_size::VARCHAR, 6, '0'), 1, 4) AS parent FROM part")
def code_pad(spark, d):
    code = F.lpad(F.col("p_size").cast("string"), 6, "0")
    return X.table(spark, d, "part").select("p_partkey", code.alias("code"), F.substring(code, 1, 4).alias("parent"))


@query("SELECT o_orderkey, round_even(o_totalprice * pow(10.0, 5 - floor(log10(o_totalprice))), 0) / pow(10.0, 5 - floor(log10(o_totalprice))) AS value FROM orders WHERE o_totalprice > 0")
def round_significant(spark, d):
    return X.table(spark, d, "orders").where("o_totalprice > 0").select("o_orderkey", C.significant(F.col("o_totalprice")).alias("value"))


@query(r"SELECT p_partkey, CASE WHEN length(p_name) <= 9 THEN p_name ELSE regexp_replace(substr(p_name, 1, 9), '\s+\S*$', '') || '…' END AS title FROM part")
def truncate_words(spark, d):
    return X.table(spark, d, "part").select("p_partkey", C.cut_words(F.col("p_name"), 9).alias("title"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), c AS (
SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN ('the', 'and', 'of'))) AS l, len(list_filter(w, lambda x: x IN ('de', 'la', 'der'))) AS r FROM w)
SELECT doc_id, n AS n_words, round(1000 * l / n, 6) AS left_rate, round(1000 * r / n, 6) AS right_rate, CASE WHEN l + r > 0 THEN round((l - r) / (l + r), 6) END AS score FROM c WHERE n >= 300""")
def phrase_rate(spark, d):
    out = P.phrase_rates(X.table(spark, d, "documents").select("doc_id", "text"), "text", ["the", "and", "of"], ["de", "la", "der"])
    return out.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("left_rate", "right_rate", "score")])


@query(f"""WITH {FX}, p AS (SELECT series_id, count(*) AS n, string_agg(date_diff('day', DATE '1970-01-01', date)::VARCHAR, ',' ORDER BY date) AS days FROM fx GROUP BY 1)
SELECT series_id, n, days, floor(coalesce(sum(n) OVER (ORDER BY series_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 300)::BIGINT AS chunk FROM p""")
def export_series_chunks(spark, d):
    days = F.array_join(F.transform("points", lambda p: p["day"].cast("string")), ",")
    return P.series_chunks(X.nation_series(spark, d), 300).select("series_id", F.col("n").cast("long").alias("n"), days.alias("days"), "chunk")


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END || ', ' || CASE l_linestatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE l_linestatus END || ', Q' || quarter(l_shipdate) AS labels FROM lineitem""")
def unnest_lookup(spark, d):
    labels = spark.createDataFrame([("A", "accepted"), ("R", "returned"), ("F", "filled"), ("O", "open")], "code string, label string")
    rows = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("|", "l_returnflag", "l_linestatus", F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string"))).alias("codes"))
    return P.unnest_lookup(rows, "codes", labels).drop("codes")


@query("""SELECT c_mktsegment AS segment, c_nationkey AS nation, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS c_custkey FROM customer GROUP BY 1, 2""")
def dedupe_by_priority(spark, d):
    c = X.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    return T.dedupe(c, ["segment", "nation"], [F.desc("c_acctbal"), F.col("c_custkey")]).drop("c_acctbal")
