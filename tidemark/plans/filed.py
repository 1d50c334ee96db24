"""Registered queries of readers and writers: each writes files derived from the given tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import timeseries as T
from tidemark.sources import files as B
from tidemark.sources import replacing as R
from tidemark.sources import tables as X

from .warehouse import FC, FX, W12, query


@query("""SELECT event_type AS metric, CASE WHEN user_id % 5 = 0 THEN 'BR' ELSE 'U' || user_id END AS entity_id, ts::DATE AS date, round(value, 2) AS value, year(ts)::INTEGER AS year FROM events WHERE value IS NOT NULL""")
def read_long_csv(spark, d):
    path = B.shared_folder(spark)
    entity = F.when(F.col("user_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("U"), F.col("user_id").cast("string")))
    X.table(spark, d, "events").select(F.col("event_type").alias("metric"), entity.alias("entity_id"), F.to_date("ts").alias("date"), F.round("value", 2).alias("value")).write.option("header", True).csv(path)
    return B.read_long_csv(spark, path, "metric string, entity_id string, date date, value double")


@query(f"WITH {FX}, {FC} SELECT series_id, topic, make_date(year(date), 12, 31) AS date, year(date)::INTEGER AS year, round(sum(value), 2) AS value FROM fx JOIN fc USING (series_id) GROUP BY ALL")
def read_annual_export(spark, d):
    path = B.shared_folder(spark)
    yearly = X.nation_series(spark, d).groupBy(F.col("series_id").alias("series"), F.year("date").alias("year")).agg(F.round(F.sum("value"), 2).alias("value"))
    # one folder a series, as exports come
    yearly.repartition("series").write.partitionBy("series").option("header", True).csv(path)
    return B.read_exports(spark, path, "year int, value double", X.catalogue(spark, d).select("series_id", "topic")).select("series_id", "topic", "date", "year", "value")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_quantity < 10 AND l_returnflag = 'R'")
def scan_parquet_pruned(spark, d):
    return X.table(spark, d, "lineitem").where("l_shipdate >= date'1998-01-01' and l_quantity < 10 and l_returnflag = 'R'").select("l_orderkey", "l_quantity")


@query("SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def read_dim_csv(spark, d):
    path = B.shared_folder(spark)
    X.table(spark, d, "nation").write.option("header", True).csv(path)
    dim = spark.read.schema("n_nationkey int, n_name string, n_regionkey int").option("header", True).csv(path)
    return X.table(spark, d, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")


@query("SELECT r_name AS tier, 'm' || n_nationkey AS metric, n_name AS source, CASE WHEN n_nationkey % 2 = 0 THEN 'index' END AS unit FROM nation JOIN region ON n_regionkey = r_regionkey")
def registry_dim(spark, d):
    path = B.shared_folder(spark)
    n = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    unit = F.when(F.col("n_nationkey") % 2 == 0, F.lit(", unit: index")).otherwise(F.lit(""))
    line = F.concat(F.lit("  m"), F.col("n_nationkey").cast("string"), F.lit(": {source: "), F.col("n_name"), unit, F.lit("}"))
    blocks = n.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    blocks.select(F.concat("r_name", F.lit(":\n"), "lines").alias("value")).write.text(path)
    return B.read_registry(spark, path)


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, 'São ' || o_orderpriority AS label FROM orders")
def read_locale_delimited(spark, d):
    path = B.shared_folder(spark)
    price = F.translate(F.format_number(F.col("o_totalprice"), 2), ",.", ".,")
    out = X.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias(" o_orderkey"), price.alias(" price "), F.concat(F.lit("São "), "o_orderpriority").alias("label "))
    out.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return B.read_locale(spark, path, ["price"]).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "price", "label")


@query(f"WITH {FX} SELECT strftime(date, '%Y/%m') AS PERIOD, series_id AS ITEM, round(value, 2) AS VALUE FROM fx")
def read_drifting_header(spark, d):
    path = B.shared_folder(spark)
    fx = X.nation_series(spark, d).withColumns({"year": F.year("date"), "p": F.date_format("date", "yyyy/MM"), "v": F.format_string("%.2f", "value")})
    turned = F.col("year") % 2 == 0
    row = F.when(turned, F.concat_ws(";", F.lit("x"), "v", "series_id", "p")).otherwise(F.concat_ws(" ; ", "p", "series_id", "v"))
    head = F.when(turned, F.lit("note\n\nno;VALUE;ITEM;PERIOD")).otherwise(F.lit("a report;of;things\nPERIOD ; ITEM ; VALUE\n(units)"))
    lines = fx.groupBy("year").agg(F.concat(F.first(head), F.lit("\n"), F.array_join(F.collect_list(row), "\n"), F.lit("\ntotal;;")).alias("value"))
    lines.select("value").repartition(8).write.text(path)
    out = B.read_drifting(spark, path, ["PERIOD", "ITEM", "VALUE"])
    return out.select("PERIOD", "ITEM", F.col("VALUE").cast("double").alias("VALUE"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate::DATE AS day, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderpriority, o_orderkey) AS k FROM orders)
SELECT o_custkey, day, o_orderkey, round(o_totalprice, 2) AS price FROM o WHERE k = 1""")
def flatten_json_nested(spark, d):
    o = X.table(spark, d, "orders")
    item = F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("call"))
    payload = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(item).alias("rows"))).alias("payload"))
    flat = payload.select("o_custkey", F.explode(F.from_json("payload", "rows array<struct<k: bigint, price: double, day: date, call: string>>")["rows"]).alias("r")).select("o_custkey", "r.*")
    return T.dedupe(flat, ["o_custkey", "day"], [F.col("call"), F.col("k")]).select("o_custkey", "day", F.col("k").alias("o_orderkey"), F.round("price", 2).alias("price"))


@query("SELECT s_nationkey, s_suppkey AS \"key\", round(s_acctbal, 2) AS bal, s_name || ' & <co>' AS name FROM supplier")
def flatten_xml_items(spark, d):
    name = F.concat("s_name", F.lit(" &amp; &lt;co&gt;"))
    item = F.concat(F.lit('<item key="'), F.col("s_suppkey").cast("string"), F.lit('" bal="'), F.format_string("%.2f", "s_acctbal"), F.lit('">'), name, F.lit("</item>"))
    xml = X.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("<items>"), F.array_join(F.collect_list(item), ""), F.lit("</items>")).alias("xml"))
    escaped = xml.withColumn("xml", F.replace(F.replace(F.replace("xml", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")))
    rows = escaped.select("s_nationkey", F.explode(B.xml_items(F.col("xml"), "item array<struct<_VALUE: string, _key: bigint, _bal: double>>", unescape=True)["item"]).alias("i"))
    return rows.select("s_nationkey", F.col("i._key").alias("key"), F.col("i._bal").alias("bal"), F.col("i._VALUE").alias("name"))


@query(f"""WITH {FX}, y AS (SELECT series_id, year(date)::INTEGER AS year, count(*) AS n FROM fx GROUP BY 1, 2) SELECT series_id, year, 'M&' || month(date) AS label, floor(value)::BIGINT AS value, n = 12 AS whole FROM fx JOIN y ON fx.series_id = y.series_id AND year(date) = y.year""".replace("SELECT series_id, year, 'M&'", "SELECT fx.series_id, y.year, 'M&'"))
def extract_html_table(spark, d):
    fx = X.nation_series(spark, d).withColumns({"year": F.year("date"), "line": F.concat(F.lit('"M&amp;'), F.month("date").cast("string"), F.lit('";'), F.floor("value").cast("string"))})
    pages = fx.groupBy("series_id", "year").agg(F.concat(F.lit("<html><PRE>\nhead;x\n"), F.array_join(F.collect_list("line"), "\n"), F.lit('\n"Total";999\n</PRE></html>')).alias("html"))
    rows = pages.withColumn("rows", B.pre_table(F.col("html"))).withColumn("whole", F.size("rows") == 12)
    return rows.select("series_id", "year", "whole", F.inline("rows"))


@query("SELECT p_partkey, coalesce(nullif(p_type, 'STANDARD'), p_brand) AS title, p_size::VARCHAR AS size FROM part")
def kv_metadata(spark, d):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    kind = F.when(F.col("p_type") != "STANDARD", F.col("p_type")).otherwise(F.lit(" "))
    pairs = F.array(pair("brand", F.col("p_brand")), pair("title", F.lit(None).cast("string")), pair("title", kind), pair("size", F.col("p_size").cast("string")), pair("size", F.lit("0")))
    return B.first_of_pairs(X.table(spark, d, "part").select("p_partkey", pairs.alias("pairs")), ["p_partkey"], "pairs", {"title": ["title", "brand"], "size": ["size"]})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def semi_filter_scan(spark, d):
    wanted = X.table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return X.table(spark, d, "lineitem").join(wanted, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"WITH {FX}, l AS (SELECT series_id, date, value - lag(value) {W12} AS value FROM fx) SELECT series_id, date, round(value, 2) AS value FROM l WHERE value IS NOT NULL")
def write_bronze(spark, d):
    path = B.shared_folder(spark)
    fx = X.nation_series(spark, d)
    change = fx.select("series_id", "date", F.round(F.col("value") - F.lag("value").over(T.by()), 2).alias("value"))
    B.write_bronze(change, path, ["series_id", "date", "value"], ["series_id", "date"])
    return spark.read.parquet(path)


@query("""WITH m AS (SELECT event_type, strftime(ts, '%Y%m%d') AS period, ts::DATE AS day, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, day, total, n, period >= '20240120' AS revised FROM m""")
def upsert_partitions(spark, d):
    """Daily totals written up to a day, of which the last days lacked events; then the days that are lacking, and the last three again."""
    path = B.shared_folder(spark)
    events = X.table(spark, d, "events").withColumns({"day": F.to_date("ts"), "period": F.date_format("ts", "yyyyMMdd")})
    totals = lambda df: df.groupBy("event_type", "period", "day").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))
    R.upsert(totals(events.where("day <= date'2024-01-22'").where("day < date'2024-01-20' or hour(ts) < 12")).withColumn("revised", F.lit(False)), path, ["event_type", "day"], ["period"])
    # what a new fetch up to a later day gives: the days of the table that it repeats stay, but for those refreshed
    late = totals(events.where("day >= date'2024-01-20'")).withColumn("revised", F.lit(True))
    R.upsert(late.where("day <= date'2024-01-22'"), path, ["event_type", "day"], ["period"])
    R.upsert(R.refresh(spark, late, path, "period", 3), path, ["event_type", "day"], ["period"])
    return spark.read.parquet(path).select("event_type", "day", "total", "n", "revised")


@query("SELECT s_suppkey, round(s_acctbal + 1, 2) AS s_acctbal, strftime(DATE '2001-03-05' + s_nationkey::INTEGER, '%Y-%m-%d') AS date FROM supplier")
def replace_table(spark, d):
    """A table replaced by one that is worked out from itself."""
    path = B.shared_folder(spark)
    s = X.table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.date_add(F.lit("2001-03-05").cast("date"), F.col("s_nationkey")).alias("date"))
    B.write_bronze(s, path, ["s_suppkey"], ["s_suppkey"], "s_acctbal", ["date"])
    R.replace_table(spark.read.parquet(path).withColumn("s_acctbal", F.round(F.col("s_acctbal") + 1, 2)), path)
    return spark.read.parquet(path)


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders GROUP BY 1")
def write_table(spark, d):
    path = B.shared_folder(spark)
    X.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


@query("SELECT c_custkey::INTEGER AS id, c_name AS name, NULL::DOUBLE AS weight, c_acctbal::FLOAT AS bal FROM customer")
def write_typed(spark, d):
    path = B.shared_folder(spark)
    schema = spark.createDataFrame([], "id int, name string, weight double, bal float").schema
    B.write_typed(X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), "c_mktsegment"), path, schema)
    return spark.read.parquet(path)


@query(f"""WITH {FX}, k AS (SELECT series_id, dense_rank() OVER (ORDER BY series_id) - 1 AS i FROM (SELECT DISTINCT series_id FROM fx))
SELECT i::INTEGER AS i, series_id, count(*) AS n, min(date) AS first, max(date) AS last FROM fx JOIN k USING (series_id) GROUP BY ALL""")
def export_catalog_records(spark, d):
    """A record a series as JSON, by number, read back."""
    path = B.shared_folder(spark)
    stats = X.nation_series(spark, d).groupBy("series_id").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    records = B.sum_before(stats.withColumn("one", F.lit(1)), "series_id", "one", "i").withColumn("i", F.col("i").cast("int"))
    records.select(F.to_json(F.struct("i", F.struct("series_id", "n", "first", "last").alias("r"))).alias("value")).write.text(path)
    back = spark.read.schema("i int, r struct<series_id: string, n: bigint, first: date, last: date>").json(path)
    return back.select("i", "r.*")


@query("""SELECT p_brand, p_type, p_size::VARCHAR AS member, count(*) AS n, round(sum(p_retailprice), 2) AS value FROM part GROUP BY ALL""")
def export_dims_nested(spark, d):
    """Per brand: lists of the codes of each dimension, and rows of their numbers with values; read back through the codes."""
    path = B.shared_folder(spark)
    cells = X.table(spark, d, "part").groupBy("p_brand", "p_type", F.col("p_size").cast("string").alias("member")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("value"))
    codes = cells.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"), F.array_sort(F.collect_set("member")).alias("members"))
    at = lambda list_, c: (F.array_position(list_, F.col(c)) - 1).cast("int")
    rows = cells.join(codes, "p_brand").select("p_brand", F.struct(at("types", "p_type").alias("t"), at("members", "member").alias("m"), "n", "value").alias("r"))
    nested = rows.groupBy("p_brand").agg(F.collect_list("r").alias("rows")).join(codes, "p_brand")
    nested.select(F.to_json(F.struct("p_brand", "types", "members", "rows")).alias("value")).write.text(path)
    back = spark.read.schema("p_brand string, types array<string>, members array<string>, rows array<struct<t: int, m: int, n: bigint, value: double>>").json(path)
    return back.select("p_brand", "types", "members", F.explode("rows").alias("r")).select("p_brand", F.get("types", F.col("r.t")).alias("p_type"), F.get("members", F.col("r.m")).alias("member"), "r.n", "r.value")


@query(f"""WITH {FX}, {FC}, s AS (SELECT series_id, topic, count(*) AS n, min(date) AS first, max(date) AS last FROM fx JOIN fc USING (series_id) GROUP BY ALL)
SELECT topic, count(*) AS series, sum(n)::BIGINT AS obs, min(year(first))::INTEGER AS first_year, least(max(year(last)), 2000)::INTEGER AS last_year FROM s GROUP BY 1""")
def build_facts(spark, d):
    s = X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d)), "series_id").groupBy("series_id", "topic").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    return s.groupBy("topic").agg(F.count("*").alias("series"), F.sum("n").alias("obs"), F.min(F.year("first")).alias("first_year"), F.least(F.max(F.year("last")), F.lit(2000)).alias("last_year"))
