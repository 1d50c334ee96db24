"""Registered queries of cleaning, coding and classifying, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.functions import scalars as S
from tidemark.operators import timeseries as T
from tidemark.sources import tables as X

from .warehouse import FC, FX, W12, query

text = lambda c: F.col(c).cast("string")


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("SELECT p_partkey, p_name FROM part WHERE p_brand LIKE 'Brand#1%' AND regexp_matches(p_name, 'ring|red') AND p_size BETWEEN 10 AND 40 AND p_type IN ('ECONOMY', 'PROMO', 'STANDARD') AND p_retailprice IS NOT NULL")
def filter_predicates(spark, d):
    p = X.table(spark, d, "part").where(F.col("p_brand").startswith("Brand#1") & F.col("p_name").rlike("ring|red") & F.col("p_size").between(10, 40))
    return p.where(F.col("p_type").isin("ECONOMY", "PROMO", "STANDARD") & F.col("p_retailprice").isNotNull()).select("p_partkey", "p_name")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE END AS date FROM orders")
def parse_dmy(spark, d):
    o = X.table(spark, d, "orders")
    whole, part = F.date_format("o_orderdate", "d/M/yyyy"), F.date_format("o_orderdate", "M/yyyy")
    given = F.when(F.col("o_orderkey") % 3 == 0, whole).when(F.col("o_orderkey") % 3 == 1, part).otherwise(F.lit("n/a"))
    return o.select("o_orderkey", C.dmy(given).alias("date"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE month(o_orderdate) END::INTEGER AS month FROM orders")
def month_name_map(spark, d):
    name = F.get(F.array(*[F.lit(m.lower() + "eiro") for m in C.MONTHS]), F.month("o_orderdate") - 1)
    given = F.when(F.col("o_orderkey") % 7 == 0, F.lit("total")).otherwise(name)
    return X.table(spark, d, "orders").select("o_orderkey", C.month_number(given).alias("month"))


@query(f"WITH {FX} SELECT series_id, date, round(value / day(last_day(date)) / 0.158987, 4) AS rate FROM fx")
def per_day_rate(spark, d):
    return X.nation_series(spark, d).select("series_id", "date", F.round(F.col("value") / C.days_in_month(F.col("date")) / 0.158987, 4).alias("rate"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'wb/' || p_brand WHEN p_type = 'STANDARD' THEN p_name ELSE p_name || '@' || p_type END AS series_id FROM part")
def series_id_build(spark, d):
    lineage = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("dateno:wb/"), "p_brand")).otherwise(F.lit("own"))
    p = X.table(spark, d, "part").withColumns({"lineage": lineage, "entity": F.when(F.col("p_type") == "STANDARD", "BR").otherwise(F.col("p_type"))})
    own = F.when(F.col("entity") == "BR", F.col("p_name")).otherwise(F.concat_ws("@", "p_name", "entity"))
    return p.select("p_partkey", F.when(F.startswith("lineage", F.lit("dateno:wb/")), F.concat(F.lit("wb/"), F.get(F.split("lineage", "wb/"), 1))).otherwise(own).alias("series_id"))


@query("SELECT c_custkey, coalesce(r_name, 'Other') AS label FROM customer LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') ON c_nationkey = n_nationkey")
def dict_lookup(spark, d):
    labels = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'").select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return X.table(spark, d, "customer").join(labels, "c_nationkey", "left").select("c_custkey", F.coalesce("r_name", F.lit("Other")).alias("label"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '''s balance' ELSE split_part(s_name, '#', 1) || ': Share of ' || s_suppkey END AS title FROM supplier")
def clean_title(spark, d):
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("044."), "s_name", F.lit("�s balance"))).otherwise(F.concat(F.lit("12. Share of "), text("s_suppkey")))
    owner = F.concat(F.substring_index("s_name", "#", 1), F.lit(" (group)"))
    return X.table(spark, d, "supplier").select("s_suppkey", C.clean_title(raw, owner).alias("title"))


UNIT_CASES = "CASE p_size % 4 WHEN 0 THEN 'DOD, current US$' WHEN 1 THEN ' thousands ' WHEN 2 THEN p_name ELSE repeat('units ', 20) END"


@query(f"""WITH u AS (SELECT p_partkey, regexp_replace(trim({UNIT_CASES}), '^[A-Z]{{2,4}}, ', '') AS u, regexp_extract_all(p_name || ' (' || p_type || ') (current US$) (' || p_brand || ')', '\\(([^()]*)\\)', 1) AS g FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(u, '{C.UNITS}') AND length(u) <= 60 THEN u END AS unit, list_filter(g, lambda x: regexp_matches(x, '{C.UNITS}'))[-1] AS of_title FROM u""")
def clean_unit(spark, d):
    raw = F.expr("CASE p_size % 4 WHEN 0 THEN 'DOD, current US$' WHEN 1 THEN ' thousands ' WHEN 2 THEN p_name ELSE repeat('units ', 20) END")
    title = F.concat("p_name", F.lit(" ("), "p_type", F.lit(") (current US$) ("), "p_brand", F.lit(")"))
    return X.table(spark, d, "part").select("p_partkey", C.clean_unit(raw).alias("unit"), C.unit_of_title(title).alias("of_title"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (seas. adj.)' ELSE p_name END AS title, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'current US$, millions' ELSE p_type END AS unit FROM part")
def split_title_unit(spark, d):
    raw = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(",current US$, millions,seas. adj.,"))).otherwise(F.concat_ws(",", "p_name", "p_type"))
    title, unit = C.packed_title(raw)
    return X.table(spark, d, "part").select("p_partkey", title.alias("title"), unit.alias("unit"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'by ' || p_type || ' (detailed)' ELSE 'by ' || p_type END AS label FROM part")
def plain_breakdown(spark, d):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("by "), "p_type", F.lit(" - ISIC level 2 -- modelled, Nov. 2025 (thousands)"))).otherwise(F.concat(F.lit("by "), "p_type", F.lit(" (%)")))
    return X.table(spark, d, "part").select("p_partkey", C.breakdown_label(raw).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL ELSE 'EAR_' || upper(p_name[1:3]) || '_KEEP_NB' || CASE WHEN p_size % 3 = 0 THEN '_Q' ELSE '' END END AS family, CASE WHEN p_size % 3 = 2 THEN 0 WHEN p_size % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS n_dims FROM part")
def family_key(spark, d):
    stem = F.upper(F.substring("p_name", 1, 3))
    code = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("ilostat/EAR_"), stem, F.lit("_SEX_KEEP_AGE_NB_Q.A"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("ilostat/EAR_"), stem, F.lit("_KEEP_ECO_NB.A"))).otherwise(F.lit("ilostat/EAR_NB.A"))
    family, dims = C.family_key(code)
    return X.table(spark, d, "part").select("p_partkey", family.alias("family"), F.size(dims).alias("n_dims"))


TOKENS_SQL = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{3,}}'))"


@query(f"""WITH t AS (SELECT p_partkey, {TOKENS_SQL.format("p_name || ' ' || p_type")} AS t FROM part)
SELECT a.p_partkey, len(list_intersect(a.t, b.t))::INTEGER AS shared, list_has_any(list_concat(list_filter(a.t, lambda x: NOT list_contains(b.t, x)), list_filter(b.t, lambda x: NOT list_contains(a.t, x))), ['small', 'large', 'promo']) AS qualified
FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1""")
def token_set_ops(spark, d):
    t = X.table(spark, d, "part").select("p_partkey", S.tokens(F.concat_ws(" ", "p_name", "p_type"), []).alias("t"))
    b = t.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"))
    apart = F.concat(F.array_except("t", "u"), F.array_except("u", "t"))
    return t.join(b, "p_partkey").select("p_partkey", F.size(F.array_intersect("t", "u")).alias("shared"), F.arrays_overlap(apart, F.array(F.lit("small"), F.lit("large"), F.lit("promo"))).alias("qualified"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'PETR' WHEN 1 THEN 'PETR' WHEN 2 THEN 'PRIO' ELSE 'OTHER' END AS entity, 'FIELD ' || s_nationkey AS field FROM supplier")
def classify_regex(spark, d):
    raw = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'Petrobras S.A.' WHEN 1 THEN ' Petróleo Brasileiro' WHEN 2 THEN 'PetroRio Ltda' ELSE concat(s_name, ' Prio') END")
    o = F.lower(F.trim(raw))
    entity = F.when(o.startswith("petrobras") | o.contains("petróleo brasileiro"), "PETR").when(o.rlike(r"^(prio\b|petro\s*rio)"), "PRIO").otherwise("OTHER")
    field = F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.concat(F.lit(" anc_field "), text("s_nationkey"), F.lit("_eco ")))), "^ANC_", ""), "_ECO$", "")
    return X.table(spark, d, "supplier").select("s_suppkey", entity.alias("entity"), field.alias("field"))


RANGES_SQL = ", ".join(f"CASE WHEN {' OR '.join(f"c BETWEEN '{lo}' AND '{hi}'" for lo, hi in v)} THEN '{k}' END" for k, v in C.CODE_GROUPS.items())


@query(f"WITH c AS (SELECT p_partkey, chr(65 + p_size % 26) || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS c FROM part) SELECT p_partkey, c AS code, list_filter([{RANGES_SQL}], lambda x: x IS NOT NULL) AS groups FROM c")
def code_range_match(spark, d):
    code = F.concat(F.char(65 + F.col("p_size") % 26), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    return X.table(spark, d, "part").select("p_partkey", code.alias("code"), C.code_group(F.concat(code, F.lit("9"))).alias("groups"))


@query(f"""WITH {FX}, c AS (SELECT series_id, date, round(value * 100)::BIGINT AS c FROM fx), m AS (SELECT series_id, count(*) AS n, min(date) AS first, max(date) AS last, sum(c)::BIGINT AS total, arg_max(c, date) AS c FROM c GROUP BY 1), e AS (SELECT *, (2 * total + n) // (2 * n) AS mean FROM m)
SELECT series_id, format('{{:d}} points {{}} to {{}}: mean {{:d}}.{{:02d}}, last above it: {{}}', n, strftime(first, '%Y-%m'), strftime(last, '%Y-%m'), mean // 100, mean % 100, CASE WHEN c * n > total THEN 'yes' ELSE 'no' END) AS evidence FROM e""")
def evidence_string(spark, d):
    """Points, months, mean (in whole cents, halves up) and last value against it, as a sentence."""
    rows = X.nation_series(spark, d)
    m = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum(S.cents("value")).alias("total"), F.max_by(S.cents("value"), "date").alias("c"), S.mean_cents("value").alias("mean"))
    above = F.when(F.col("c") * F.col("n") > F.col("total"), "yes").otherwise("no")
    month = lambda c: F.date_format(c, "yyyy-MM")
    said = F.format_string("%d points %s to %s: mean %d.%02d, last above it: %s", "n", month("first"), month("last"), F.expr("mean div 100"), F.col("mean") % 100, above)
    return m.select("series_id", said.alias("evidence"))


@query("""WITH t AS (SELECT DISTINCT 'H' || p_size AS test, lower(p_type) AS m FROM part), r AS (SELECT test, unnest([m || '@PETR', m || '@PRIO', 'brent_usd']) AS series_id FROM t)
SELECT series_id, string_agg(DISTINCT test, ', ' ORDER BY test) AS tests FROM r GROUP BY 1""")
def parse_input_refs(spark, d):
    t = X.table(spark, d, "part").select(F.concat(F.lit("H"), text("p_size")).alias("test"), F.concat(F.lower("p_type"), F.lit("[PETR,PRIO], brent_usd")).alias("inputs")).distinct()
    refs = t.select("test", F.explode(C.input_refs(F.col("inputs"))).alias("series_id"))
    return refs.groupBy("series_id").agg(F.array_join(F.sort_array(F.collect_set("test")), ", ").alias("tests"))


@query(f"""WITH s AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'exports_' || p_type WHEN 1 THEN p_name || '_balance' WHEN 2 THEN p_name WHEN 4 THEN 'wb/NYGDPMKTPSAKD_Q.' || p_partkey WHEN 5 THEN 'wb/DP.DOD.' || p_partkey ELSE 'wb/' || p_partkey END AS sid,
CASE p_size % 6 WHEN 3 THEN 'Imports of ' || p_name ELSE p_name END AS title, CASE WHEN p_size % 4 = 0 THEN 'Price' END AS unit, p_size % 5 = 0 AS yearly, p_size % 6 < 3 AS native FROM part)
SELECT p_partkey, CASE WHEN yearly THEN 'mean' WHEN native THEN CASE WHEN regexp_matches(sid, '{C.FLOWS}') THEN 'sum' WHEN regexp_matches(sid, '{C.STOCKS}') THEN 'last' ELSE 'mean' END WHEN regexp_matches(sid, '{C.DEBT}') THEN 'last' WHEN regexp_matches(sid, '{C.QUARTERLY_GDP}') THEN 'sum'
WHEN regexp_matches(lower(concat_ws(' ', title, unit)), '{C.TRADE}') AND NOT regexp_matches(lower(concat_ws(' ', title, unit)), '{C.PRICED}') THEN 'sum' WHEN regexp_matches(lower(concat_ws(' ', title, unit)), '{C.HELD}') THEN 'last' ELSE 'mean' END AS agg FROM s""")
def agg_rule(spark, d):
    sid = F.expr("CASE p_size % 6 WHEN 0 THEN concat('exports_', p_type) WHEN 1 THEN concat(p_name, '_balance') WHEN 2 THEN p_name WHEN 4 THEN concat('wb/NYGDPMKTPSAKD_Q.', p_partkey) WHEN 5 THEN concat('wb/DP.DOD.', p_partkey) ELSE concat('wb/', p_partkey) END")
    title = F.expr("CASE p_size % 6 WHEN 3 THEN concat('Imports of ', p_name) ELSE p_name END")
    unit = F.when(F.col("p_size") % 4 == 0, "Price")
    return X.table(spark, d, "part").select("p_partkey", C.agg_rule(sid, title, unit, F.col("p_size") % 6 < 3, F.col("p_size") % 5 == 0).alias("agg"))


@query(f"""WITH {FX}, s AS (SELECT series_id, max(date) AS last, (hash_ % 3) AS k FROM (SELECT *, length(series_id) AS hash_ FROM fx) GROUP BY series_id, hash_), a AS (SELECT max(last) AS m FROM s)
SELECT series_id, CASE k WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' ELSE 'yearly' END AS freq, CASE WHEN (m + 150) - last > CASE WHEN series_id = 'NATION_3' THEN 200 WHEN k = 0 THEN 100 WHEN k = 1 THEN 200 ELSE 800 END THEN 'stale' ELSE 'fresh' END AS status FROM s, a""")
def freshness_status(spark, d):
    s = X.nation_series(spark, d).groupBy("series_id").agg(F.max("date").alias("last")).withColumn("freq", F.get(F.array(F.lit("monthly"), F.lit("quarterly"), F.lit("yearly")), F.length("series_id") % 3))
    as_of = F.broadcast(s.agg(F.date_add(F.max("last"), 150).alias("as_of")))  # one row
    most = F.create_map(*[F.lit(x) for x in ("monthly", 100, "quarterly", 200, "yearly", 800)])
    allowed = F.when(F.col("series_id") == "NATION_3", 200).otherwise(F.coalesce(most[F.col("freq")], F.lit(1300)))
    return s.join(as_of, F.lit(True)).select("series_id", "freq", F.when(F.datediff("as_of", "last") > allowed, "stale").otherwise("fresh").alias("status"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'native' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN 'derived'
WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) THEN 'mirror' WHEN c_acctbal > 5000 THEN 'tier2' ELSE 'tier3' END AS class FROM customer""")
def coverage_class(spark, d):
    o = X.table(spark, d, "orders")
    keys = lambda df, key, name: df.select(F.col(key).alias("c_custkey"), F.lit(True).alias(name)).distinct()
    c = X.table(spark, d, "customer").join(keys(o.where("o_orderstatus = 'P'"), "o_custkey", "native"), "c_custkey", "left").join(keys(o.where("o_orderpriority = '1-URGENT'"), "o_custkey", "derived"), "c_custkey", "left")
    c = c.join(keys(X.table(spark, d, "supplier"), "s_suppkey", "mirror"), "c_custkey", "left")
    return c.select("c_custkey", F.when(F.col("native"), "native").when(F.col("derived"), "derived").when(F.col("mirror"), "mirror").when(F.col("c_acctbal") > 5000, "tier2").otherwise("tier3").alias("class"))


@query(f"WITH {FX} SELECT series_id, date, round(ln(1 + value), 8) AS log1p, round(exp(ln(value) / 10), 8) AS root, round(100 * (ln(value) - ln(lag(value) {W12})), 6) AS growth, round(value * pow(10, -3), 6) AS scaled FROM fx")
def log_math(spark, d):
    v = F.col("value")
    growth = 100 * (F.log(v) - F.log(F.lag("value").over(T.by())))
    return X.nation_series(spark, d).select("series_id", "date", F.round(F.log1p(v), 8).alias("log1p"), F.round(F.exp(F.log(v) / 10), 8).alias("root"), (F.round(growth, 6)).alias("growth"), F.round(v * F.pow(F.lit(10.0), F.lit(-3)), 6).alias("scaled"))


@query(f"""WITH {FX}, s AS (SELECT series_id, count(*) AS n, corr(value, month(date)) AS r FROM fx WHERE value > 500000 GROUP BY 1)
SELECT series_id, n, round(abs(r), 6) AS statistic, CASE WHEN r IS NULL OR n < 20 THEN 'Insufficient data' WHEN abs(r) >= 0.15 THEN 'Supported' WHEN abs(r) >= 0.05 THEN 'Mixed' ELSE 'Not supported' END AS verdict FROM s""")
def verdict_rule(spark, d):
    s = X.nation_series(spark, d).where("value > 500000").groupBy("series_id").agg(F.count("*").alias("n"), F.abs(F.corr("value", F.month("date"))).alias("statistic"))
    return s.select("series_id", "n", F.round("statistic", 6).alias("statistic"), C.verdict(F.col("statistic"), 0.15, 0.05, F.col("n") >= 20).alias("verdict"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_quantity * 1000 WHEN 1 THEN l_quantity ELSE round(l_quantity * 0.158987, 6) END AS tonnes FROM lineitem")
def unit_convert(spark, d):
    unit = F.get(F.array(F.lit("thousand tonnes"), F.lit("tonnes"), F.lit("boe")), (F.col("l_linenumber") % 3).cast("int"))
    q = F.col("l_quantity")
    value = F.when(unit == "thousand tonnes", q * 1000).when(unit == "tonnes", q).when(unit == "boe", F.round(q * 0.158987, 6)).otherwise(F.raise_error(F.lit("unknown unit")).cast("double"))
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("tonnes"))


@query("SELECT l_orderkey, l_linenumber, year(o_orderdate)::INTEGER AS made, year(l_shipdate)::INTEGER AS ref FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(l_shipdate) = year(o_orderdate) + 1")
def next_period_forecast(spark, d):
    both = X.table(spark, d, "lineitem").join(X.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("made")), "l_orderkey").withColumn("ref", F.year("l_shipdate"))
    return both.where("ref = made + 1").select("l_orderkey", "l_linenumber", "made", "ref")


@query(f"WITH {FX}, m AS (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m FROM fx) SELECT series_id, date, round(greatest(0, 400000 - value) / 10, 4) + 0.0 AS shock, round((value - m) / 1000, 5) + 0.0 AS centred FROM m")
def shock_transform(spark, d):
    centred = (F.col("value") - F.avg("value").over(T.every())) / 1000
    return X.nation_series(spark, d).select("series_id", "date", (F.round(F.greatest(F.lit(0.0), 400000 - F.col("value")) / 10, 4) + F.lit(0.0)).alias("shock"), (F.round(centred, 5) + F.lit(0.0)).alias("centred"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND year(o_orderdate) < 1998 THEN 'OLD' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'TOP' WHEN o_orderpriority = '5-LOW' THEN 'REST' ELSE o_orderpriority END AS label FROM orders""")
def alias_normalise(spark, d):
    # the aliases come from the orders' own labels; one exception holds before a year
    labels = X.table(spark, d, "orders").select("o_orderpriority").distinct()
    alias = labels.withColumn("alias", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "TOP").when(F.col("o_orderpriority") == "5-LOW", "REST")).where("alias is not null")
    o = X.table(spark, d, "orders").join(alias, "o_orderpriority", "left")
    early = (F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") < 1998)
    return o.select("o_orderkey", F.when(early, "OLD").otherwise(F.coalesce("alias", "o_orderpriority")).alias("label"))


@query("""WITH m AS (SELECT p_partkey, p_size, unnest([p_name, p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END]) AS member FROM part) SELECT p_partkey, member FROM m WHERE member IS NOT NULL AND NOT (member LIKE 'Brand#1%' AND p_size > 25)""")
def split_list_field(spark, d):
    raw = F.concat("p_name", F.lit(" (left 1999) / "), "p_brand", F.lit("[1] ;"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_type", F.lit(" "))).otherwise(F.lit("  ")))
    rows = X.table(spark, d, "part").select("p_partkey", "p_size", F.explode(C.members_of(raw)).alias("member"))
    return rows.where(~(F.col("member").startswith("Brand#1") & (F.col("p_size") > 25))).select("p_partkey", "member")


@query(f"WITH {FC}, {FX}, s AS (SELECT series_id, topic, agg FROM fc) SELECT series_id, topic, agg, 'n/' || series_id AS id FROM s WHERE agg <> 'last' AND EXISTS (SELECT 1 FROM fx WHERE fx.series_id = s.series_id)")
def semi_join(spark, d):
    return X.catalogue(spark, d).where("agg <> 'last'").join(X.nation_series(spark, d).select("series_id").distinct(), "series_id", "left_semi").select("series_id", "topic", "agg", F.concat(F.lit("n/"), "series_id").alias("id"))
