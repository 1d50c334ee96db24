"""Registered queries of catalogues, related series and composed metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import joins as J
from tidemark.operators import regression as G
from tidemark.operators import relating as E
from tidemark.operators import rollups as U
from tidemark.operators import timeseries as T
from tidemark.sources import files as B
from tidemark.sources import tables as X

from .sampled import ols2_sql
from .warehouse import FC, FT, FX, W12, query


def r(df, places, *columns):
    """Rounded, with minus zero as zero."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


FAMILY = "concat_ws('/', p_brand, p_type, p_size)"
FAMILY_SQL = f"""fm AS (SELECT p_partkey AS id, {FAMILY} AS f, count(*) OVER (PARTITION BY {FAMILY}) AS n, row_number() OVER (PARTITION BY {FAMILY} ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part),
fe AS (SELECT a.id AS a, b.id AS b, 'family' AS reason, 0.8::DOUBLE AS strength FROM fm a JOIN fm b ON a.f = b.f AND a.id <> b.id WHERE a.n BETWEEN 2 AND 60 AND b.pos <= 4)"""


def _family(spark, d):
    return E.family_edges(X.table(spark, d, "part"), F.expr(FAMILY), "p_partkey", "p_retailprice")


@query(f"WITH {FAMILY_SQL} SELECT * FROM fe")
def edges_family(spark, d):
    return _family(spark, d)


#: Tokens of so many texts or more link nobody, where a query's SQL says so.
COMMON = 400
TEXT_SQL = """tw AS (SELECT DISTINCT p_partkey AS id, p_brand AS t, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{3,}')) AS w FROM part), td AS (SELECT w, count(*) AS df, ln((SELECT count(DISTINCT id) FROM tw) / (1 + count(*))) AS idf FROM tw GROUP BY 1),
tn AS (SELECT id, sqrt(sum(idf * idf)) AS norm FROM tw JOIN td USING (w) GROUP BY 1), tr AS (SELECT * FROM tw JOIN td USING (w) WHERE df < 400),
ts AS (SELECT a.id AS a, b.id AS b, sum(a.idf) AS s FROM tr a JOIN tr b ON a.t = b.t AND a.w = b.w AND a.id <> b.id GROUP BY 1, 2), tc AS (SELECT a, b, round(s / (x.norm * y.norm), 9) AS c FROM ts JOIN tn x ON x.id = a JOIN tn y ON y.id = b),
te AS (SELECT a, b, 'text' AS reason, c AS strength FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b DESC) AS k FROM tc WHERE c >= 0.35) WHERE k <= 4)"""

ALL_TEXT_SQL = TEXT_SQL.replace(" WHERE df < 400", "")


def _texts(part, common=COMMON):
    return E.text_edges(part, "p_partkey", "p_brand", F.col("tokens"), common)


def _parts(spark, d):
    """Parts with their tokens, in as many files as tasks can work on."""
    return E.spread(X.table(spark, d, "part"), "p_partkey", stale=F.col("p_size") > 40, tokens=S.tokens(F.concat_ws(" ", "p_name", "p_type"), []))


@query(f"WITH {TEXT_SQL} SELECT a, b, reason, round(strength, 6) AS strength FROM te")
def edges_text(spark, d):
    return _texts(_parts(spark, d)).withColumn("strength", F.round("strength", 6))


NEIGHBOR_SQL = """nl AS (SELECT a AS id, count(*) AS links FROM fe GROUP BY 1), nr AS (SELECT p_type, p_brand, p_partkey AS id, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part),
ne AS (SELECT a, b, 'neighbor' AS reason, 0.8::DOUBLE AS strength FROM (SELECT x.id AS a, y.id AS b, row_number() OVER (PARTITION BY x.id ORDER BY y.k) AS p FROM nr x LEFT JOIN nl USING (id) JOIN nr y ON x.p_type = y.p_type AND x.p_brand = y.p_brand AND y.k <= 6 AND x.id <> y.id WHERE coalesce(links, 0) < 3) WHERE p <= 4)"""


@query(f"WITH {FAMILY_SQL}, {NEIGHBOR_SQL} SELECT * FROM ne")
def edges_neighbor(spark, d):
    return E.neighbor_edges(X.table(spark, d, "part"), _family(spark, d), "p_partkey", ["p_type", "p_brand"], "p_retailprice")


RELATED = f"""{FAMILY_SQL}, {TEXT_SQL}, {NEIGHBOR_SQL}, re AS (SELECT * FROM fe UNION ALL SELECT * FROM te UNION ALL SELECT * FROM ne), rw AS (SELECT *, CASE reason WHEN 'family' THEN 0.55 WHEN 'text' THEN 0.45 ELSE 0.3 END * strength AS w FROM re),
ro AS (SELECT a, b, arg_max(reason, (w, reason)) AS reason, max(w) AS w FROM rw GROUP BY 1, 2), rs AS (SELECT a, b, reason, p_type, round(w * (0.6 + 0.4 * p_retailprice / (SELECT max(p_retailprice) FROM part)) * CASE WHEN p_size > 40 THEN 0.85 ELSE 1.0 END, 4) AS score FROM ro JOIN part ON p_partkey = b),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, reason ORDER BY score DESC, b) AS p FROM rs) WHERE p <= CASE reason WHEN 'neighbor' THEN 4 ELSE 3 END), r2 AS (SELECT * FROM (SELECT a, b, reason, score, row_number() OVER (PARTITION BY a, p_type ORDER BY score DESC, b) AS p FROM r1) WHERE p <= 5),
rr AS (SELECT a AS series_id, b AS related_id, reason, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INTEGER AS pos FROM r2) WHERE pos <= 10)"""

ALL_RELATED = RELATED.replace(TEXT_SQL, ALL_TEXT_SQL)


def _related(spark, d, common=COMMON):
    part = _parts(spark, d)
    family = B.materialize(E.family_edges(part, F.expr(FAMILY), "p_partkey", "p_retailprice"))  # used twice
    edges = B.materialize(family.unionByName(_texts(part, common)).unionByName(E.neighbor_edges(part, family, "p_partkey", ["p_type", "p_brand"], "p_retailprice")))
    return E.related(edges, part, "p_partkey", "p_retailprice", "p_type", "stale", {"family": 0.55, "text": 0.45, "neighbor": 0.3}, {"family": 3, "text": 3, "neighbor": 4}, 5, 10)


@query(f"WITH {RELATED} SELECT * FROM rr")
def related_series(spark, d):
    return _related(spark, d)


@query(f"WITH {ALL_RELATED} SELECT series_id, pos, related_id, p_name AS related_title, p_type AS related_dataset, reason, score FROM rr JOIN part ON p_partkey = related_id")
def v_related(spark, d):
    titles = X.table(spark, d, "part").select(F.col("p_partkey").alias("related_id"), F.col("p_name").alias("related_title"), F.col("p_type").alias("related_dataset"))
    n = 10 * titles.count()
    return E.dealt(_related(spark, d, None), n, "related_id").join(E.dealt(titles, n, "related_id"), "related_id").select("series_id", "pos", "related_id", "related_title", "related_dataset", "reason", "score")


@query(f"WITH {RELATED}, i AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) SELECT x.i::INTEGER AS i, count(*) AS n, string_agg(y.i || ':' || upper(reason[1]), ' ' ORDER BY pos) AS list FROM rr JOIN i x ON x.p_partkey = series_id JOIN i y ON y.p_partkey = related_id GROUP BY 1")
def export_related_json(spark, d):
    ids = X.table(spark, d, "part").select("p_partkey", F.lit(1).alias("one"))
    numbers = B.sum_before(ids, "p_partkey", "one", "i").select("p_partkey", F.col("i").cast("int").alias("i"))
    side = lambda key, name: numbers.select(F.col("p_partkey").alias(key), F.col("i").alias(name))
    n = 10 * ids.count()
    e = E.dealt(E.dealt(_related(spark, d), n, "related_id").join(E.dealt(side("related_id", "j"), n, "related_id"), "related_id"), n, "series_id")
    item = F.concat(F.col("j").cast("string"), F.lit(":"), F.upper(F.substring("reason", 1, 1)))
    lists = e.groupBy("series_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", item.alias("x")))).alias("l"))
    lists = lists.join(E.dealt(side("series_id", "i"), n, "series_id"), "series_id")
    return lists.select("i", "n", F.array_join(F.transform("l", lambda s: s["x"]), " ").alias("list"))


@query(f"""WITH rl AS (SELECT r_name AS label, n_nationkey AS entity, c_custkey AS series_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 8000), hd AS (SELECT s_nationkey AS entity, 100000000 + s_suppkey AS head, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k, s_acctbal > 5000 AS main FROM supplier)
SELECT series_id AS a, head AS b, 'company' AS reason, CASE WHEN main THEN 1.0 ELSE 0.85 END::DOUBLE AS strength FROM rl JOIN hd USING (entity) WHERE k <= 3 UNION ALL SELECT head, series_id, 'company', 0.9 FROM rl JOIN hd USING (entity) WHERE k <= 3""")
def bridge_join(spark, d):
    rules = X.table(spark, d, "customer").where("c_acctbal > 8000").select(F.lit("x").alias("label"), F.col("c_nationkey").alias("entity"), F.col("c_custkey").alias("series_id"))
    heads = X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("entity"), (F.col("s_suppkey") + 100000000).alias("head"), (-F.col("s_acctbal")).alias("pos"), (F.col("s_acctbal") > 5000).alias("main"))
    return E.bridge_edges(rules, heads)


@query("""WITH s AS (SELECT 'wb/' || p_name || '_' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '_M' ELSE '' END AS id, min(p_partkey) AS k FROM part GROUP BY 1) SELECT id, k FROM s WHERE NOT EXISTS (SELECT 1 FROM s m WHERE m.id = s.id || '_M')""")
def annual_copy_of_monthly(spark, d):
    part = X.table(spark, d, "part")
    ids = part.groupBy(F.concat(F.lit("wb/"), "p_name", F.lit("_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "_M").otherwise("")).alias("id")).agg(F.min("p_partkey").alias("k"))
    monthly = ids.where(F.col("id").endswith("_M")).select(F.regexp_replace("id", "_M$", "").alias("id"))
    return ids.join(monthly, "id", "left_anti")


@query(f"""WITH {FX}, {FC}, p AS (SELECT a.series_id AS canonical, b.series_id AS alternate FROM (SELECT topic, min(series_id) AS series_id FROM fc GROUP BY 1) a JOIN fc b ON a.topic = b.topic AND b.agg = 'sum' AND a.series_id <> b.series_id)
SELECT series_id, CASE WHEN series_id IN (SELECT alternate FROM p) THEN 'alternate' WHEN series_id IN (SELECT canonical FROM p) THEN 'canonical' ELSE 'single' END AS role, topic AS concept FROM fc""")
def assign_roles(spark, d):
    cat = X.catalogue(spark, d).select("series_id", "topic", "agg")
    first = cat.groupBy("topic").agg(F.min("series_id").alias("canonical"))
    pairs = cat.where("agg = 'sum'").join(first, "topic").where("series_id <> canonical")
    flag = lambda c, name: pairs.select(F.col(c).alias("series_id"), F.lit(True).alias(name)).distinct()
    out = cat.join(flag("series_id", "alt"), "series_id", "left").join(flag("canonical", "can"), "series_id", "left")
    return out.select("series_id", F.when(F.col("alt"), "alternate").when(F.col("can"), "canonical").otherwise("single").alias("role"), F.col("topic").alias("concept"))


@query("SELECT CASE WHEN s_suppkey IS NOT NULL THEN c_custkey || '_annual' ELSE c_custkey::VARCHAR END AS id, CASE WHEN s_suppkey IS NOT NULL THEN c_name || ' (annual)' ELSE c_name END AS title FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def native_overlap_rename(spark, d):
    own = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit(True).alias("native"))
    c = X.table(spark, d, "customer").join(own, "c_custkey", "left")
    key = F.col("c_custkey").cast("string")
    return c.select(F.when(F.col("native"), F.concat(key, F.lit("_annual"))).otherwise(key).alias("id"), F.when(F.col("native"), F.concat("c_name", F.lit(" (annual)"))).otherwise(F.col("c_name")).alias("title"))


WIDE = """wd AS (SELECT date, max(value) FILTER (WHERE series_id = 'NATION_0') AS a, max(value) FILTER (WHERE series_id = 'NATION_1') AS b, max(value) FILTER (WHERE series_id = 'NATION_2') AS c FROM fx GROUP BY 1)"""


def _wide(spark, d):
    one = lambda k: F.max(F.when(F.col("series_id") == f"NATION_{k}", F.col("value"))).alias("abc"[k])
    return X.nation_series(spark, d).where(F.col("series_id").isin("NATION_0", "NATION_1", "NATION_2")).groupBy("date").agg(one(0), one(1), one(2))


@query(f"""WITH {FX}, {WIDE}, l AS (SELECT *, lag(a, 12) OVER (ORDER BY date) AS a12 FROM wd), x AS (SELECT date, unnest(['flipped', 'difference', 'yoy', 'product', 'index', 'share', 'ratio_to_sum', 'level_by_rate']) AS series_id,
unnest([-a, a - b, 100 * (a / a12 - 1), a * b / 1e6, 0.5 * (100 - a / 1e5) + 0.5 * b / 1e5, 100 * a / b, a / (b + c), a / c]) AS value FROM l) SELECT series_id, date, round(value, 6) + 0.0 AS value FROM x WHERE value IS NOT NULL""")
def derived_series(spark, d):
    """Series made of series at their common dates: a rule is a name and an expression of the inputs' columns."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rules = {
        "flipped": -a, "difference": a - b, "yoy": 100 * (a / F.lag("a", 12).over(Window.orderBy("date")) - 1), "product": a * b / 1e6,
        "index": 0.5 * (100 - a / 1e5) + 0.5 * b / 1e5, "share": 100 * a / b, "ratio_to_sum": a / (b + c), "level_by_rate": a / c,
    }
    return r(T.derived(_wide(spark, d), rules), 6, "value")


@query(f"WITH {FX}, {WIDE} SELECT count(*) AS n, round(avg(a), 3) AS a, round(avg(b), 3) AS b, round(avg(c), 3) AS c, min(date) AS first, max(date) AS last FROM wd WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def align_inner(spark, d):
    w = _wide(spark, d).dropna()
    return r(w.agg(F.count("*").alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg("c").alias("c"), F.min("date").alias("first"), F.max("date").alias("last")), 3, "a", "b", "c")


METRICS = f"""lt AS (SELECT series_id, max(date) AS date, arg_max(value, date) AS value, count(*) AS n FROM fx GROUP BY 1), dm AS (SELECT topic, any_value(l0.value) FILTER (WHERE agg = 'sum') AS s, count(*) FILTER (WHERE agg = 'last') AS k, max(l0.date) AS date, max(l0.value) FILTER (WHERE agg = 'last') AS debt, max(l0.value) FILTER (WHERE agg = 'sum') AS flow, max(l0.value) FILTER (WHERE agg = 'mean') AS rate FROM lt l0 JOIN fc USING (series_id) GROUP BY 1)"""


@query(f"""WITH {FX}, {FC}, {METRICS} SELECT topic, date, round(coalesce(flow, rate) / debt, 6) AS ratio, round(debt * (coalesce(rate, flow) - 0.5 * debt) / (1e6 + debt), 2) AS required, CASE WHEN debt IS NULL OR coalesce(flow, rate) IS NULL THEN 'pending' ELSE 'computed' END AS status, CASE WHEN flow IS NULL THEN 'rate' ELSE 'flow' END AS basis FROM dm""")
def derived_metrics(spark, d):
    """Scalars of the latest values of a topic's series, each with a fallback and a status."""
    last = X.nation_series(spark, d).groupBy("series_id").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value")).join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic", "agg")), "series_id")
    of = lambda rule: F.max(F.when(F.col("agg") == rule, F.col("value")))
    g = last.groupBy("topic").agg(F.max("date").alias("date"), of("last").alias("debt"), of("sum").alias("flow"), of("mean").alias("rate"))
    first, second = F.coalesce("flow", "rate"), F.coalesce("rate", "flow")
    debt = F.col("debt")
    status = F.when(debt.isNull() | first.isNull(), "pending").otherwise("computed")
    return g.select("topic", "date", F.round(first / debt, 6).alias("ratio"), F.round(debt * (second - 0.5 * debt) / (1e6 + debt), 2).alias("required"), status.alias("status"), F.when(F.col("flow").isNull(), "rate").otherwise("flow").alias("basis"))


@query(f"""WITH {FX}, w AS (SELECT series_id, avg(value) FILTER (WHERE year(date) BETWEEN 1995 AND 1997) AS a, avg(value) FILTER (WHERE year(date) BETWEEN 1999 AND 2000) AS b, arg_max(value, date) AS last, max(date) AS at_, min(date) FILTER (WHERE value < 300000) AS low FROM fx GROUP BY 1)
SELECT series_id, 'growth' AS thread, format('mean 1995-1997={{:.0f}} vs 1999-2000={{:.0f}}', a, b) AS evidence, CASE WHEN b > a THEN 'higher' ELSE 'lower' END AS reading FROM w WHERE a IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT series_id, 'level', format('latest {{}}={{:.0f}}; first below 300000: {{}}', strftime(at_, '%Y-%m'), last, coalesce(strftime(low, '%Y-%m'), 'never')), CASE WHEN low IS NULL THEN 'steady' ELSE 'dipped' END FROM w""")
def scorecard(spark, d):
    """Evidence rows: a thread, its formatted numbers and a reading, from the series that have them."""
    mean = lambda a, b: F.avg(F.when(F.year("date").between(a, b), F.col("value")))
    w = X.nation_series(spark, d).groupBy("series_id").agg(mean(1995, 1997).alias("a"), mean(1999, 2000).alias("b"), F.max_by("value", "date").alias("last"), F.max("date").alias("at"), F.min(F.when(F.col("value") < 300000, F.col("date"))).alias("low"))
    growth = w.where("a is not null and b is not null").select("series_id", F.lit("growth").alias("thread"), F.format_string("mean 1995-1997=%.0f vs 1999-2000=%.0f", "a", "b").alias("evidence"), F.when(F.col("b") > F.col("a"), "higher").otherwise("lower").alias("reading"))
    month = lambda c: F.date_format(c, "yyyy-MM")
    level = w.select("series_id", F.lit("level").alias("thread"), F.format_string("latest %s=%.0f; first below 300000: %s", month("at"), "last", F.coalesce(month("low"), F.lit("never"))).alias("evidence"), F.when(F.col("low").isNull(), "steady").otherwise("dipped").alias("reading"))
    return growth.unionByName(level)


@query(f"""WITH {FX}, {FC}, k AS (SELECT fx.series_id, topic, date, ln(value) AS y, ln(lag(value, 12) {W12}) AS a, month(date)::DOUBLE AS b FROM fx JOIN fc USING (series_id)), xy AS (SELECT * FROM k WHERE a IS NOT NULL), {ols2_sql('xy', 'series_id')}, o AS (SELECT o2.series_id, o2.n, r2, c.r * c.r AS r1 FROM o2 JOIN (SELECT series_id, corr(y, a) AS r FROM xy GROUP BY 1) c USING (series_id))
SELECT series_id, n, round(r1, 6) AS statistic, round(r2 - r1, 6) AS adds, CASE WHEN n < 24 THEN 'Insufficient data' WHEN r1 >= 0.02 AND r2 - r1 < 0.05 THEN 'Supported' WHEN r1 >= 0.005 THEN 'Mixed' ELSE 'Not supported' END AS verdict FROM o""".replace("SELECT fx.series_id, topic, date, ln(value) AS y, ln(lag(value, 12) " + W12, "SELECT fx.series_id, topic, date, ln(value) AS y, ln(lag(value, 12) OVER (PARTITION BY fx.series_id ORDER BY date)"))
def threshold_tests(spark, d):
    """A claim per series: how much of the log level the level a year before explains, and whether the season adds to it."""
    lag = F.log(F.lag("value", 12).over(T.by()))
    xy = X.nation_series(spark, d).select("series_id", F.log("value").alias("y"), lag.alias("a"), F.month("date").cast("double").alias("b")).where("a is not null")
    g = G.incremental_r2(xy, ["series_id"], "y", ["a", "b"], "b")
    r1, adds = F.col("r2_less"), F.col("gain")
    verdict = F.when(F.col("n") < 24, "Insufficient data").when((r1 >= 0.02) & (adds < 0.05), "Supported").when(r1 >= 0.005, "Mixed").otherwise("Not supported")
    return g.select("series_id", "n", F.round(r1, 6).alias("statistic"), F.round(adds, 6).alias("adds"), verdict.alias("verdict"))


@query("""WITH m AS (SELECT p_brand, date_trunc('month', l_shipdate)::DATE AS date, round(avg(l_extendedprice / l_quantity), 4) AS price, round(sum(l_extendedprice * l_tax), 2) AS paid, round(sum(l_extendedprice), 2) AS rev FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), x AS (SELECT *, max(date) OVER (PARTITION BY p_brand) AS last FROM m)
SELECT p_brand, max(date) AS date, arg_max(price, date) AS price, round(100 * (arg_max(price, date) / max(price) FILTER (WHERE date = (last - INTERVAL 12 MONTH)::DATE) - 1), 5) AS ret_12m, round(sum(paid) FILTER (WHERE date > (last - INTERVAL 12 MONTH)::DATE), 1) AS paid_ttm, round(sum(rev) FILTER (WHERE date > (last - INTERVAL 12 MONTH)::DATE), 1) AS rev_ttm FROM x GROUP BY 1""")
def company_snapshot(spark, d):
    li = X.table(spark, d, "lineitem").join(X.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    p = F.col("l_extendedprice")
    m = li.groupBy("p_brand", F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg(F.round(F.avg(p / F.col("l_quantity")), 4).alias("price"), F.round(F.sum(p * F.col("l_tax")), 2).alias("paid"), F.round(F.sum(p), 2).alias("rev"))
    x = m.withColumn("ago", F.add_months(F.max("date").over(Window.partitionBy("p_brand")), -12))
    then = F.max(F.when(F.col("date") == F.col("ago"), F.col("price")))
    ttm = lambda c: F.round(F.sum(F.when(F.col("date") > F.col("ago"), F.col(c))), 1)
    return x.groupBy("p_brand").agg(F.max("date").alias("date"), F.max_by("price", "date").alias("price"), F.round(100 * (F.max_by("price", "date") / then - 1), 5).alias("ret_12m"), ttm("paid").alias("paid_ttm"), ttm("rev").alias("rev_ttm"))


@query(f"""WITH {FX}, {FC}, {FT}, g AS (SELECT date, sum(value) AS total FROM fx GROUP BY 1), t AS (SELECT topic, date, sum(value) AS flow FROM fx JOIN fc USING (series_id) GROUP BY 1, 2)
SELECT topic, lean, count(*) AS months, round(sum(flow) / count(*) * 12, 2) AS annualised, round(100 * sum(flow) / sum(total), 6) AS share, min(date) AS first, max(date) AS last FROM t JOIN g USING (date) JOIN ft ON date >= start AND date < "end" GROUP BY 1, 2""")
def term_table(spark, d):
    fx = X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic")), "series_id")
    t = fx.groupBy("topic", "date").agg(F.sum("value").alias("flow")).join(fx.groupBy("date").agg(F.sum("value").alias("total")), "date")
    inside = J.interval_join(t, X.terms(spark), how="inner").groupBy("topic", "lean")
    return inside.agg(F.count("*").alias("months"), F.round(F.sum("flow") / F.count("*") * 12, 2).alias("annualised"), F.round(100 * F.sum("flow") / F.sum("total"), 6).alias("share"), F.min("date").alias("first"), F.max("date").alias("last"))



@query(f"""WITH {FX}, {FC}, {FT}, t AS (SELECT topic, date, sum(value) AS flow FROM fx JOIN fc USING (series_id) GROUP BY 1, 2), m AS (SELECT month(max(date)) AS m FROM t),
y AS (SELECT topic, year(date)::INTEGER AS year, count(*) AS months, sum(flow) AS total, sum(flow) FILTER (WHERE month(date) <= m) AS to_date FROM t, m GROUP BY 1, 2),
l AS (SELECT topic, year(date) AS year, lean, count(*) AS n, min(date) AS first FROM t JOIN ft ON date >= start AND date < "end" GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY topic, year ORDER BY n DESC, first) AS k FROM l)
SELECT topic, year, lean, months, round(total, 2) AS total, round(to_date, 2) AS to_date, round(100 * (to_date / CASE WHEN lag(year) OVER w = year - 1 THEN lag(to_date) OVER w END - 1), 5) AS change FROM y LEFT JOIN (SELECT topic, year, lean FROM k WHERE k = 1) USING (topic, year) WINDOW w AS (PARTITION BY topic ORDER BY year)""")
def term_years(spark, d):
    """Each topic's years with the term that most of their months lie in, and the year to date against the year before."""
    fx = X.nation_series(spark, d).join(X.catalogue(spark, d).select("series_id", "topic"), "series_id")
    t = fx.groupBy("topic", "date").agg(F.sum("value").alias("flow"))
    inside = J.interval_join(t, X.terms(spark), how="inner").groupBy("topic", F.year("date").alias("year"), "lean").agg(F.count("*").alias("_n"), F.min("date").alias("_first"))
    most = inside.groupBy("topic", "year").agg(F.min_by("lean", F.struct(-F.col("_n"), "_first")).alias("lean"))
    out = U.year_to_date(t, ["topic"], "date", "flow").join(most, ["topic", "year"], "left")
    return out.select("topic", "year", "lean", "months", F.round("total", 2).alias("total"), F.round("to_date", 2).alias("to_date"), F.round("change", 5).alias("change"))


RETURNS = f"rt AS (SELECT series_id, date, 100 * ln(value / lag(value) {W12}) AS y FROM fx), rm AS (SELECT date, avg(y) AS a FROM rt WHERE y IS NOT NULL GROUP BY 1)"


@query(f"""WITH {FX}, {FT}, {RETURNS}, k AS (SELECT series_id, regr_slope(y, a) AS b FROM rt JOIN rm USING (date) WHERE y IS NOT NULL GROUP BY 1)
SELECT series_id, lean, count(*) AS n, round(avg(y) * 12, 5) + 0.0 AS annualised, round(avg(y - b * a) * 12, 5) + 0.0 AS alpha FROM rt JOIN rm USING (date) JOIN k USING (series_id) JOIN ft ON date >= start AND date < "end" WHERE y IS NOT NULL GROUP BY 1, 2""")
def factor_return_by_term(spark, d):
    y = 100 * F.log(F.col("value") / F.lag("value").over(T.by()))
    ret = X.nation_series(spark, d).select("series_id", "date", y.alias("y")).where("y is not null")
    both = ret.join(ret.groupBy("date").agg(F.avg("y").alias("a")), "date")
    beta = G.ols(both, ["series_id"], "y", ["a"]).select("series_id", F.get("beta", 0).alias("b"))
    inside = J.interval_join(both.join(beta, "series_id"), X.terms(spark), how="inner")
    return r(inside.groupBy("series_id", "lean").agg(F.count("*").alias("n"), (F.avg("y") * 12).alias("annualised"), (F.avg(F.col("y") - F.col("b") * F.col("a")) * 12).alias("alpha")), 5, "annualised", "alpha")


@query(f"""WITH {FT}, q AS (SELECT p_brand, date_trunc('quarter', l_shipdate)::DATE AS date, sum(l_extendedprice) AS rev, sum(l_extendedprice * l_discount) AS paid, sum(l_quantity) AS units, sum(l_extendedprice * l_tax) AS debt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, lean, count(*) AS quarters, round(sum(paid) / sum(rev), 8) AS payout, round(sum(rev) / sum(units), 4) AS per_unit, round(avg(debt / rev), 8) AS leverage FROM q JOIN ft ON date >= start AND date < "end" GROUP BY 1, 2""")
def fundamentals_by_term(spark, d):
    li = X.table(spark, d, "lineitem").join(X.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    p = F.col("l_extendedprice")
    q = li.groupBy("p_brand", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("date")).agg(F.sum(p).alias("rev"), F.sum(p * F.col("l_discount")).alias("paid"), F.sum("l_quantity").alias("units"), F.sum(p * F.col("l_tax")).alias("debt"))
    g = J.interval_join(q, X.terms(spark), how="inner").groupBy("p_brand", "lean")
    return g.agg(F.count("*").alias("quarters"), F.round(F.sum("paid") / F.sum("rev"), 8).alias("payout"), F.round(F.sum("rev") / F.sum("units"), 4).alias("per_unit"), F.round(F.avg(F.col("debt") / F.col("rev")), 8).alias("leverage"))


@query("""WITH q AS (SELECT p_brand, date_trunc('quarter', l_shipdate)::DATE AS date, ln(sum(l_extendedprice)) AS r, ln(sum(l_quantity)) AS u FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), c AS (SELECT p_brand, date, 100 * (r - lag(r) OVER w) AS dr, 100 * (u - lag(u) OVER w) AS du FROM q WINDOW w AS (PARTITION BY p_brand ORDER BY date))
SELECT p_brand, count(*) AS n, round(regr_slope(dr, du), 6) AS slope, round(avg(dr) FILTER (WHERE year(date) >= 1999) - avg(dr), 5) + 0.0 AS late FROM c WHERE dr IS NOT NULL GROUP BY 1""")
def pass_through(spark, d):
    li = X.table(spark, d, "lineitem").join(X.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    q = li.groupBy("p_brand", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("date")).agg(F.log(F.sum("l_extendedprice")).alias("r"), F.log(F.sum("l_quantity")).alias("u"))
    w = Window.partitionBy("p_brand").orderBy("date")
    step = lambda c: 100 * (F.col(c) - F.lag(c).over(w))
    c = q.select("p_brand", "date", step("r").alias("dr"), step("u").alias("du")).where("dr is not null")
    late = F.avg(F.when(F.year("date") >= 1999, F.col("dr"))) - F.avg("dr")
    return r(r(c.groupBy("p_brand").agg(F.count("*").alias("n"), F.regr_slope("dr", "du").alias("slope"), late.alias("late")), 6, "slope"), 5, "late")


@query("""WITH a AS (SELECT year(o_orderdate)::INTEGER AS year, sum(o_totalprice) AS rev FROM orders GROUP BY 1), b AS (SELECT year(l_shipdate)::INTEGER AS year, sum(l_extendedprice * l_tax) AS tax, sum(l_extendedprice * l_discount) FILTER (WHERE l_returnflag = 'R') AS div FROM lineitem GROUP BY 1)
SELECT year, round(tax, 1) AS tax, round(0.5 * div, 1) AS stake, round(100 * (tax + 0.5 * div) / rev, 5) AS share FROM a JOIN b USING (year)""")
def fiscal_channel(spark, d):
    a = X.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("rev"))
    p = F.col("l_extendedprice")
    b = X.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.sum(p * F.col("l_tax")).alias("t"), F.sum(F.when(F.col("l_returnflag") == "R", p * F.col("l_discount"))).alias("v"))
    both = a.join(b, "year")
    return both.select("year", F.round("t", 1).alias("tax"), F.round(0.5 * F.col("v"), 1).alias("stake"), F.round(100 * (F.col("t") + 0.5 * F.col("v")) / F.col("rev"), 5).alias("share"))


@query("""WITH v AS (SELECT n_name AS partner, year(o_orderdate) AS y, month(o_orderdate) AS m, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3), p AS (SELECT partner, sum(v) FILTER (WHERE y = 2000) AS v0, sum(v) FILTER (WHERE y = 1996) AS v1, sum(v) FILTER (WHERE y = 2001 AND m <= 7) AS now, sum(v) FILTER (WHERE y = 2000 AND m <= 7) AS before FROM v GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY v0 DESC, partner) AS k FROM p) SELECT CASE WHEN k <= 10 THEN partner ELSE 'other' END AS partner, round(sum(v0), 1) AS value, round(100 * sum(v0) / (SELECT sum(v0) FROM p), 6) AS share, round(100 * (pow(sum(v0) / sum(v1), 0.25) - 1), 5) AS cagr, round(100 * (sum(now) / sum(before) - 1), 5) AS ytd FROM k GROUP BY 1""")
def exposure_map(spark, d):
    o = X.table(spark, d, "orders").join(X.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    y, m, v = F.year("o_orderdate"), F.month("o_orderdate"), F.col("o_totalprice")
    sum_ = lambda c: F.sum(F.when(c, v))
    p = o.groupBy("c_nationkey").agg(sum_(y == 2000).alias("v0"), sum_(y == 1996).alias("v1"), sum_((y == 2001) & (m <= 7)).alias("now"), sum_((y == 2000) & (m <= 7)).alias("before"))
    p = p.join(F.broadcast(X.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    # one row a partner is ranked
    k = p.withColumns({"_k": F.row_number().over(Window.orderBy(F.desc("v0"), "n_name")), "_all": F.sum("v0").over(Window.partitionBy(F.lit(1)))})
    g = k.groupBy(F.when(F.col("_k") <= 10, F.col("n_name")).otherwise("other").alias("partner"))
    growth = lambda a, b, e: 100 * (F.pow(F.sum(a) / F.sum(b), F.lit(e)) - 1)
    return g.agg(F.round(F.sum("v0"), 1).alias("value"), F.round(100 * F.sum("v0") / F.first("_all"), 6).alias("share"), F.round(growth("v0", "v1", 0.25), 5).alias("cagr"), F.round(growth("now", "before", 1.0), 5).alias("ytd"))


@query("""WITH s AS (SELECT p_brand, l_suppkey, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT *, v / sum(v) OVER (PARTITION BY p_brand) AS sh, row_number() OVER (PARTITION BY p_brand ORDER BY v DESC, l_suppkey) AS k FROM s)
SELECT p_brand, count(*) AS suppliers, round(sum(sh * sh), 8) AS hhi, string_agg(l_suppkey || ' ' || round(100 * sh, 1)::DECIMAL(9, 1), ', ' ORDER BY k) FILTER (WHERE k <= 3) AS top, CASE WHEN sum(sh * sh) > 0.25 THEN 'concentrated' WHEN max(sh) > 0.02 THEN 'led' ELSE 'spread' END AS class FROM t GROUP BY 1""")
def product_exposure(spark, d):
    li = X.table(spark, d, "lineitem").join(X.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    w = Window.partitionBy("p_brand")
    t = li.groupBy("p_brand", "l_suppkey").agg(F.sum("l_extendedprice").alias("v")).withColumns({"sh": F.col("v") / F.sum("v").over(w), "k": F.row_number().over(w.orderBy(F.desc("v"), "l_suppkey"))})
    item = F.struct("k", F.concat(F.col("l_suppkey").cast("string"), F.lit(" "), F.round(100 * F.col("sh"), 1).cast("decimal(9,1)").cast("string")).alias("x"))
    hhi = F.sum(F.col("sh") * F.col("sh"))
    g = t.groupBy("p_brand").agg(F.count("*").alias("suppliers"), F.round(hhi, 8).alias("hhi"), F.array_sort(F.collect_list(F.when(F.col("k") <= 3, item))).alias("_top"), F.when(hhi > 0.25, "concentrated").when(F.max("sh") > 0.02, "led").otherwise("spread").alias("class"))
    return g.select("p_brand", "suppliers", "hhi", F.array_join(F.transform("_top", lambda s: s["x"]), ", ").alias("top"), "class")


@query(f"""WITH {FX}, {FT}, q AS (SELECT series_id, date_trunc('quarter', date)::DATE AS q, sum(value) AS e FROM fx GROUP BY 1, 2), t AS (SELECT series_id, (q + INTERVAL 3 MONTH)::DATE AS known, sum(e) OVER w AS ttm, count(*) OVER w AS n FROM q WINDOW w AS (PARTITION BY series_id ORDER BY q ROWS 3 PRECEDING)),
p AS (SELECT series_id, date, value * 40 AS price, (SELECT arg_max(ttm, known) FROM t WHERE t.series_id = fx.series_id AND n = 4 AND known <= date) AS ttm FROM fx)
SELECT series_id, lean, count(*) AS n, round(median(price / ttm), 6) AS pe, round(quantile_cont(price / ttm, 0.75) - quantile_cont(price / ttm, 0.25), 6) AS iqr FROM p JOIN ft ON date >= start AND date < "end" WHERE ttm IS NOT NULL GROUP BY 1, 2""")
def valuation_by_term(spark, d):
    fx = X.nation_series(spark, d)
    q = fx.groupBy("series_id", F.to_date(F.date_trunc("quarter", "date")).alias("q")).agg(F.sum("value").alias("e"))
    w = Window.partitionBy("series_id").orderBy("q").rowsBetween(-3, 0)
    t = q.select("series_id", F.add_months("q", 3).alias("date"), F.sum("e").over(w).alias("value"), F.count("*").over(w).alias("n")).where("n = 4").drop("n")
    p = J.asof(fx.select("series_id", "date", (F.col("value") * 40).alias("price")), t, "series_id").where("asof_value is not null").withColumn("pe", F.col("price") / F.col("asof_value"))
    g = J.interval_join(p, X.terms(spark), how="inner").groupBy("series_id", "lean")
    at = lambda x: F.percentile("pe", F.lit(x))
    return g.agg(F.count("*").alias("n"), F.round(F.median("pe"), 6).alias("pe"), F.round(at(0.75) - at(0.25), 6).alias("iqr"))


@query("SELECT c_mktsegment AS sector, count(*) AS tickers, round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer WHERE c_acctbal > 0), 8) AS weight FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def share_class_weights(spark, d):
    c = X.table(spark, d, "customer").where("c_acctbal > 0")
    total = F.broadcast(c.agg(F.sum("c_acctbal").alias("_t")))  # one row
    g = c.groupBy(F.col("c_mktsegment").alias("sector")).agg(F.count("*").alias("tickers"), F.sum("c_acctbal").alias("_s"))
    return g.join(total, F.lit(True)).select("sector", "tickers", F.round(F.col("_s") / F.col("_t"), 8).alias("weight"))


@query(f"""WITH {FX}, m AS (SELECT series_id, date, value, avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS 5 PRECEDING) AS roll, lag(date) {W12} AS p FROM fx WHERE date >= DATE '1997-01-01'), b AS (SELECT series_id, arg_min(value, date) AS base FROM m GROUP BY 1)
SELECT series_id, date, round(100 * value / base, 5) AS rebased, round(roll, 3) AS roll, value < 300000 AS below, coalesce((year(date) - year(p)) * 12 + month(date) - month(p) > 2, false) AS broken FROM m JOIN b USING (series_id)""")
def chart_frames(spark, d):
    """What a chart draws: cut by a start, rebased, smoothed, with a threshold and broken lines."""
    fx = X.nation_series(spark, d).where("date >= date'1997-01-01'")
    prev = F.lag("date").over(T.by())
    months = (F.year("date") - F.year(prev)) * 12 + F.month("date") - F.month(prev)
    base = F.first("value").over(T.by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return fx.select("series_id", "date", F.round(100 * F.col("value") / base, 5).alias("rebased"), F.round(F.avg("value").over(T.by().rowsBetween(-5, 0)), 3).alias("roll"), (F.col("value") < 300000).alias("below"), F.coalesce(months > 2, F.lit(False)).alias("broken"))


@query(f"""WITH {FX}, {FC}, s AS (SELECT series_id, topic, min(date) AS f, max(date) AS l, count(*) AS n FROM fx JOIN fc USING (series_id) GROUP BY 1, 2), a AS (SELECT max(l) AS m FROM s)
SELECT topic AS source, count(*) AS series, sum(n)::BIGINT AS obs, min(f) AS first, max(l) AS last, count(*) FILTER (WHERE m - l > 20) AS stale FROM s, a GROUP BY 1""")
def source_table(spark, d):
    s = X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic")), "series_id").groupBy("series_id", "topic").agg(F.min("date").alias("f"), F.max("date").alias("l"), F.count("*").alias("n"))
    newest = F.broadcast(s.agg(F.max("l").alias("m")))  # one row
    return s.join(newest, F.lit(True)).groupBy(F.col("topic").alias("source")).agg(F.count("*").alias("series"), F.sum("n").alias("obs"), F.min("f").alias("first"), F.max("l").alias("last"), F.count_if(F.datediff("m", "l") > 20).alias("stale"))


@query(f"""WITH {FX}, {FC}, y AS (SELECT series_id, agg, year(date)::INTEGER AS year, avg(value) AS v FROM fx JOIN fc USING (series_id) GROUP BY 1, 2, 3), l AS (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY year) AS p FROM y)
SELECT series_id, year, CASE agg WHEN 'sum' THEN 'level' WHEN 'last' THEN 'diff' ELSE 'log_diff' END AS transform, round(CASE agg WHEN 'sum' THEN v WHEN 'last' THEN v - p ELSE 100 * ln(v / p) END, 4) + 0.0 AS outcome FROM l WHERE agg = 'sum' OR p IS NOT NULL""")
def metric_panel(spark, d):
    """Outcome metrics by a table of specifications: which transform of the yearly mean each series takes."""
    specs = X.catalogue(spark, d).select("series_id", F.when(F.col("agg") == "sum", "level").when(F.col("agg") == "last", "diff").otherwise("log_diff").alias("transform"))
    y = X.nation_series(spark, d).groupBy("series_id", F.year("date").alias("year")).agg(F.avg("value").alias("v"))
    return r(T.transformed(y, specs), 4, "outcome").select("series_id", "year", "transform", "outcome")


@query(f"""WITH {FX}, {FC}, q AS (SELECT series_id, agg, date_trunc('quarter', date)::DATE AS date, sum(value) AS v, avg(value) AS fxm FROM fx JOIN fc USING (series_id) GROUP BY 1, 2, 3), f AS (SELECT date, fxm FROM q WHERE series_id = 'NATION_0'), u AS (SELECT q.series_id, q.date, q.v / f.fxm AS usd, sum(q.v) OVER w AS ttm, count(*) OVER w AS n FROM q JOIN f USING (date) WINDOW w AS (PARTITION BY q.series_id ORDER BY q.date ROWS 3 PRECEDING))
SELECT series_id, date, round(usd, 6) AS usd, CASE WHEN n = 4 THEN round(ttm, 2) END AS ttm, round(100 * (usd / lag(usd, 4) OVER (PARTITION BY series_id ORDER BY date) - 1), 5) + 0.0 AS growth FROM u""")
def company_series(spark, d):
    """Quarterly flows in another currency at the quarter's mean rate, their trailing year and growth."""
    q = X.nation_series(spark, d).groupBy("series_id", F.to_date(F.date_trunc("quarter", "date")).alias("date")).agg(F.sum("value").alias("v"), F.avg("value").alias("m"))
    rate = q.where("series_id = 'NATION_0'").select("date", F.col("m").alias("rate"))
    u = q.join(rate, "date").withColumn("usd", F.col("v") / F.col("rate"))
    w = T.by().rowsBetween(-3, 0)
    growth = 100 * (F.col("usd") / F.lag("usd", 4).over(T.by()) - 1)
    return u.select("series_id", "date", F.round("usd", 6).alias("usd"), F.when(F.count("*").over(w) == 4, F.round(F.sum("v").over(w), 2)).alias("ttm"), (F.round(growth, 5) + F.lit(0.0)).alias("growth"))


@query(f"""WITH {FC}, i AS (SELECT 'total/' || topic AS d, series_id AS i FROM fc) SELECT d AS a, i AS b, 'lineage' AS reason, 1.0::DOUBLE AS strength FROM i UNION ALL SELECT i, d, 'lineage', 0.9 FROM i UNION ALL SELECT x.i, y.i, 'lineage', 0.85 FROM i x JOIN i y ON x.d = y.d AND x.i <> y.i""")
def edges_lineage(spark, d):
    """Between a derived series and its inputs, and between inputs used together."""
    inputs = X.catalogue(spark, d).select(F.concat(F.lit("total/"), "topic").alias("d"), F.col("series_id").alias("i"))
    return E.lineage_edges(inputs)


@query(f"""WITH {FX}, {FC}, p AS (SELECT a.series_id AS canonical, b.series_id AS alternate, median(100 * abs(a.value - b.value) / a.value) AS diff FROM fx a JOIN fx b ON a.date = b.date AND a.series_id < b.series_id JOIN fc x ON x.series_id = a.series_id JOIN fc y ON y.series_id = b.series_id AND x.topic = y.topic GROUP BY 1, 2 HAVING median(100 * abs(a.value - b.value) / a.value) < 100)
SELECT canonical AS a, alternate AS b, 'same_concept' AS reason, 1.0::DOUBLE AS strength, format('within {{:.0f}}%', diff) AS explanation FROM p UNION ALL SELECT alternate, canonical, 'same_concept', 1.0, format('within {{:.0f}}%', diff) FROM p""")
def edges_same_concept(spark, d):
    """Both ways between series of a topic that differ little, with how much."""
    fx = X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic")), "series_id")
    side = lambda x, v: fx.select("topic", "date", F.col("series_id").alias(x), F.col("value").alias(v))
    diff = F.median(100 * F.abs(F.col("u") - F.col("w")) / F.col("u"))
    pairs = side("canonical", "u").join(side("alternate", "w"), ["topic", "date"]).where("canonical < alternate").groupBy("canonical", "alternate").agg(diff.alias("diff")).where("diff < 100")
    text = F.format_string("within %.0f%%", "diff")
    one = lambda a, b: pairs.select(*E.edge(a, b, "same_concept", 1.0), text.alias("explanation"))
    return one("canonical", "alternate").unionByName(one("alternate", "canonical"))


CANDIDATES = """cy AS (SELECT series_id, topic, 'annual ' || how AS basis, date_trunc('year', date) AS k, CASE how WHEN 'mean' THEN avg(value) ELSE sum(value) END AS v FROM fx JOIN fc USING (series_id), (SELECT unnest(['mean', 'sum']) AS how) GROUP BY series_id, topic, how, date_trunc('year', date) UNION ALL
SELECT series_id, topic, 'quarterly mean', date_trunc('quarter', date), avg(value) FROM fx JOIN fc USING (series_id) GROUP BY series_id, topic, date_trunc('quarter', date)),
cm AS (SELECT 'mirror/' || series_id AS series_id, topic, basis, k, v * 100 + year(k) AS v FROM cy)"""


@query(f"WITH {FX}, {FC}, {CANDIDATES} SELECT a.basis, b.series_id AS dup, a.series_id AS keep, count(*) AS n, round(corr(a.v, b.v), 6) AS corr, round(median(b.v / a.v), 3) AS ratio FROM cy a JOIN cm b ON a.topic = b.topic AND a.basis = b.basis AND a.k = b.k GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND round(corr(a.v, b.v), 6) >= 0.9")
def twin_candidates(spark, d):
    """Pairs of a topic that run together on one of several bases: yearly means or sums, quarterly means."""
    fx = X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic")), "series_id")
    part = lambda unit, how, name: fx.groupBy("series_id", "topic", F.to_date(F.date_trunc(unit, "date")).alias("k")).agg(how("value").alias("v")).withColumn("basis", F.lit(name))
    y = part("year", F.avg, "annual mean").unionByName(part("year", F.sum, "annual sum")).unionByName(part("quarter", F.avg, "quarterly mean"))
    m = y.select(F.concat(F.lit("mirror/"), "series_id").alias("dup"), "topic", "basis", "k", (F.col("v") * 100 + F.year("k")).alias("w"))
    p = y.withColumnRenamed("series_id", "keep").join(m, ["topic", "basis", "k"]).groupBy("basis", "dup", "keep").agg(F.count("*").alias("n"), F.round(F.corr("v", "w"), 6).alias("corr"), F.round(F.median(F.col("w") / F.col("v")), 3).alias("ratio"))
    return p.where("n >= 5 and corr >= 0.9")
