"""Registered queries of further aggregations, series windows and semantic views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import linking as L
from tidemark.operators import rollups as R
from tidemark.operators import timeseries as T
from tidemark.sources import tables as X

from .warehouse import FC, FD, FT, FX, query


def r(df, places, *columns):
    """Rounded, with minus zero as zero."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def _cat(spark, d):
    return F.broadcast(X.catalogue(spark, d).select("series_id", "topic", "agg"))


BY = "OVER (PARTITION BY series_id ORDER BY date"


@query("""WITH o AS (SELECT c_nationkey, o_orderpriority, o_orderstatus, o_totalprice, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT c_nationkey, o_orderpriority, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, o_orderpriority) AS k FROM o GROUP BY 1, 2)
SELECT o.c_nationkey, count(*) AS n, any_value(m.o_orderpriority) AS freq, count(DISTINCT (o.o_orderpriority, o_orderstatus)) AS combos, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS headline FROM o JOIN m ON o.c_nationkey = m.c_nationkey AND k = 1 GROUP BY 1""")
def mirror_stats(spark, d):
    o = X.table(spark, d, "orders").join(X.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    headline = F.max_by("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    return o.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.mode("o_orderpriority", True).alias("freq"), F.count_distinct("o_orderpriority", "o_orderstatus").alias("combos"), headline.alias("headline"))


@query(f"""WITH {FX}, {FC}, y AS (SELECT series_id, agg, year(date)::INTEGER AS year, count(*) AS n, CASE agg WHEN 'last' THEN arg_max(value, date) WHEN 'mean' THEN avg(value) ELSE sum(value) / 1e6 END AS v FROM fx JOIN fc USING (series_id) GROUP BY series_id, agg, year(date))
SELECT series_id, year, round(v, 6) AS value FROM y WHERE agg <> 'sum' OR n >= 12""")
def to_annual(spark, d):
    rule = F.first("agg")
    value = F.when(rule == "last", F.max_by("value", "date")).when(rule == "mean", F.avg("value")).otherwise(F.sum("value") / 1e6)
    y = X.nation_series(spark, d).join(_cat(spark, d), "series_id").groupBy("series_id", "agg", F.year("date").alias("year")).agg(F.count("*").alias("n"), value.alias("value"))
    return r(y.where("agg <> 'sum' or n >= 12").select("series_id", "year", "value"), 6, "value")


QUARTERLY = """cq AS (SELECT n_name AS entity_id, date_trunc('quarter', o_orderdate)::DATE AS quarter_end, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 3) AS f, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 3) AS o, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 3) AS p
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def _quarterly(spark, d):
    o = X.table(spark, d, "orders").join(X.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    cells = o.groupBy("c_nationkey", F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter_end")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 3))
    named = cells.join(F.broadcast(X.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("n_name").alias("entity_id"), "quarter_end", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query(f"WITH {QUARTERLY} SELECT * FROM cq")
def pivot_entity_quarter(spark, d):
    return _quarterly(spark, d)


@query(f"WITH {QUARTERLY} SELECT entity_id, quarter_end, f, o, round(o - f, 3) AS net FROM cq")
def v_company_quarterly(spark, d):
    return r(_quarterly(spark, d).withColumn("net", F.col("o") - F.col("f")), 3, "net").select("entity_id", "quarter_end", "f", "o", "net")


@query("SELECT p_brand, max(p_retailprice) FILTER (WHERE p_type = 'ECONOMY') AS economy, max(p_retailprice) FILTER (WHERE p_type = 'PROMO') AS promo FROM part GROUP BY 1")
def sql_pivot(spark, d):
    return X.table(spark, d, "part").groupBy("p_brand").pivot("p_type", ["ECONOMY", "PROMO"]).agg(F.max("p_retailprice")).withColumnsRenamed({"ECONOMY": "economy", "PROMO": "promo"})


@query("""WITH c AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus || '|' || CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'TOTAL' ELSE o_orderpriority END AS codes FROM orders), t AS (SELECT *, regexp_matches(codes, '^F\\|TOTAL$') AS is_total FROM c),
g AS (SELECT *, bool_or(is_total) OVER (PARTITION BY o_custkey) AS has, min(codes) OVER (PARTITION BY o_custkey) AS least FROM t) SELECT o_custkey, o_orderkey, codes FROM g WHERE CASE WHEN has THEN is_total ELSE codes = least END""")
def headline_rows(spark, d):
    code = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "TOTAL").otherwise(F.col("o_orderpriority"))
    o = X.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat_ws("|", "o_orderstatus", code).alias("codes"))
    return R.headline(o, ["o_custkey"], "codes", "^(F|TOTAL)$").select("o_custkey", "o_orderkey", "codes")


@query(f"""WITH {FX}, {FC}, m AS (SELECT date, sum(value) FILTER (WHERE topic = 'ASIA') AS part, sum(value) AS total, count(*) FILTER (WHERE topic = 'ASIA') AS k FROM fx JOIN fc USING (series_id) GROUP BY 1), l AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS q FROM m WHERE k = (SELECT count(*) FROM fc WHERE topic = 'ASIA'))
SELECT round(100 * sum(part) / sum(total), 6) AS share, min(date) AS start, max(date) AS "end" FROM l WHERE q <= 12 HAVING count(*) = 12""")
def trailing_share(spark, d):
    fx = X.nation_series(spark, d).join(_cat(spark, d), "series_id")
    m = fx.groupBy("date").agg(F.sum(F.when(F.col("topic") == "ASIA", F.col("value"))).alias("part"), F.sum("value").alias("total"), F.count_if(F.col("topic") == "ASIA").alias("k"))
    members = X.catalogue(spark, d).where("topic = 'ASIA'").agg(F.count("*").alias("k"))  # one row
    m = m.join(F.broadcast(members), "k")
    # the last 12 months all together are a limit, not a window over all of them
    last = m.orderBy(F.desc("date")).limit(12).agg(F.count("*").alias("n"), (100 * F.sum("part") / F.sum("total")).alias("share"), F.min("date").alias("start"), F.max("date").alias("end"))
    return r(last.where("n = 12").select("share", "start", "end"), 6, "share")


@query(f"WITH {FX}, {FC}, n AS (SELECT topic, count(*) AS k FROM fc GROUP BY 1) SELECT topic, date, round(sum(value), 2) AS value FROM fx JOIN fc USING (series_id) JOIN n USING (topic) GROUP BY topic, date, k HAVING count(DISTINCT series_id) = k")
def all_parts_sum(spark, d):
    fx, cat = X.nation_series(spark, d), X.catalogue(spark, d)
    parts = cat.groupBy("topic").agg(F.count("*").alias("k"))
    s = fx.join(_cat(spark, d), "series_id").groupBy("topic", "date").agg(F.sum("value").alias("value"), F.count_distinct("series_id").alias("n")).join(F.broadcast(parts), "topic")
    return r(s.where("n = k").select("topic", "date", "value"), 2, "value")


@query("SELECT l_shipdate::DATE AS date, round(100 * sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS ratio FROM lineitem GROUP BY 1")
def ratio_of_group_sums_daily(spark, d):
    p = F.col("l_extendedprice")
    return r(X.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg((100 * F.sum(p * F.col("l_discount")) / F.sum(p)).alias("ratio")), 6, "ratio")


@query("WITH m AS (SELECT o_orderdate::DATE AS date, o_orderstatus AS part, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) SELECT date, round(sum(m) FILTER (WHERE part = 'F') / sum(m), 6) AS share FROM m GROUP BY 1 HAVING count(*) = 3")
def share_of_total(spark, d):
    m = X.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"), "o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    out = m.groupBy("date").agg(F.count("*").alias("n"), (F.sum(F.when(F.col("o_orderstatus") == "F", F.col("m"))) / F.sum("m")).alias("share"))
    return r(out.where("n = 3").select("date", "share"), 6, "share")


@query("""WITH l AS (SELECT p_brand, CASE WHEN l_returnflag = 'R' THEN 'full' WHEN l_returnflag = 'A' THEN 'half' ELSE 'none' END AS status, l_discount * 10 AS frac, l_extendedprice AS v, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand, round(sum(frac * v) FILTER (WHERE status = 'full') / sum(v), 6) AS full_share, round(sum(frac * v) FILTER (WHERE status = 'half') / sum(v), 6) AS half_share, round(CASE WHEN sum(frac * v) > 0 THEN sum(frac * v * l_tax) / sum(frac * v) ELSE avg(l_tax) END, 6) AS rate FROM l GROUP BY 1""")
def fraction_weighted_status(spark, d):
    l = X.table(spark, d, "lineitem").join(X.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").withColumn("w", F.col("l_discount") * 10 * F.col("l_extendedprice"))
    share = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("w"))) / F.sum("l_extendedprice")
    rate = F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("l_tax")) / F.sum("w")).otherwise(F.avg("l_tax"))
    return r(l.groupBy("p_brand").agg(share("R").alias("full_share"), share("A").alias("half_share"), rate.alias("rate")), 6, "full_share", "half_share", "rate")


@query("""WITH y AS (SELECT p_brand, year(l_shipdate) AS y, sum(l_extendedprice) AS v, avg((l_returnflag = 'R')::INT) AS a, avg((l_linestatus = 'F')::INT) AS b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) IN (1998, 1999) GROUP BY 1, 2),
c AS (SELECT x.p_brand, z.v - x.v AS dv, z.a, z.b FROM y x JOIN y z ON x.p_brand = z.p_brand AND x.y = 1998 AND z.y = 1999)
SELECT p_brand, round(dv, 2) AS change, round(dv * least(a, b), 2) + 0.0 AS both, round(dv * (a - least(a, b)), 2) + 0.0 AS first_only, round(dv * (b - least(a, b)), 2) + 0.0 AS second_only, round(dv * (1 - greatest(a, b)), 2) + 0.0 AS neither FROM c""")
def change_decomposition(spark, d):
    l = X.table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate")).where("y in (1998, 1999)").join(X.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    at = lambda y, c: F.when(F.col("y") == y, c)
    v = F.sum(at(1999, F.col("l_extendedprice"))) - F.sum(at(1998, F.col("l_extendedprice")))
    a, b = (F.avg(at(1999, (F.col(c) == x).cast("int"))) for c, x in (("l_returnflag", "R"), ("l_linestatus", "F")))
    g = l.groupBy("p_brand").agg(v.alias("change"), a.alias("a"), b.alias("b"), F.count_distinct("y").alias("n")).where("n = 2")
    dv, both = F.col("change"), F.least("a", "b")
    out = g.select("p_brand", "change", (dv * both).alias("both"), (dv * (F.col("a") - both)).alias("first_only"), (dv * (F.col("b") - both)).alias("second_only"), (dv * (1 - F.greatest("a", "b"))).alias("neither"))
    return r(out, 2, "change", "both", "first_only", "second_only", "neither")


@query("""WITH g AS (SELECT n_nationkey, y.y::INTEGER AS year FROM nation, range(1995, 2002) y(y)), o AS (SELECT c_nationkey, year(o_orderdate) AS year, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS a, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), p AS (SELECT c_nationkey, count(*) AS pop FROM customer GROUP BY 1)
SELECT g.n_nationkey, g.year, coalesce(a, 0) AS deaths, round(1e5 * coalesce(a, 0) / pop, 4) AS rate, round(100 * a / n, 6) AS share FROM g JOIN p ON p.c_nationkey = n_nationkey LEFT JOIN o ON o.c_nationkey = n_nationkey AND o.year = g.year""")
def death_rate(spark, d):
    c = X.table(spark, d, "customer")
    pop = c.groupBy("c_nationkey").agg(F.count("*").alias("pop"))
    grid = pop.withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    o = X.table(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.count("*").alias("n"))
    out = grid.join(o, ["c_nationkey", "year"], "left")
    return out.select(F.col("c_nationkey").alias("n_nationkey"), "year", F.coalesce("a", F.lit(0)).alias("deaths"), F.round(1e5 * F.coalesce("a", F.lit(0)) / F.col("pop"), 4).alias("rate"), F.round(100 * F.col("a") / F.col("n"), 6).alias("share"))


@query("""WITH old AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, round(sum(l_quantity), 2) AS value FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1), new AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1),
m AS (SELECT (max(date) - INTERVAL 2 MONTH)::DATE AS m FROM new) SELECT date, value FROM old, m WHERE date < m UNION ALL SELECT date, value FROM new, m WHERE date >= m""")
def monthly_totals(spark, d):
    li = X.table(spark, d, "lineitem")
    total = lambda df: df.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    new = total(li)
    since = F.broadcast(new.agg(F.add_months(F.max("date"), -2).alias("_since")))  # one row
    fresh = new.join(since, F.col("date") >= F.col("_since")).drop("_since")
    return J.priority_merge(fresh, total(li.where("l_returnflag <> 'N'")).join(since, F.col("date") < F.col("_since")).drop("_since"), ["date"])


@query(f"""WITH {FX}, m AS (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m FROM fx), b AS (SELECT series_id, avg((abs(value / m - 1) <= 0.2)::INT) AS s FROM m GROUP BY 1), y AS (SELECT series_id, year(date) AS y, stddev_samp(value) AS sd FROM fx GROUP BY 1, 2)
SELECT series_id, round(s, 6) AS in_band, round(avg(sd), 3) AS within_year FROM b JOIN y USING (series_id) GROUP BY series_id, s""")
def in_band_share(spark, d):
    fx = X.nation_series(spark, d)
    b = fx.withColumn("m", F.avg("value").over(T.every())).groupBy("series_id").agg(F.avg((F.abs(F.col("value") / F.col("m") - 1) <= 0.2).cast("int")).alias("in_band"))
    y = fx.groupBy("series_id", F.year("date").alias("y")).agg(F.stddev_samp("value").alias("sd")).groupBy("series_id").agg(F.avg("sd").alias("within_year"))
    return r(r(b.join(y, "series_id"), 6, "in_band"), 3, "within_year")


@query("""SELECT n_regionkey AS g, round(avg((n >= 55)::INT), 6) AS testable, round(avg(s) FILTER (WHERE n >= 55), 6) AS score, CASE WHEN avg(s) FILTER (WHERE n >= 55) >= 0.05 THEN 'strong' WHEN avg(s) FILTER (WHERE n >= 55) >= 0 THEN 'weak' ELSE 'none' END AS label, count(*) FILTER (WHERE s > 0) AS positive
FROM (SELECT n_regionkey, c_custkey, count(o_orderkey) * 5 AS n, coalesce(avg((o_orderstatus = 'F')::INT) - avg((o_orderstatus = 'O')::INT), 0) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1""")
def score_by_group(spark, d):
    is_ = lambda x: F.avg((F.col("o_orderstatus") == x).cast("int"))
    o = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("*") * 5).alias("n"), (is_("F") - is_("O")).alias("s"))
    c = X.table(spark, d, "customer").join(F.broadcast(X.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(o, "c_custkey", "left").fillna(0, ["n", "s"])
    score = F.avg(F.when(F.col("n") >= 55, F.col("s")))
    g = c.groupBy(F.col("n_regionkey").alias("g")).agg(F.avg((F.col("n") >= 55).cast("int")).alias("testable"), score.alias("score"), F.when(score >= 0.05, "strong").when(score >= 0, "weak").otherwise("none").alias("label"), F.count_if(F.col("s") > 0).alias("positive"))
    return r(g, 6, "testable", "score")


@query("""WITH e AS (SELECT regexp_extract('on ' || strftime(o_orderdate, '%d.%m.%Y') || ' no 17', '(19|20)[0-9]{2}')::INTEGER AS year, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS s, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT n_nationkey, y.y::INTEGER AS year, coalesce(sum(s), 0)::BIGINT AS net FROM nation CROSS JOIN range(1994, 2003) y(y) LEFT JOIN e ON e.c_nationkey = n_nationkey AND e.year = y.y GROUP BY ALL""")
def signed_event_count(spark, d):
    o = X.table(spark, d, "orders").join(X.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    note = F.concat(F.lit("on "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" no 17"))
    sign = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0)
    net = o.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.regexp_extract(note, "(19|20)[0-9]{2}", 0).cast("int").alias("year")).agg(F.sum(sign).alias("net"))
    grid = X.table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1994), F.lit(2002))).alias("year"))
    return grid.join(net, ["n_nationkey", "year"], "left").fillna(0, ["net"])


YTD = """q AS (SELECT series_id, year(date)::INTEGER AS year, quarter(date)::INTEGER AS q, round(sum(value), 2) AS v FROM fx GROUP BY 1, 2, 3), f AS (SELECT series_id, year, round(sum(v), 2) AS fy, CASE WHEN year % 3 = 0 THEN 0 WHEN year % 3 = 1 THEN NULL ELSE round(sum(v) FILTER (WHERE q <= 3), 2) END AS ytd FROM q GROUP BY 1, 2 HAVING count(*) = 4)"""


@query(f"WITH {FX}, {YTD} SELECT f.series_id, f.year, round(fy - coalesce(nullif(ytd, 0), (SELECT sum(v) FROM q WHERE q.series_id = f.series_id AND q.year = f.year AND q.q <= 3)), 1) AS q4 FROM f")
def q4_from_full_year(spark, d):
    q = X.nation_series(spark, d).groupBy("series_id", F.year("date").alias("year"), F.quarter("date").alias("q")).agg(F.round(F.sum("value"), 2).alias("v"))
    first = F.sum(F.when(F.col("q") <= 3, F.col("v")))
    told = F.when(F.col("year") % 3 == 0, 0.0).when(F.col("year") % 3 == 2, F.round(first, 2))
    g = q.groupBy("series_id", "year").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("fy"), told.alias("ytd"), first.alias("parts")).where("n = 4")
    return r(T.fourth_quarter(g), 1, "q4").select("series_id", "year", "q4")


@query("""WITH c AS (SELECT n_regionkey AS parent, n_nationkey AS child, round(coalesce(sum(s_acctbal) FILTER (WHERE s_acctbal > 5000), 0), 2) AS v FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2), p AS (SELECT n_regionkey AS parent, round(coalesce(sum(s_acctbal), 0), 2) AS pv FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT parent, child, CASE WHEN v = 0 AND pv <> 0 THEN pv ELSE v END AS value FROM c JOIN p USING (parent)""")
def parent_fallback(spark, d):
    n = X.table(spark, d, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child"))
    s = X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("child"), "s_acctbal")
    both = n.join(s, "child", "left")
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    child = both.groupBy("parent", "child").agg(total(F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal"))).alias("v"))
    parent = both.groupBy("parent").agg(total(F.col("s_acctbal")).alias("pv"))
    return child.join(parent, "parent").select("parent", "child", F.when((F.col("v") == 0) & (F.col("pv") != 0), F.col("pv")).otherwise(F.col("v")).alias("value"))


SEGMENTS = "sg AS (SELECT topic, series_id, make_date(1995 + 2 * (row_number() OVER (PARTITION BY topic ORDER BY series_id) - 1)::INTEGER, 1, 1) AS a, make_date(1997 + 2 * (row_number() OVER (PARTITION BY topic ORDER BY series_id) - 1)::INTEGER, 1, 1) AS b FROM fc)"


@query(f"WITH {FX}, {FC}, {SEGMENTS}, s AS (SELECT topic, date, value, fx.series_id, value / lag(value) OVER (PARTITION BY topic, fx.series_id ORDER BY date) - 1 AS ret FROM fx JOIN sg ON fx.series_id = sg.series_id AND date >= a AND date < b) SELECT topic, date, series_id, round(value, 2) AS value, round(ret, 8) AS ret FROM s")
def splice_segments(spark, d):
    at = F.row_number().over(Window.partitionBy("topic").orderBy("series_id")) - 1
    bound = lambda k: F.make_date(1995 + 2 * F.col("_k") + k, F.lit(1), F.lit(1))
    segments = X.catalogue(spark, d).withColumn("_k", at).select("topic", "series_id", bound(0).alias("start"), bound(2).alias("end"))
    return r(r(T.splice(X.nation_series(spark, d), segments, "topic"), 2, "value"), 8, "ret").select("topic", "date", "series_id", "value", "ret")


@query(f"""WITH {FD}, l AS (SELECT series_id, date, value, CASE WHEN day(date) = 15 THEN 2 ELSE 1 END AS split, CASE WHEN day(date) = 1 THEN 50 ELSE 0 END AS dividend, lag(value) {BY}) AS p FROM fd), q AS (SELECT *, ln(value / p) + ln(split) + dividend / p AS x FROM l)
SELECT series_id, date, round(x, 6) AS ret, round(exp(sum(coalesce(x, 0)) {BY} ROWS UNBOUNDED PRECEDING)), 6) AS level FROM q""")
def event_adjusted_log_return(spark, d):
    fd = X.daily_prices(spark, d).withColumns({"split": F.when(F.day("date") == 15, 2).otherwise(1), "dividend": F.when(F.day("date") == 1, 50).otherwise(0)})
    return r(T.adjusted_returns(fd), 6, "ret", "level").select("series_id", "date", "ret", "level")


SEASONAL = f"""s AS (SELECT series_id, month(date) AS m, avg(s) AS f FROM (SELECT *, value / sum(value) OVER w AS s, count(*) OVER w AS n FROM fx WINDOW w AS (PARTITION BY series_id, year(date))) WHERE n = 12 AND year(date) < 2000 GROUP BY 1, 2)"""


@query(f"""WITH {FX}, {SEASONAL}, b AS (SELECT series_id, sum(value) FILTER (WHERE year(date) = 1999) AS base, sum(value) FILTER (WHERE year(date) = 1999) / sum(value) FILTER (WHERE year(date) = 1998) - 1 AS trend, count(*) FILTER (WHERE year(date) IN (1998, 1999)) AS n FROM fx GROUP BY 1)
SELECT series_id, date, round(f * base * (1 + trend), 3) AS counterfactual, round(value - f * base * (1 + trend), 3) + 0.0 AS gap FROM fx JOIN b USING (series_id) JOIN s ON s.series_id = fx.series_id AND s.m = month(date) WHERE year(date) = 2000 AND n = 24""".replace("SELECT series_id, date, round(f *", "SELECT fx.series_id, date, round(f *").replace("JOIN b USING (series_id) JOIN s", "JOIN b ON b.series_id = fx.series_id JOIN s"))
def seasonal_counterfactual(spark, d):
    fx = X.nation_series(spark, d)
    factors = T.seasonal_factors(fx.where(F.year("date") < 2000))
    in_ = lambda y: F.sum(F.when(F.year("date") == y, F.col("value")))
    base = fx.groupBy("series_id").agg(in_(1999).alias("base"), (in_(1999) / in_(1998) - 1).alias("trend"), F.count_if(F.year("date").isin(1998, 1999)).alias("n")).where("n = 24")
    out = fx.where(F.year("date") == 2000).withColumn("month", F.month("date")).join(factors, ["series_id", "month"]).join(base, "series_id")
    cf = F.col("factor") * F.col("base") * (1 + F.col("trend"))
    return r(out.select("series_id", "date", cf.alias("counterfactual"), (F.col("value") - cf).alias("gap")), 3, "counterfactual", "gap")


ONE_BREAK = "SELECT DATE '1999-07-01' AS \"at\""


def did_sql(breaks: str) -> str:
    """CTE wd: series, break: growth of the six months after the break on a year before, less that of the six before it."""
    return f"""bk AS ({breaks}), wy AS (SELECT a.series_id, a.date, a.value AS v, b.value AS p FROM fx a JOIN fx b ON a.series_id = b.series_id AND b.date = (a.date - INTERVAL 1 YEAR)::DATE),
wd AS (SELECT series_id, "at", CASE WHEN count(*) FILTER (WHERE date >= "at") = 6 AND count(*) FILTER (WHERE date < "at") = 6 THEN 100 * (sum(v) FILTER (WHERE date >= "at") / sum(p) FILTER (WHERE date >= "at") - sum(v) FILTER (WHERE date < "at") / sum(p) FILTER (WHERE date < "at")) END AS did
FROM wy JOIN bk ON date >= ("at" - INTERVAL 6 MONTH)::DATE AND date < ("at" + INTERVAL 6 MONTH)::DATE GROUP BY 1, 2)"""


@query(f"WITH {FX}, {did_sql(ONE_BREAK)} SELECT series_id, \"at\", round(did, 6) AS did FROM wd")
def window_yoy_did(spark, d):
    fx = X.nation_series(spark, d)
    breaks = fx.select(F.lit("1999-07-01").cast("date").alias("at")).distinct()
    return r(T.window_did(fx, breaks, 6), 6, "did")


EVERY_BREAK = 'SELECT DISTINCT date AS "at" FROM fx WHERE year(date) BETWEEN 1997 AND 2000'


@query(f"WITH {FX}, {did_sql(EVERY_BREAK)} SELECT series_id, \"at\", round(did, 6) AS did FROM wd")
def placebo_breaks(spark, d):
    fx = X.nation_series(spark, d)
    return r(T.window_did(fx, fx.where(F.year("date").between(1997, 2000)).select(F.col("date").alias("at")).distinct(), 6), 6, "did")


@query(f"""WITH {FX}, {did_sql(EVERY_BREAK)}, o AS (SELECT series_id, did AS own FROM wd WHERE "at" = DATE '1999-07-01' AND did IS NOT NULL), x AS (SELECT wd.series_id, own, did FROM wd JOIN o USING (series_id) WHERE did IS NOT NULL AND abs(date_diff('month', "at", DATE '1999-07-01')) > 6)
SELECT series_id, round(own, 5) AS did, count(*) AS n, round((count(*) FILTER (WHERE did <= own) + 1) / (count(*) + 1), 6) AS p, round(own - quantile_cont(did, 0.95), 4) AS low, round(own - quantile_cont(did, 0.05), 4) AS high FROM x GROUP BY series_id, own""")
def placebo_interval(spark, d):
    fx = X.nation_series(spark, d)
    all_ = T.window_did(fx, fx.where(F.year("date").between(1997, 2000)).select(F.col("date").alias("at")).distinct(), 6).where("did is not null")
    own = all_.where("at = date'1999-07-01'").select("series_id", F.col("did").alias("own"))
    months = F.abs((F.year("at") - 1999) * 12 + F.month("at") - 7)
    g = all_.where(months > 6).join(own, "series_id").groupBy("series_id", "own").agg(F.count("*").alias("n"), ((F.count_if(F.col("did") <= F.col("own")) + 1) / (F.count("*") + 1)).alias("p"), (F.col("own") - F.percentile("did", F.lit(0.95))).alias("low"), (F.col("own") - F.percentile("did", F.lit(0.05))).alias("high"))
    return r(r(r(g.withColumnRenamed("own", "did"), 5, "did"), 6, "p"), 4, "low", "high")


@query("""WITH y AS (SELECT p_brand, year(l_shipdate) AS y, l_returnflag = 'R' AS here, sum(l_extendedprice) / sum(l_quantity) AS uv FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), r AS (SELECT a.p_brand, a.y, ln(a.uv / b.uv) AS r FROM y a JOIN y b ON a.p_brand = b.p_brand AND a.y = b.y AND a.here AND NOT b.here),
b AS (SELECT p_brand, avg(r) AS base FROM r WHERE y < 1998 GROUP BY 1) SELECT p_brand, y::INTEGER AS year, round(r - base, 8) + 0.0 AS ratio FROM r JOIN b USING (p_brand) WHERE y >= 1998""")
def unit_value_ratio(spark, d):
    l = X.table(spark, d, "lineitem").join(X.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    uv = lambda here: F.sum(F.when((F.col("l_returnflag") == "R") == here, F.col("l_extendedprice"))) / F.sum(F.when((F.col("l_returnflag") == "R") == here, F.col("l_quantity")))
    y = l.groupBy("p_brand", F.year("l_shipdate").alias("year")).agg(F.log(uv(True) / uv(False)).alias("r")).where("r is not null")
    base = y.where("year < 1998").groupBy("p_brand").agg(F.avg("r").alias("base"))
    return r(y.where("year >= 1998").join(base, "p_brand").select("p_brand", "year", (F.col("r") - F.col("base")).alias("ratio")), 8, "ratio")


@query(f"""WITH {FD}, e AS (SELECT DISTINCT series_id, (DATE '1996-02-10' + (k * 150)::INTEGER) AS event FROM fd, range(12) t(k)), v AS (SELECT series_id, event, (SELECT arg_max(value, date) FROM fd WHERE fd.series_id = e.series_id AND date < event - 30 AND date >= event - 44) AS a, (SELECT arg_max(value, date) FROM fd WHERE fd.series_id = e.series_id AND date < event AND date >= event - 10) AS b FROM e)
SELECT series_id, event, round(b - a, 4) AS change, round((b - a - avg(b - a) OVER (PARTITION BY series_id)) / stddev_samp(b - a) OVER (PARTITION BY series_id), 6) AS z, b - a BETWEEN quantile_cont(b - a, 0.25) OVER (PARTITION BY series_id) AND quantile_cont(b - a, 0.75) OVER (PARTITION BY series_id) AS usual FROM v WHERE a IS NOT NULL AND b IS NOT NULL""")
def pre_event_change(spark, d):
    fd = X.daily_prices(spark, d).select("series_id", "date", "value")
    events = fd.select("series_id").distinct().withColumn("event", F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.date_add(F.lit("1996-02-10").cast("date"), (k * 150).cast("int")))))
    out = T.change_before(fd, events, 30, 14, 10)
    return r(r(out, 4, "change"), 6, "z").select("series_id", "event", "change", "z", "usual")


@query(f"""WITH {FX}, a AS (SELECT series_id, year(date) AS y, round(sum(value), 2) AS v FROM fx GROUP BY 1, 2), b AS (SELECT series_id, y, v * 2 + y AS v FROM a), c AS (SELECT series_id, y, v - lag(v) OVER (PARTITION BY series_id ORDER BY y) AS dv, 1 AS s FROM a UNION ALL SELECT series_id, y, v - lag(v) OVER (PARTITION BY series_id ORDER BY y), 2 FROM b)
SELECT series_id, y::INTEGER AS year, CASE WHEN y <> 1998 THEN round(dv, 1) END AS change FROM c WHERE (s = 1 AND y < 1998) OR (s = 2 AND y >= 1998)""")
def splice_changes(spark, d):
    a = X.nation_series(spark, d).groupBy("series_id", F.year("date").alias("year")).agg(F.round(F.sum("value"), 2).alias("v"))
    b = a.withColumn("v", F.col("v") * 2 + F.col("year"))
    change = F.col("v") - F.lag("v").over(Window.partitionBy("series_id").orderBy("year"))
    both = a.withColumn("change", change).where("year < 1998").unionByName(b.withColumn("change", change).where("year >= 1998"))
    return r(both.select("series_id", "year", F.when(F.col("year") != 1998, F.col("change")).alias("change")), 1, "change")


@query(f"WITH {FX}, y AS (SELECT series_id, year(date) AS y, avg(value) AS target FROM fx GROUP BY 1, 2) SELECT fx.series_id, date, round((12 - month(date)) / 12 * a.target + month(date) / 12 * b.target, 4) AS blend FROM fx JOIN y a ON a.series_id = fx.series_id AND a.y = year(date) JOIN y b ON b.series_id = fx.series_id AND b.y = year(date) + 1")
def horizon_blend(spark, d):
    fx = X.nation_series(spark, d).withColumn("year", F.year("date"))
    target = fx.groupBy("series_id", "year").agg(F.avg("value").alias("now"))
    then = target.select("series_id", (F.col("year") - 1).alias("year"), F.col("now").alias("then"))
    m = F.month("date")
    return r(fx.join(target, ["series_id", "year"]).join(then, ["series_id", "year"]).select("series_id", "date", ((12 - m) / 12 * F.col("now") + m / 12 * F.col("then")).alias("blend")), 4, "blend")


@query(f"""WITH {FX}, f AS (SELECT *, (year(date) * 12 + month(date)) - row_number() OVER (PARTITION BY series_id ORDER BY date) AS run FROM fx WHERE value < 600000) SELECT series_id, min(date) AS start, (max(date) + INTERVAL 1 MONTH)::DATE AS "end", count(*) AS n FROM f GROUP BY series_id, run""")
def threshold_intervals(spark, d):
    low = X.nation_series(spark, d).where("value < 600000")
    run = F.year("date") * 12 + F.month("date") - F.row_number().over(T.by())
    return low.withColumn("_run", run).groupBy("series_id", "_run").agg(F.min("date").alias("start"), F.add_months(F.max("date"), 1).alias("end"), F.count("*").alias("n")).drop("_run")


@query(f"""WITH {FX}, {FT}, y AS (SELECT series_id, avg(v) AS m, stddev_samp(v) AS s FROM (SELECT series_id, year(date), avg(value) AS v FROM fx GROUP BY 1, 2) GROUP BY 1)
SELECT fx.series_id, lean, round(avg(value), 4) AS mean, round((avg(value) - any_value(m)) / any_value(s), 6) + 0.0 AS z FROM fx JOIN ft ON date >= start AND date < "end" JOIN y ON y.series_id = fx.series_id GROUP BY 1, 2""")
def exact_interval_mean(spark, d):
    fx = X.nation_series(spark, d)
    y = fx.groupBy("series_id", F.year("date").alias("y")).agg(F.avg("value").alias("v")).groupBy("series_id").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    inside = J.interval_join(fx, X.terms(spark), how="inner").groupBy("series_id", "lean").agg(F.avg("value").alias("mean")).join(y, "series_id")
    return r(r(inside.withColumn("z", (F.col("mean") - F.col("m")) / F.col("s")), 4, "mean"), 6, "z").select("series_id", "lean", "mean", "z")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_limit(spark, d):
    """A top-k report: each task keeps ten rows."""
    return X.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT c_name AS name, c_acctbal AS bal, c_mktsegment AS segment, NULL::BIGINT AS key FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_suppkey FROM supplier")
def union_by_name(spark, d):
    a = X.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("SELECT DISTINCT p_brand, p_type, p_size FROM part")
def distinct_rows(spark, d):
    return X.table(spark, d, "part").select("p_brand", "p_type", "p_size").distinct()


@query(f"WITH {FX}, {FC}, p AS (SELECT a.series_id AS canonical, b.series_id AS alternate, count(*) AS n, round(corr(a.value, b.value), 6) AS corr FROM fx a JOIN fx b ON a.date = b.date AND a.series_id < b.series_id JOIN fc x ON x.series_id = a.series_id JOIN fc y ON y.series_id = b.series_id AND y.topic = x.topic GROUP BY 1, 2) SELECT p.*, x.agg AS canonical_agg, y.agg AS alternate_agg FROM p LEFT JOIN (SELECT * FROM fc WHERE agg <> 'last') x ON x.series_id = canonical LEFT JOIN (SELECT * FROM fc WHERE agg <> 'last') y ON y.series_id = alternate")
def v_reconciliation(spark, d):
    fx = X.nation_series(spark, d).join(_cat(spark, d), "series_id")
    pairs = L.comoving(fx, ["topic", "date"], "series_id", 1, -1.0).withColumnsRenamed({"a": "canonical", "b": "alternate"}).withColumn("corr", F.round("corr", 6))
    labels = X.catalogue(spark, d).where("agg <> 'last'")
    side = lambda end: labels.select(F.col("series_id").alias(end), F.col("agg").alias(f"{end}_agg"))
    return pairs.join(side("canonical"), "canonical", "left").join(side("alternate"), "alternate", "left")


@query("""WITH o AS (SELECT p_partkey AS series_id, p_brand AS classif1, p_type || '|' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'X9' END AS classif2 FROM part), l AS (SELECT DISTINCT p_brand AS code, 'Brand ' || substr(p_brand, 7) AS label FROM part UNION SELECT DISTINCT p_type, lower(p_type) FROM part)
SELECT series_id, classif1, l1.label AS dim1, classif2, (SELECT string_agg(coalesce(l.label, x), ' | ' ORDER BY i) FROM (SELECT unnest(string_split(classif2, '|')) AS x, generate_subscripts(string_split(classif2, '|'), 1) AS i) LEFT JOIN l ON l.code = x) AS breakdown FROM o LEFT JOIN l l1 ON l1.code = o.classif1""")
def v_observations_dims(spark, d):
    p = X.table(spark, d, "part")
    o = p.select(F.col("p_partkey").alias("series_id"), F.col("p_brand").alias("classif1"), F.concat_ws("|", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit("X9"))).alias("classif2"))
    labels = p.select(F.col("p_brand").alias("code"), F.concat(F.lit("Brand "), F.substring("p_brand", 7, 100)).alias("label")).union(p.select("p_type", F.lower("p_type"))).distinct()
    parts = o.select("series_id", F.posexplode(F.split("classif2", r"\|")).alias("i", "code")).join(labels, "code", "left")
    text = parts.groupBy("series_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("label", "code").alias("x")))), lambda s: s["x"]), " | ").alias("breakdown"))
    one = labels.select(F.col("code").alias("classif1"), F.col("label").alias("dim1"))
    return o.join(one, "classif1", "left").join(text, "series_id").select("series_id", "classif1", "dim1", "classif2", "breakdown")


@query("SELECT o_orderkey, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P'")
def drop_missing(spark, d):
    """Values of pending orders are missing in three ways: not a number, infinite, null."""
    odd = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(float("nan"))).when(F.col("o_orderpriority") == "2-HIGH", F.lit(float("-inf")))
    rows = X.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", odd).otherwise(F.col("o_totalprice")).alias("value"))
    return R.finite(rows, "value")


@query("""WITH h AS (SELECT o_custkey, c_nationkey, sum(o_totalprice) AS v, bool_or(o_orderstatus = 'P') AS flag FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2), g AS (SELECT c_nationkey, sum(v) FILTER (WHERE flag) / sum(v) > 0.5 AS most FROM h GROUP BY 1)
SELECT c_custkey, coalesce(h.flag, g.most, false) AS predicted, CASE WHEN h.flag IS NOT NULL THEN 'item' WHEN g.most IS NOT NULL THEN 'group' ELSE 'none' END AS basis FROM customer LEFT JOIN h ON h.o_custkey = c_custkey LEFT JOIN g ON g.c_nationkey = customer.c_nationkey""")
def carry_forward_majority(spark, d):
    """An item's class is what it ever was before; one not seen before takes its group's majority by volume."""
    c = X.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    past = X.table(spark, d, "orders").where("o_orderdate < timestamp'1996-01-01 00:00:00'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("v"), F.bool_or(F.col("o_orderstatus") == "P").alias("flag"))
    seen = c.join(past, "c_custkey", "left")
    most = seen.where("v is not null").groupBy("c_nationkey").agg((F.coalesce(F.sum(F.when(F.col("flag"), F.col("v"))), F.lit(0.0)) / F.sum("v") > 0.5).alias("most"))
    out = seen.join(most, "c_nationkey", "left")
    basis = F.when(F.col("flag").isNotNull(), "item").when(F.col("most").isNotNull(), "group").otherwise("none")
    return out.select("c_custkey", F.coalesce("flag", "most", F.lit(False)).alias("predicted"), basis.alias("basis"))
