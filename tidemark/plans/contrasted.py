"""Registered queries of contrasts, panels, apportioning and attribution, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import panel as P
from tidemark.operators import regression as G
from tidemark.operators import sampling as S
from tidemark.operators import timeseries as T
from tidemark.sources import tables as X

from .sampled import boot_sql, draw_sql, quantile_sql
from .warehouse import FC, FT, FX, query


def r(df, places, *columns):
    """Rounded, with minus zero as zero."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def _topics(spark, d):
    return X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic", "agg")), "series_id")


LINES = "ln_ AS (SELECT p_brand, l_returnflag, l_suppkey, l_partkey, year(l_shipdate)::INTEGER AS y, month(l_shipdate)::INTEGER AS m, l_extendedprice AS v, l_quantity AS q, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _lines(spark, d):
    part = X.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    li = X.table(spark, d, "lineitem").join(part, "l_partkey")
    return li.select("p_brand", "l_returnflag", "l_suppkey", "l_partkey", F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("q"), "l_tax")


@query("SELECT o_orderkey, a.n_name AS buyer, b.n_name AS seller FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = o_custkey LEFT JOIN nation b ON b.n_nationkey = s_nationkey")
def join_left_twice(spark, d):
    n = X.table(spark, d, "nation")
    name = lambda key, label: F.broadcast(n.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(label)))
    o = X.table(spark, d, "orders").join(X.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    o = o.join(X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_custkey"), "s_nationkey"), "o_custkey", "left")
    return o.join(name("c_nationkey", "buyer"), "c_nationkey", "left").join(name("s_nationkey", "seller"), "s_nationkey", "left").select("o_orderkey", "buyer", "seller")


@query(f'WITH {FX}, {FT} SELECT series_id, date, value, lean FROM fx JOIN ft ON last_day(date) >= start AND last_day(date) <= "end" - 1')
def interval_join_closed(spark, d):
    """Months whose last day lies inside a term, both ends included."""
    terms = F.broadcast(X.terms(spark).withColumn("end", F.date_sub("end", 1)))
    fx = X.nation_series(spark, d).withColumn("_end", F.last_day("date"))
    return fx.join(terms, F.col("_end").between(F.col("start"), F.col("end"))).select("series_id", "date", "value", "lean")


@query("""WITH s AS (SELECT l_partkey, l_suppkey, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY (s_nationkey = 3) DESC, count(*) DESC, l_suppkey) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, l_suppkey, s_nationkey) SELECT l_partkey, l_suppkey, n FROM s WHERE k = 1""")
def home_source_choice(spark, d):
    s = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") == 3).alias("home"))
    n = X.table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).join(s, "l_suppkey")
    return T.dedupe(n, ["l_partkey"], [F.desc("home"), F.desc("n"), F.col("l_suppkey")]).select("l_partkey", "l_suppkey", "n")


@query(f"WITH {LINES}, s AS (SELECT p_brand, l_returnflag, sum(v) / sum(sum(v)) OVER (PARTITION BY p_brand) AS sh FROM ln_ WHERE y = 1996 GROUP BY 1, 2), t AS (SELECT p_brand, y, sum(v) AS total FROM ln_ GROUP BY 1, 2) SELECT y, l_returnflag, round(sum(total * sh), 1) AS value FROM t JOIN s USING (p_brand) GROUP BY 1, 2")
def apportion(spark, d):
    l = _lines(spark, d)
    base = l.where("y = 1996").groupBy("p_brand", "l_returnflag").agg(F.sum("v").alias("b"))
    share = base.select("p_brand", "l_returnflag", (F.col("b") / F.sum("b").over(Window.partitionBy("p_brand"))).alias("sh"))
    return r(l.groupBy("p_brand", "y").agg(F.sum("v").alias("t")).join(share, "p_brand").groupBy("y", "l_returnflag").agg(F.sum(F.col("t") * F.col("sh")).alias("value")), 1, "value")


@query("""WITH l AS (SELECT l_partkey, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) AS owner FROM lineitem GROUP BY 1) SELECT p_partkey, CASE WHEN s_suppkey IS NOT NULL AND s_nationkey % 2 <> p_size % 2 THEN -s_suppkey ELSE coalesce(owner, -1) END AS owner, CASE WHEN s_suppkey IS NOT NULL AND s_nationkey % 2 <> p_size % 2 THEN 'register' WHEN owner IS NULL THEN 'none' ELSE 'last known' END AS basis FROM part LEFT JOIN l ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = p_partkey""")
def attribution_override(spark, d):
    """The last known owner of an item, unless the register shows an owner of another class."""
    last = X.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max_by("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("last"))
    register = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_suppkey").alias("reg"), (F.col("s_nationkey") % 2).alias("class"))
    p = X.table(spark, d, "part").join(last, "p_partkey", "left").join(register, "p_partkey", "left")
    changed = F.col("reg").isNotNull() & (F.col("class") != F.col("p_size") % 2)
    return p.select("p_partkey", F.when(changed, -F.col("reg")).otherwise(F.coalesce("last", F.lit(-1))).alias("owner"), F.when(changed, "register").when(F.col("last").isNull(), "none").otherwise("last known").alias("basis"))


@query("""WITH c AS (SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS leaf FROM orders), l AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN lpad((s_suppkey * 97)::VARCHAR, 10, '0')[1:8] ELSE lpad((s_suppkey * 97)::VARCHAR, 10, '0') END AS code, s_suppkey % 2 = 0 AS part FROM supplier),
f AS (SELECT leaf, max(CASE WHEN part THEN 0.5 ELSE 1 END) AS f FROM c JOIN l ON l.code = leaf OR l.code = leaf[1:8] OR l.code = leaf[1:6] OR l.code = leaf[1:4] GROUP BY 1) SELECT c.leaf[1:8] AS parent, count(*) AS leaves, round(sum(coalesce(f, 0)) / count(*), 6) AS covered FROM c LEFT JOIN f USING (leaf) GROUP BY 1""")
def hier_code_match(spark, d):
    code = lambda k: F.lpad(F.col(k).cast("string"), 10, "0")
    leaves = X.table(spark, d, "orders").select(code("o_orderkey").alias("leaf"))
    s = X.table(spark, d, "supplier").withColumn("c", F.lpad((F.col("s_suppkey") * 97).cast("string"), 10, "0"))
    listed = s.select(F.when(F.col("s_suppkey") % 3 == 0, F.substring("c", 1, 8)).otherwise(F.col("c")).alias("code"), F.when(F.col("s_suppkey") % 2 == 0, 0.5).otherwise(1.0).alias("f"))
    return r(J.cover_by_prefix(leaves, "leaf", listed, (4, 6, 8, 10), 8), 6, "covered")


@query("""WITH w AS (SELECT c_custkey AS code, year(o_orderdate)::INTEGER AS wave, round(avg(o_totalprice), 2) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), t AS (SELECT c_custkey AS code, 1998 + c_custkey % 3 AS year FROM customer)
SELECT code, year, wave, score FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY abs(wave - year), wave) AS k FROM t JOIN w USING (code)) WHERE k = 1""")
def nearest_wave(spark, d):
    w = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("wave")).agg(F.round(F.avg("o_totalprice"), 2).alias("score"))
    t = X.table(spark, d, "customer").select(F.col("c_custkey").alias("code"), (1998 + F.col("c_custkey") % 3).alias("year"))
    best = F.min_by(F.struct("wave", "score"), F.struct(F.abs(F.col("wave") - F.col("year")), "wave"))
    return t.join(w, "code").groupBy("code", "year").agg(best.alias("b")).select("code", "year", "b.*")


@query("SELECT o_custkey, year, o_orderkey, o_orderpriority AS basis FROM (SELECT *, year(o_orderdate)::INTEGER AS year, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders) WHERE k = 1")
def basis_preference(spark, d):
    rank = F.when(F.col("o_orderpriority") == "3-MEDIUM", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    o = X.table(spark, d, "orders").withColumns({"year": F.year("o_orderdate"), "_r": rank})
    return T.dedupe(o, ["o_custkey", "year"], [F.col("_r"), F.col("o_orderkey")]).select("o_custkey", "year", "o_orderkey", F.col("o_orderpriority").alias("basis"))


@query(f"""WITH {FX}, {FC}, y AS (SELECT series_id, topic, avg(value) FILTER (WHERE date < DATE '1997-07-01') AS a, avg(value) FILTER (WHERE date >= DATE '1997-07-01') AS b FROM fx JOIN fc USING (series_id) GROUP BY 1, 2), l AS (SELECT regr_slope(b - a, a) AS s, regr_intercept(b - a, a) AS i FROM y)
SELECT topic, count(*) AS n, round(avg(b - a - i - s * a), 3) + 0.0 AS adjusted FROM y, l GROUP BY 1""")
def start_adjusted_delta(spark, d):
    """Change from one term to the next less what its start predicts, by group."""
    early = F.col("date") < F.lit("1997-07-01").cast("date")
    side = lambda c: F.avg(F.when(c, F.col("value")))
    y = _topics(spark, d).groupBy("series_id", "topic").agg(side(early).alias("a"), side(~early).alias("b")).withColumn("change", F.col("b") - F.col("a"))
    line = F.broadcast(G.ols(y.withColumn("_k", F.lit(1)), ["_k"], "change", ["a"]).select("intercept", F.get("beta", 0).alias("_s")))  # one row
    left = y.join(line, F.lit(True)).withColumn("rest", F.col("change") - F.col("intercept") - F.col("_s") * F.col("a"))
    return r(left.groupBy("topic").agg(F.count("*").alias("n"), F.avg("rest").alias("adjusted")), 3, "adjusted")


@query(f"""WITH {LINES}, g AS (SELECT p_brand, y, m, coalesce(sum(v) FILTER (WHERE l_returnflag = 'R'), 0) AS us, coalesce(sum(v) FILTER (WHERE l_returnflag <> 'R'), 0) AS row_ FROM ln_ GROUP BY 1, 2, 3), b AS (SELECT p_brand, 0.01 * avg(us) AS k FROM g WHERE y = 1996 GROUP BY 1), x AS (SELECT p_brand, y, m, ln(us + k) - ln(row_ + k) AS t, us / (us + row_) AS share FROM g JOIN b USING (p_brand))
SELECT a.p_brand, a.y AS year, a.m AS month, round(a.t - p.t, 6) + 0.0 AS seasonal, round(a.share - p.share, 6) + 0.0 AS share FROM x a JOIN x p ON p.p_brand = a.p_brand AND p.m = a.m AND p.y = a.y - 1 WHERE a.y >= 1999""")
def triple_diff_outcome(spark, d):
    l = _lines(spark, d)
    at = lambda c: F.coalesce(F.sum(F.when(c, F.col("v"))), F.lit(0.0))
    g = l.groupBy("p_brand", "y", "m").agg(at(F.col("l_returnflag") == "R").alias("us"), at(F.col("l_returnflag") != "R").alias("rest"))
    k = g.where("y = 1996").groupBy("p_brand").agg((0.01 * F.avg("us")).alias("k"))
    x = g.join(k, "p_brand").select("p_brand", "y", "m", (F.log(F.col("us") + F.col("k")) - F.log(F.col("rest") + F.col("k"))).alias("t"), (F.col("us") / (F.col("us") + F.col("rest"))).alias("s"))
    before = x.select("p_brand", (F.col("y") + 1).alias("y"), "m", F.col("t").alias("t0"), F.col("s").alias("s0"))
    out = x.where("y >= 1999").join(before, ["p_brand", "y", "m"])
    return r(out.select("p_brand", F.col("y").alias("year"), F.col("m").alias("month"), (F.col("t") - F.col("t0")).alias("seasonal"), (F.col("s") - F.col("s0")).alias("share")), 6, "seasonal", "share")


GAP = f"""g AS (SELECT p_brand, sum(q) FILTER (WHERE y = 1999 AND l_returnflag = 'R') AS now, sum(q) FILTER (WHERE y = 1998 AND l_returnflag = 'R') AS before, sum(q) FILTER (WHERE y = 1999 AND l_returnflag <> 'R') / sum(q) FILTER (WHERE y = 1998 AND l_returnflag <> 'R') AS other, sum(q) FILTER (WHERE y = 1998 AND l_returnflag = 'R') / sum(q) FILTER (WHERE y = 1997 AND l_returnflag = 'R') AS own,
sum(v) FILTER (WHERE y = 1999) / sum(q) FILTER (WHERE y = 1999) AS price, sum(q) FILTER (WHERE y = 1999 AND l_returnflag <> 'R') - sum(q) FILTER (WHERE y = 1998 AND l_returnflag <> 'R') AS offset_ FROM ln_ WHERE m <= 6 GROUP BY 1)"""


def _gaps(spark, d):
    l = _lines(spark, d).where("m <= 6")
    flag = F.col("l_returnflag") == "R"
    q = lambda y, c: F.sum(F.when((F.col("y") == y) & c, F.col("q")))
    price = F.sum(F.when(F.col("y") == 1999, F.col("v"))) / F.sum(F.when(F.col("y") == 1999, F.col("q")))
    return l.groupBy("p_brand").agg(q(1999, flag).alias("now"), q(1998, flag).alias("before"), (q(1999, ~flag) / q(1998, ~flag)).alias("other"), (q(1998, flag) / q(1997, flag)).alias("own"), price.alias("price"), (q(1999, ~flag) - q(1998, ~flag)).alias("offset"))


@query(f"WITH {LINES}, {GAP} SELECT p_brand, round(now - before * other, 4) + 0.0 AS gap_control, round(now - before * own, 4) + 0.0 AS gap_own, round(2 * price * (now - before * other), 1) + 0.0 AS value_control FROM g")
def product_gap_did(spark, d):
    """Gap to what a control group, or the item's own growth, would have given, valued at the window's price, a year."""
    g = _gaps(spark, d)
    control = F.col("now") - F.col("before") * F.col("other")
    out = g.select("p_brand", control.alias("gap_control"), (F.col("now") - F.col("before") * F.col("own")).alias("gap_own"), (2 * F.col("price") * control).alias("value_control"))
    return r(r(out, 4, "gap_control", "gap_own"), 1, "value_control")


DIVERSION = "dv AS (SELECT p_brand AS item, 1 AS one, greatest(0, before - now) AS loss, CASE WHEN before > now THEN least(1, greatest(0, offset_ / (before - now))) END AS ratio FROM g)"


@query(f"""WITH {LINES}, {GAP}, {DIVERSION}, dk AS (SELECT one, loss, ratio, item AS date FROM dv), {boot_sql('dk', 'one', 'm.loss, m.ratio', 40, 1)}, v AS (SELECT rep, sum(loss * ratio) / sum(loss) AS v FROM d WHERE ratio IS NOT NULL GROUP BY 1) SELECT (SELECT round(sum(loss * ratio) / sum(loss), 6) FROM dv WHERE ratio IS NOT NULL) AS diversion, {quantile_sql('v', 6)} FROM v""")
def diversion_ratio(spark, d):
    """Share of losses that others took over, clipped by item, weighted by loss, with an interval over items drawn anew."""
    loss = F.greatest(F.lit(0.0), F.col("before") - F.col("now"))
    ratio = F.when(F.col("before") > F.col("now"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("offset") / (F.col("before") - F.col("now")))))
    items = _gaps(spark, d).select(F.lit(1).alias("one"), F.col("p_brand").alias("item"), loss.alias("loss"), ratio.alias("ratio"))
    mean = F.sum(F.when(F.col("ratio").isNotNull(), F.col("loss") * F.col("ratio"))) / F.sum(F.when(F.col("ratio").isNotNull(), F.col("loss")))
    reps = S.block_bootstrap(items, ["one"], ["item"], 40, 1).groupBy("one", "rep").agg(mean.alias("v"))
    own = items.groupBy("one").agg(mean.alias("diversion"))
    return r(own.join(S.interval(reps, ["one"], "v"), "one").drop("one"), 6, "diversion", "low", "mid", "high")


@query(f"""WITH {LINES}, p AS (SELECT l_suppkey AS unit, y AS t, p_brand[7:7] AS class, ln(sum(v)) AS y_, avg(ln(1 + l_tax)) AS x FROM ln_ GROUP BY 1, 2, 3), n AS (SELECT class, count(DISTINCT t) AS k FROM p GROUP BY 1), b AS (SELECT p.* FROM p JOIN n USING (class) QUALIFY count(*) OVER (PARTITION BY class, unit) = any_value(k) OVER (PARTITION BY class)),
a AS (SELECT class, y_ - avg(y_) OVER (PARTITION BY class, unit) - avg(y_) OVER (PARTITION BY class, t) + avg(y_) OVER (PARTITION BY class) AS dy, x - avg(x) OVER (PARTITION BY class, unit) - avg(x) OVER (PARTITION BY class, t) + avg(x) OVER (PARTITION BY class) AS dx FROM b)
SELECT class, count(*) AS n, round(sum(dx * dy) / sum(dx * dx), 4) + 0.0 AS elasticity FROM a GROUP BY 1""")
def intensity_elasticity(spark, d):
    """Two-way fixed effects of log value on the log of one plus the rate, by class, over units present at all times."""
    p = _lines(spark, d).groupBy(F.col("l_suppkey").alias("unit"), F.col("y").alias("t"), F.substring("p_brand", 7, 1).alias("class")).agg(F.log(F.sum("v")).alias("y"), F.avg(F.log1p("l_tax")).alias("x"))
    return r(P.twfe_by(P.balanced(p, "class", "unit", "t"), "class", "unit", "t", "y", "x").withColumnRenamed("beta", "elasticity"), 4, "elasticity")


@query(f"""WITH {LINES}, s AS (SELECT p_brand, l_suppkey, y, sum(v) AS v, sum(v) / sum(q) AS uv, avg(l_tax) AS rate FROM ln_ WHERE y IN (1996, 1999) GROUP BY 1, 2, 3), k AS (SELECT *, v / sum(v) OVER (PARTITION BY p_brand, y) AS share, row_number() OVER (PARTITION BY p_brand, y ORDER BY v DESC, l_suppkey) AS k FROM s),
t AS (SELECT a.p_brand, a.y, a.share, ln(a.uv / (sum(b.uv * b.v) / sum(b.v))) AS unit, a.rate - sum(b.rate * b.v) / sum(b.v) AS wedge FROM k a JOIN k b ON a.p_brand = b.p_brand AND a.y = b.y AND b.k BETWEEN 2 AND 9 WHERE a.k = 1 GROUP BY a.p_brand, a.y, a.share, a.uv, a.rate)
SELECT z.p_brand, round(z.share, 6) AS share, round(z.unit, 6) + 0.0 AS unit_value, round(z.wedge - x.wedge, 6) + 0.0 AS wedge_change FROM t x JOIN t z ON x.p_brand = z.p_brand AND x.y = 1996 AND z.y = 1999""")
def relative_wedge(spark, d):
    """The leading supplier of each item against the next eight: share, log unit value, and the change of its rate's lead."""
    s = _lines(spark, d).where("y in (1996, 1999)").groupBy("p_brand", "l_suppkey", "y").agg(F.sum("v").alias("v"), (F.sum("v") / F.sum("q")).alias("uv"), F.avg("l_tax").alias("rate"))
    w = Window.partitionBy("p_brand", "y")
    k = s.withColumns({"share": F.col("v") / F.sum("v").over(w), "k": F.row_number().over(w.orderBy(F.desc("v"), "l_suppkey"))})
    lead = k.where("k = 1").select("p_brand", "y", "share", F.col("uv").alias("uv1"), F.col("rate").alias("rate1"))
    weighted = lambda c: F.sum(F.col(c) * F.col("v")) / F.sum("v")
    rest = k.where("k between 2 and 9").groupBy("p_brand", "y").agg(weighted("uv").alias("uv"), weighted("rate").alias("rate"))
    t = lead.join(rest, ["p_brand", "y"]).select("p_brand", "y", "share", F.log(F.col("uv1") / F.col("uv")).alias("unit_value"), (F.col("rate1") - F.col("rate")).alias("wedge"))
    old = t.where("y = 1996").select("p_brand", F.col("wedge").alias("w0"))
    return r(t.where("y = 1999").join(old, "p_brand").select("p_brand", "share", "unit_value", (F.col("wedge") - F.col("w0")).alias("wedge_change")), 6, "share", "unit_value", "wedge_change")


@query(f"""WITH {FX}, {FC}, q AS (SELECT topic, year(date)::INTEGER AS year, agg, avg(value) AS v FROM fx JOIN fc USING (series_id) GROUP BY 1, 2, 3), b AS (SELECT topic, agg, avg(v) AS m, stddev_samp(v) AS s FROM q WHERE year < 1999 GROUP BY 1, 2), z AS (SELECT topic, year, (v - m) / s * CASE agg WHEN 'last' THEN -1 ELSE 1 END AS z FROM q JOIN b USING (topic, agg) WHERE s > 0)
SELECT topic, year, count(*) AS components, round(avg(z), 6) + 0.0 AS composite FROM z GROUP BY 1, 2 HAVING count(*) >= 2""")
def zscore_signed_composite(spark, d):
    """Standard scores of a base period, signed, averaged where two components at least are there."""
    q = _topics(spark, d).groupBy("topic", "agg", F.year("date").alias("year")).agg(F.avg("value").alias("v"))
    b = q.where("year < 1999").groupBy("topic", "agg").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).where("s > 0")
    z = q.join(b, ["topic", "agg"]).withColumn("z", (F.col("v") - F.col("m")) / F.col("s") * F.when(F.col("agg") == "last", -1).otherwise(1))
    return r(z.groupBy("topic", "year").agg(F.count("*").alias("components"), F.avg("z").alias("composite")).where("components >= 2"), 6, "composite")


@query(f"""WITH {FX}, sp AS (SELECT * FROM (VALUES (1995, 2001, 0), (1996, 2001, 0), (1995, 2000, 0), (1995, 2001, 1), (1996, 2000, 1)) t(a, b, logs)), e AS (SELECT series_id, a, b, logs, regr_slope(CASE logs WHEN 1 THEN ln(value) * 1e5 ELSE value END, year(date)) AS s FROM fx JOIN sp ON year(date) BETWEEN a AND b GROUP BY 1, 2, 3, 4)
SELECT series_id, count(*) AS specs, round(avg((s > 0)::INT), 6) AS same_sign, round(min(s), 3) + 0.0 AS low, round(max(s), 3) + 0.0 AS high FROM e GROUP BY 1""")
def robustness_grid(spark, d):
    """One estimate over a grid of specifications."""
    specs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(x).alias("logs")) for a, b, x in ((1995, 2001, 0), (1996, 2001, 0), (1995, 2000, 0), (1995, 2001, 1), (1996, 2000, 1))])
    each = X.nation_series(spark, d).withColumn("y", F.year("date")).select("series_id", "y", "value", F.inline(specs)).where("y between a and b")
    e = each.groupBy("series_id", "a", "b", "logs").agg(F.regr_slope(F.when(F.col("logs") == 1, F.log("value") * 1e5).otherwise(F.col("value")), "y").alias("s"))
    out = e.groupBy("series_id").agg(F.count("*").alias("specs"), F.avg((F.col("s") > 0).cast("int")).alias("same_sign"), F.min("s").alias("low"), F.max("s").alias("high"))
    return r(r(out, 6, "same_sign"), 3, "low", "high")


@query("""WITH s AS (SELECT n_regionkey AS g, c_mktsegment AS party, sum(greatest(c_acctbal, 0)) AS seats FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), t AS (SELECT *, seats / sum(seats) OVER (PARTITION BY g) AS sh, CASE party WHEN 'AUTOMOBILE' THEN -2 WHEN 'BUILDING' THEN -1 WHEN 'FURNITURE' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS pos FROM s)
SELECT g, round(sum(sh) FILTER (WHERE pos < 0), 6) AS left_bloc, round(sum(sh * pos), 6) + 0.0 AS position, round(abs(sum(sh * pos) FILTER (WHERE pos < 0) / sum(sh) FILTER (WHERE pos < 0) - sum(sh * pos) FILTER (WHERE pos > 0) / sum(sh) FILTER (WHERE pos > 0)), 6) AS distance FROM t GROUP BY 1""")
def seat_share_blocs(spark, d):
    place = F.col("c_mktsegment")
    pos = F.when(place == "AUTOMOBILE", -2).when(place == "BUILDING", -1).when(place == "FURNITURE", 0).when(place == "MACHINERY", 1).otherwise(2)
    n = F.broadcast(X.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("g")))
    s = X.table(spark, d, "customer").join(n, "c_nationkey").groupBy("g", pos.alias("pos")).agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("seats"))
    t = s.withColumn("sh", F.col("seats") / F.sum("seats").over(Window.partitionBy("g")))
    part = lambda c, x: F.sum(F.when(c, x))
    sh, at = F.col("sh"), F.col("pos")
    centre = lambda c: part(c, sh * at) / part(c, sh)
    return r(t.groupBy("g").agg(part(at < 0, sh).alias("left_bloc"), F.sum(sh * at).alias("position"), F.abs(centre(at < 0) - centre(at > 0)).alias("distance")), 6, "left_bloc", "position", "distance")


@query(f"""WITH {FX}, a AS (SELECT * FROM fx WHERE year(date) < 1999), b AS (SELECT series_id, date, value * 3 + month(date) AS value FROM fx WHERE year(date) >= 1998), k AS (SELECT series_id, exp(avg(ln(a.value / b.value))) AS k FROM a JOIN b USING (series_id, date) GROUP BY 1)
SELECT series_id, date, round(value, 3) AS value FROM a UNION ALL SELECT series_id, date, round(value * k, 3) FROM b JOIN k USING (series_id) WHERE year(date) >= 1999""")
def tot_splice(spark, d):
    fx = X.nation_series(spark, d)
    a, b = fx.where(F.year("date") < 1999), fx.where(F.year("date") >= 1998).withColumn("value", F.col("value") * 3 + F.month("date"))
    return r(T.splice_by_overlap(a, b), 3, "value")


@query(f"""WITH {FX}, s AS (SELECT series_id, year(date)::INTEGER AS year, round(avg(value) / 1e5)::INTEGER AS score FROM fx GROUP BY 1, 2), n AS (SELECT s.series_id, rep, avg(score + {draw_sql("'n'", "s.series_id", "year", "rep")} % 3 - 1) AS v FROM s, range(40) t(rep) GROUP BY 1, 2)
SELECT series_id, {quantile_sql('v', 6)} FROM n GROUP BY 1""")
def rule_noise_draws(spark, d):
    """Means of coded scores under draws of one more, one less or none."""
    s = X.nation_series(spark, d).groupBy("series_id", F.year("date").alias("year")).agg(F.round(F.avg("value") / 1e5).cast("int").alias("score"))
    reps = S.replicates(s, 40)
    v = reps.groupBy("series_id", "rep").agg(F.avg(F.col("score") + S.draw(F.lit("n"), "series_id", "year", "rep") % 3 - 1).alias("v"))
    return r(S.interval(v, ["series_id"], "v"), 6, "low", "mid", "high")


SENTENCES = "st AS (SELECT source, doc_id * 1000000 + i AS date, length(trim(s)) AS n, len(regexp_extract_all(lower(s), '\\bthe\\b')) AS hits FROM (SELECT source, doc_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) - 1 AS i FROM documents WHERE lang = 'en') WHERE trim(s) <> '')"


@query(f"WITH {SENTENCES}, {boot_sql('st', 'source', 'm.n AS len_, m.hits', 10, 1)}, v AS (SELECT source, rep, 1000.0 * sum(hits) / sum(len_) AS v FROM d GROUP BY 1, 2) SELECT source, {quantile_sql('v', 5)} FROM v GROUP BY 1")
def sentence_bootstrap(spark, d):
    """Rate of a word over sentences drawn anew, by source, of all English texts."""
    docs = X.table(spark, d, "documents").where("lang = 'en' and text is not null")
    s = docs.select("source", "doc_id", F.posexplode(F.split("text", r"\.")).alias("i", "s")).where(F.trim("s") != "")
    rows = s.select("source", (F.col("doc_id") * 1000000 + F.col("i")).alias("date"), F.length(F.trim("s")).alias("len"), F.regexp_count(F.lower("s"), F.lit(r"\bthe\b")).alias("hits"))
    v = S.block_bootstrap(rows, ["source"], ["date"], 10, 1, wide=True).groupBy("source", "rep").agg((1000.0 * F.sum("hits") / F.sum("len")).alias("v"))
    return r(S.interval(v, ["source"], "v"), 5, "low", "mid", "high")


ASSOC = "ac AS (SELECT n_regionkey AS g, c_custkey AS pos, c_mktsegment = 'BUILDING' AS flag, (c_acctbal > 5000)::INT AS hit FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""WITH {ASSOC}, s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos) - 1 AS i FROM ac), h AS (SELECT g, rep, flag, row_number() OVER (PARTITION BY g, rep ORDER BY {draw_sql("g", "rep", "i")}, i) - 1 AS i FROM s, range(19) r(rep)),
v AS (SELECT s.g, rep, avg(hit) FILTER (WHERE h.flag) - avg(hit) FILTER (WHERE NOT h.flag) AS v FROM s JOIN h ON s.g = h.g AND s.i = h.i GROUP BY 1, 2), o AS (SELECT g, avg(hit) FILTER (WHERE flag) - avg(hit) FILTER (WHERE NOT flag) AS observed FROM ac GROUP BY 1)
SELECT g, round(observed, 6) + 0.0 AS observed, round((1 + count(*) FILTER (WHERE abs(v) >= abs(observed) - 1e-12)) / (1 + count(v)), 6) AS p FROM v JOIN o USING (g) GROUP BY g, observed""")
def association_permutation(spark, d):
    n = F.broadcast(X.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("g")))
    c = X.table(spark, d, "customer").join(n, "c_nationkey").select("g", "c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("flag"), (F.col("c_acctbal") > 5000).cast("int").alias("hit"))
    mean = lambda on: F.avg(F.when(F.col("flag") == on, F.col("hit")))
    stat = lambda df, *by: df.groupBy("g", *by).agg((mean(True) - mean(False)).alias("v"))
    return r(S.permutation_p(stat(c), stat(S.shuffled(c, ["g"], "flag", ["c_custkey"], 19), "rep"), ["g"], "v"), 6, "observed", "p")


@query(f"""WITH {FX}, {FC}, {boot_sql('fx', 'series_id', 'value', 20, 6)}, m AS (SELECT topic, series_id, avg(value) AS v FROM fx JOIN fc USING (series_id) GROUP BY 1, 2), b AS (SELECT series_id, rep, avg(value) AS v FROM d GROUP BY 1, 2), x AS (SELECT topic, a.series_id AS a, c.series_id AS b, a.v - c.v AS diff FROM m a JOIN m c USING (topic) WHERE a.series_id < c.series_id)
SELECT topic, x.a, x.b, round(diff, 3) AS diff, round(quantile_cont(p.v - q.v, 0.05), 3) AS low, round(quantile_cont(p.v - q.v, 0.95), 3) AS high FROM x JOIN b p ON p.series_id = x.a JOIN b q ON q.series_id = x.b AND p.rep = q.rep GROUP BY topic, x.a, x.b, diff""")
def pairwise_contrast(spark, d):
    """Differences of the means of a topic's series, with bootstrap intervals; topics hold few series."""
    fx = _topics(spark, d)
    m = fx.groupBy("topic", "series_id").agg(F.avg("value").alias("v"))
    reps = S.block_bootstrap(X.nation_series(spark, d), ["series_id"], ["date"], 20, 6).groupBy("series_id", "rep").agg(F.avg("value").alias("w"))
    side = lambda x: m.join(reps, "series_id").select("topic", "rep", F.col("series_id").alias(x), F.col("v").alias(f"v{x}"), F.col("w").alias(f"w{x}"))
    both = side("a").join(side("b"), ["topic", "rep"]).where("a < b")
    w = F.col("wa") - F.col("wb")
    g = both.groupBy("topic", "a", "b").agg(F.first(F.col("va") - F.col("vb")).alias("diff"), F.percentile(w, F.lit(0.05)).alias("low"), F.percentile(w, F.lit(0.95)).alias("high"))
    return r(g, 3, "diff", "low", "high")


@query(f"WITH {FX}, s AS (SELECT series_id, sum(value) AS v, count(*) AS n FROM fx GROUP BY 1), e AS (SELECT n_name AS series_id, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT series_id, round(s.v, 1) AS computed, round(e.v, 1) AS expected, abs(s.v - e.v) <= 0.01 * abs(e.v) AS ok FROM s JOIN e USING (series_id)")
def anchor_check(spark, d):
    s = X.nation_series(spark, d).groupBy("series_id").agg(F.sum("value").alias("computed"))
    o = X.table(spark, d, "orders").join(X.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("expected"))
    e = o.join(F.broadcast(X.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("series_id"), "expected")
    both = s.join(e, "series_id").withColumn("ok", F.abs(F.col("computed") - F.col("expected")) <= 0.01 * F.abs("expected"))
    return r(both, 1, "computed", "expected")
