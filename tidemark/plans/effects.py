"""Registered queries of panels, projections and event groups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import projections as J
from tidemark.operators import sampling as S
from tidemark.operators import twoway as W
from tidemark.sources import tables as X

from .sampled import FACTORS, _factors, boot_sql, draw_sql, ols2_sql
from .warehouse import EVENTS_DIM, FC, FX, query

SWEEPS = 60
CUSTOMER_QUARTERS = """cq AS (SELECT o_custkey AS unit, date_trunc('quarter', o_orderdate)::DATE AS time, ln(round(sum(o_totalprice), 2)) AS y FROM orders GROUP BY 1, 2),
cw AS (SELECT o_custkey AS unit, count(*)::DOUBLE AS w, c_mktsegment AS seg FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 3),
cp AS (SELECT unit, time, w, y, (seg = 'BUILDING' AND year(time) BETWEEN 1997 AND 1998)::INT::DOUBLE AS a, (seg = 'BUILDING' AND year(time) >= 1999)::INT::DOUBLE AS b FROM cq JOIN cw USING (unit))"""


@query(f"""WITH RECURSIVE {CUSTOMER_QUARTERS}, it AS (SELECT 0 AS step, * FROM cp UNION ALL SELECT step + 1, unit, time, w, y - sum(w * y) OVER u / sum(w) OVER u, a - sum(w * a) OVER u / sum(w) OVER u, b - sum(w * b) OVER u / sum(w) OVER u
FROM (SELECT step, unit, time, w, y - sum(w * y) OVER t / sum(w) OVER t AS y, a - sum(w * a) OVER t / sum(w) OVER t AS a, b - sum(w * b) OVER t / sum(w) OVER t AS b FROM it WHERE step < {SWEEPS} WINDOW t AS (PARTITION BY time)) WINDOW u AS (PARTITION BY unit)),
c AS (SELECT count(*) AS n, sum(w * a * a) AS aa, sum(w * a * b) AS ab, sum(w * b * b) AS bb, sum(w * a * y) AS ay, sum(w * b * y) AS b_y FROM it WHERE step = {SWEEPS})
SELECT 'BUILDING:mid' AS term, n, round((ay * bb - b_y * ab) / (aa * bb - ab * ab), 6) AS beta FROM c UNION ALL SELECT 'BUILDING:late', n, round((b_y * aa - ay * ab) / (aa * bb - ab * ab), 6) FROM c""")
def twfe_unbalanced(spark, d):
    """Customers by quarter, of which most lack quarters; customers weigh by their orders; a segment's shift in two regimes."""
    o = X.table(spark, d, "orders")
    rows = o.groupBy(F.col("o_custkey").alias("unit"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("time")).agg(F.log(F.round(F.sum("o_totalprice"), 2)).alias("y"))
    weights = o.groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").alias("w"))
    customers = X.table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("segment"))
    year = F.year("time")
    regime = F.when(year.between(1997, 1998), "mid").when(year >= 1999, "late")
    panel = rows.join(weights, "unit").join(customers, "unit").withColumn("regime", regime)
    panel, names = W.dummies(panel, "segment", "regime", ["BUILDING"], ["mid", "late"])
    return W.two_way(panel, "unit", "time", "y", names, "w").withColumn("beta", F.round("beta", 6))


LP_ROWS = """lp AS (SELECT series_id, date, value / 1000000 AS v, value / 1000000 - lag(value / 1000000) OVER s AS a, lag(value / 1000000) OVER s AS b FROM fx WINDOW s AS (PARTITION BY series_id ORDER BY date)),
lh AS (SELECT series_id, date, h.h, lead(v, h.h::INTEGER) OVER k - lag(v) OVER k AS y, a, b FROM lp, (SELECT unnest(range(0, 13)) AS h) h WINDOW k AS (PARTITION BY series_id, h.h ORDER BY date)),
lk AS (SELECT *, series_id || '|' || h AS kh FROM lh WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)"""
REPS = 25


@query(f"""WITH {FX}, {LP_ROWS}, lf AS (SELECT series_id, h, n, b1 FROM (WITH {ols2_sql('lk', 'series_id, h')} SELECT * FROM o2)), {boot_sql('lk', 'kh', 'm.y, m.a, m.b', REPS, 12)},
lb AS (SELECT kh, rep, b1 FROM (WITH {ols2_sql('d', 'kh, rep')} SELECT * FROM o2)), lq AS (SELECT kh, quantile_cont(b1, 0.05) AS low, quantile_cont(b1, 0.95) AS high, least(1.0, 2 * least(avg((b1 <= 0)::INT), avg((b1 >= 0)::INT))) AS p FROM lb GROUP BY 1)
SELECT series_id, h::INTEGER AS h, n, CASE WHEN n >= 30 THEN round(b1, 5) + 0.0 END AS beta, CASE WHEN n >= 30 THEN round(low, 5) + 0.0 END AS low, CASE WHEN n >= 30 THEN round(high, 5) + 0.0 END AS high, CASE WHEN n >= 30 THEN round(p, 6) END AS p FROM lf JOIN lq ON kh = series_id || '|' || h""")
def local_projection_intervals(spark, d):
    """Response of a nation's sales to their own change after 0 to 12 months, given the level before, with 90 % intervals."""
    w = Window.partitionBy("series_id").orderBy("date")
    v = X.nation_series(spark, d).select("series_id", "date", (F.col("value") / 1000000).alias("v")).withColumn("b", F.lag("v").over(w)).withColumn("a", F.col("v") - F.col("b"))
    out = J.local_projections(v, "series_id", "date", "v", "a", ["b"], 12, REPS, 12)
    return out.withColumns({**{c: F.round(c, 5) + F.lit(0.0) for c in ("beta", "low", "high")}, "p": F.round("p", 6)})


WINDOWS = """wf AS (SELECT rf.series_id, rf.topic, pos, ep, sum(y) OVER w3 AS eff, count(*) OVER w3 AS c FROM rf JOIN e0 USING (series_id) WINDOW w3 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
ev2 AS (SELECT series_id, topic, eff FROM wf WHERE pos = ep AND c = 3), fr AS (SELECT wf.series_id, eff, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM wf WHERE abs(pos - ep) > 3 AND c = 3)"""


@query(f"""WITH {FX}, {FC}, {EVENTS_DIM}, {FACTORS}, {WINDOWS}, pp AS (SELECT topic, ev2.series_id, ev2.eff, avg((abs(fr.eff) >= abs(ev2.eff))::INT) AS p FROM ev2 JOIN fr USING (series_id) GROUP BY 1, 2, 3),
dr AS (SELECT topic, rep, avg(f.eff) AS m FROM (SELECT ev2.topic, ev2.series_id, rep, {draw_sql("ev2.topic", "ev2.series_id", "rep")} % n AS i FROM ev2 JOIN (SELECT DISTINCT series_id, n FROM fr) USING (series_id), range(60) r(rep)) x JOIN fr f USING (series_id, i) GROUP BY 1, 2),
g AS (SELECT topic, count(*) AS events, avg(eff) AS effect, median(p) AS median_p FROM pp GROUP BY 1), bd AS (SELECT topic, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high, avg((abs(m) >= abs(effect))::INT) AS mean_p FROM dr JOIN g USING (topic) GROUP BY 1),
u AS (SELECT ev2.topic, eff, agg = 'sum' AS flag, row_number() OVER (PARTITION BY ev2.topic ORDER BY series_id) - 1 AS i FROM ev2 JOIN fc USING (series_id)), z AS (SELECT topic, count(*) AS n, count(*) FILTER (WHERE flag) AS k, avg(eff) FILTER (WHERE flag) - avg(eff) FILTER (WHERE NOT flag) AS diff, max(abs(eff)) AS top FROM u GROUP BY 1 HAVING k > 0 AND k < n),
mm AS (SELECT *, unnest(range(0, (1::BIGINT << n))) AS mask FROM z), e AS (SELECT mm.topic, diff, top, mask, avg(eff) FILTER (WHERE (mask >> i) & 1 = 1) - avg(eff) FILTER (WHERE (mask >> i) & 1 = 0) AS x FROM mm JOIN u USING (topic) WHERE bit_count(mask) = k GROUP BY ALL), pe AS (SELECT topic, any_value(diff) AS diff, count(*) AS relabellings, avg((abs(x) >= abs(diff) - 1e-9 * top)::INT) AS perm_p FROM e GROUP BY 1)
SELECT topic, events, round(effect, 5) + 0.0 AS effect, round(median_p, 6) AS median_p, round(low, 5) + 0.0 AS low, round(high, 5) + 0.0 AS high, round(mean_p, 6) AS mean_p, round(diff, 5) + 0.0 AS diff, relabellings, round(perm_p, 6) AS perm_p FROM g JOIN bd USING (topic) LEFT JOIN pe USING (topic)""")
def event_group_summary(spark, d):
    """Events by group: mean effect over three months, median placebo p of single events, band and p of means of as many placebo
    windows as the group has events, and the exact test of all relabellings between two kinds of series within the group."""
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(0, 2)
    rows = _factors(spark, d).withColumns({"effect": F.sum("y").over(w), "_c": F.count("y").over(w)}).where("_c = 3").select("series_id", "topic", "pos", "at", "effect")
    events, free = rows.where("pos = at").select("series_id", "topic", "effect"), rows.where(F.abs(F.col("pos") - F.col("at")) > 3).select("series_id", "pos", "effect")
    own = events.join(free.select("series_id", F.col("effect").alias("x")), "series_id")
    single = own.groupBy("topic", "series_id", "effect").agg(F.avg((F.abs("x") >= F.abs("effect")).cast("double")).alias("p"))
    groups = single.groupBy("topic").agg(F.count("*").alias("events"), F.avg("effect").alias("effect"), F.median("p").alias("median_p"))
    means = S.placebo_means(free, events, "series_id", "topic", 60).join(groups.select("topic", "effect"), "topic")
    band = means.groupBy("topic").agg(F.percentile("mean", F.lit(0.05)).alias("low"), F.percentile("mean", F.lit(0.95)).alias("high"), F.avg((F.abs("mean") >= F.abs("effect")).cast("double")).alias("mean_p"))
    kinds = events.join(X.catalogue(spark, d).select("series_id", (F.col("agg") == "sum").alias("flag")), "series_id")
    exact = S.permutation_exact(kinds, ["topic"], "series_id", "flag", "effect").select("topic", "diff", "relabellings", F.col("p").alias("perm_p"))
    out = groups.join(band, "topic").join(exact, "topic", "left")
    return out.withColumns({**{c: F.round(c, 5) + F.lit(0.0) for c in ("effect", "low", "high", "diff")}, **{c: F.round(c, 6) for c in ("median_p", "mean_p", "perm_p")}})
