"""Registered queries of panel statistics and further series windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import panel as P
from tidemark.operators import resampling as S
from tidemark.operators import timeseries as T
from tidemark.sources import tables as X

from .warehouse import BASKET, FC, FD, FX, W12, _basket, _event_dates, query
from .warehouse import EVENTS_DIM as FE


def r(df, places, *columns):
    """Rounded, with minus zero as zero."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


@query(f"""WITH {FX} SELECT series_id, count(*) AS n, round(100 * (exp(regr_slope(ln(value), year(date) + (dayofyear(date) - 1) / 365.25)) - 1), 5) + 0.0 AS growth FROM fx WHERE value > 0 GROUP BY 1 HAVING count(*) >= 8""")
def log_linear_trend(spark, d):
    return r(P.log_trend(X.nation_series(spark, d)), 5, "growth")


@query(f"""WITH {FD}, l AS (SELECT series_id, regr_slope(value, y) AS s, avg(y) AS m FROM fd WHERE year(date) < 1999 GROUP BY 1)
SELECT series_id, date, round(value - s * (y - m), 2) + 0.0 AS residual FROM fd JOIN l USING (series_id)""")
def residualize(spark, d):
    return r(P.residualize(X.daily_prices(spark, d), "value", "y", F.year("date") < 1999).select("series_id", "date", "residual"), 2, "residual")


@query(f"""WITH {FD}, c AS (SELECT series_id, count(*) AS n, corr(value, y) AS a, corr(value, month(date)) AS b, corr(y, month(date)) AS c FROM fd GROUP BY 1), q AS (SELECT *, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS t FROM c)
SELECT series_id, n, round(a * a, 8) AS r2_1, round(b * b, 8) AS r2_2, round(t, 8) AS r2_both, round((t - b * b + a * a) / 2, 8) + 0.0 AS shapley_1, round((t - a * a + b * b) / 2, 8) + 0.0 AS shapley_2 FROM q""")
def shapley_r2(spark, d):
    df = X.daily_prices(spark, d).select("series_id", F.col("value").alias("y"), F.col("y").alias("x1"), F.month("date").cast("double").alias("x2"))
    return r(P.two_factor_r2(df), 8, "r2_1", "r2_2", "r2_both", "shapley_1", "shapley_2")


PANEL = """p AS (SELECT n.n_nationkey AS unit, m.m AS time, coalesce(v.value, 0) AS y, (n.n_nationkey % 2 = 0 AND m.m >= DATE '1999-01-01')::INT AS x FROM nation n, (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders) m
LEFT JOIN (SELECT c_nationkey, date_trunc('month', o_orderdate)::DATE AS date, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) v ON v.c_nationkey = n.n_nationkey AND v.date = m.m)"""


def _panel(spark, d):
    """Nation by month, zero-filled: as many rows as nations times months, whatever the number of orders."""
    fx = X.nation_series(spark, d)
    nation = F.broadcast(X.table(spark, d, "nation").select(F.col("n_name").alias("series_id"), F.col("n_nationkey").alias("unit")))
    grid = fx.select("date").distinct().join(nation, F.lit(True)).join(fx, ["series_id", "date"], "left")
    x = ((F.col("unit") % 2 == 0) & (F.col("date") >= F.lit("1999-01-01").cast("date"))).cast("int")
    return grid.select("unit", F.col("date").alias("time"), F.coalesce("value", F.lit(0.0)).alias("y"), x.alias("x"))


@query(f"""WITH {PANEL}, a AS (SELECT y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY time) + avg(y) OVER () AS dy, x - avg(x) OVER (PARTITION BY unit) - avg(x) OVER (PARTITION BY time) + avg(x) OVER () AS dx FROM p)
SELECT count(*) AS n, round(sum(dx * dy) / sum(dx * dx), 3) AS beta FROM a""")
def twfe(spark, d):
    return r(P.twfe(_panel(spark, d), "unit", "time", "y", "x"), 3, "beta")


@query(f"WITH {FX}, b AS (SELECT series_id, avg(value) AS m, stddev_samp(value) AS s FROM fx WHERE year(date) < 1998 GROUP BY 1) SELECT series_id, date, round((value - m) / s, 6) + 0.0 AS z FROM fx JOIN b USING (series_id) WHERE s > 0")
def zscore_composite(spark, d):
    return r(P.zscores(X.nation_series(spark, d), F.year("date") < 1998).where("z is not null").select("series_id", "date", "z"), 6, "z")


@query(f"""WITH {FX}, {FC}, u AS (SELECT month(date)::INTEGER AS month, topic, series_id, avg(value) AS m FROM fx JOIN fc USING (series_id) GROUP BY ALL)
SELECT month, round(avg(m) FILTER (WHERE topic = 'ASIA') - avg(m) FILTER (WHERE topic = 'EUROPE'), 3) AS delta, count(*) FILTER (WHERE topic = 'ASIA') AS n_left, count(*) FILTER (WHERE topic = 'EUROPE') AS n_right FROM u GROUP BY 1 HAVING n_left >= 2 AND n_right >= 2""")
def group_delta(spark, d):
    fx = X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d)), "series_id").withColumn("month", F.month("date"))
    return r(P.group_delta(fx, "month", "series_id", "topic", "ASIA", "EUROPE"), 3, "delta")


@query(f"""WITH {FX}, {FC}, u AS (SELECT topic, series_id, avg(value) AS m FROM fx JOIN fc USING (series_id) GROUP BY ALL), x AS (SELECT topic, series_id, (sum(m) OVER (PARTITION BY topic) - m) / (count(*) OVER (PARTITION BY topic) - 1) AS x FROM u)
SELECT topic, round(min(x), 3) AS lowest, round(max(x), 3) AS highest, arg_min(series_id, x) AS lowest_without FROM x GROUP BY 1""")
def leave_one_out(spark, d):
    fx = X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d)), "series_id")
    return r(P.leave_one_out(fx, "topic", "series_id"), 3, "lowest", "highest")


@query(f"""WITH {FX} SELECT series_id, count(*) FILTER (WHERE month(date) <= 3) AS n_in, count(*) FILTER (WHERE month(date) > 3) AS n_out, round(avg(value) FILTER (WHERE month(date) <= 3) / avg(value) FILTER (WHERE month(date) > 3), 6) AS ratio FROM fx GROUP BY 1 HAVING n_in >= 3 AND n_out >= 3""")
def conditional_ratio(spark, d):
    return r(P.conditional_ratio(X.nation_series(spark, d), F.month("date") <= 3), 6, "ratio")


@query(f"""WITH {FD}, c AS (SELECT series_id, value - lag(value) {W12} AS dy, y - lag(y) {W12} AS dx FROM fd), a AS (SELECT series_id, avg(dy) FILTER (WHERE dx > 0) / avg(dx) FILTER (WHERE dx > 0) AS u, avg(dy) FILTER (WHERE dx < 0) / avg(dx) FILTER (WHERE dx < 0) AS d FROM c GROUP BY 1)
SELECT series_id, round(u, 4) + 0.0 AS up, round(d, 4) + 0.0 AS down, round(u - d, 4) + 0.0 AS asymmetry FROM a""")
def up_down_capture(spark, d):
    step = lambda c: F.col(c) - F.lag(c).over(T.by())
    df = X.daily_prices(spark, d).withColumns({"dy": step("value"), "dx": step("y")})
    return r(P.capture(df, "dy", "dx"), 4, "up", "down", "asymmetry")


@query(f"""WITH {FX}, {FE}, c AS (SELECT *, value - lag(value) {W12} AS c, lag(date) {W12} AS prev FROM fx), w AS (SELECT *, avg(c) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS u, count(c) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS nu,
sum(c) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS t, count(c) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS nt FROM c)
SELECT w.series_id, fe.date AS event_date, w.date, round(t - 6 * u, 2) + 0.0 AS car FROM w JOIN fe ON w.series_id = fe.series_id AND w.date >= fe.date AND w.prev < fe.date WHERE nu = 6 AND nt = 6""")
def event_study_car(spark, d):
    return r(P.event_windows(X.nation_series(spark, d), _event_dates(spark, d), 2, 3, 6), 2, "car")


@query(f"""WITH {BASKET}, l AS (SELECT *, lag(value) OVER (PARTITION BY part ORDER BY year) AS v, lag(year) OVER (PARTITION BY part ORDER BY year) AS y FROM b), t AS (SELECT *, sum(value) OVER (PARTITION BY year) - sum(v) OVER (PARTITION BY year) AS dt FROM l)
SELECT year, part, round((value - v) / dt, 5) + 0.0 AS contribution FROM t WHERE y = year - 1""")
def growth_contribution(spark, d):
    return r(P.growth_contribution(_basket(spark, d), "year", "part").select("year", "part", "contribution"), 5, "contribution")


@query("""WITH v AS (SELECT l_returnflag AS flag, year(l_shipdate)::INTEGER AS year, sum(l_extendedprice) AS v, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
x AS (SELECT flag, year, ln(v / lag(v) OVER w) AS a, ln(q / lag(q) OVER w) AS b, ln((v / q) / lag(v / q) OVER w) AS c FROM v WINDOW w AS (PARTITION BY flag ORDER BY year))
SELECT flag, year, round(a, 8) + 0.0 AS d_value, round(b, 8) + 0.0 AS d_quantity, round(c, 8) + 0.0 AS d_price FROM x WHERE a IS NOT NULL""")
def price_volume_split(spark, d):
    li = X.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("quantity"))
    return r(P.price_volume(li, "flag", "year"), 8, "d_value", "d_quantity", "d_price")


SPLITS = [("A", "1997-03-01", 2.0), ("A", "1999-06-15", 3.0), ("N", "1998-01-10", 0.5)]
SPLITS_SQL = "sp AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', DATE '{b}', {c})" for a, b, c in SPLITS) + ") t(series_id, date, ratio))"


@query(f"""WITH {FD}, {SPLITS_SQL} SELECT series_id, date, round(value / coalesce((SELECT product(ratio) FROM sp WHERE sp.series_id = fd.series_id AND sp.date > fd.date), 1), 3) AS adjusted FROM fd""")
def split_adjust(spark, d):
    splits = spark.createDataFrame(SPLITS, "series_id string, d string, ratio double").select("series_id", F.col("d").cast("date").alias("date"), "ratio")
    return r(S.split_adjust(X.daily_prices(spark, d).drop("y"), splits).select("series_id", "date", "adjusted"), 3, "adjusted")


@query(f"""WITH {FX}, l AS (SELECT *, coalesce(ln((value + 1000) / lag(value) {W12}), 0) AS s FROM fx) SELECT series_id, date, round(100 * exp(sum(s) {W12}), 5) AS "index" FROM l""")
def total_return_index(spark, d):
    return r(S.total_return(X.nation_series(spark, d).withColumn("paid", F.lit(1000.0))).select("series_id", "date", "index"), 5, "index")


@query(f"WITH {FX} SELECT series_id, date, round(sum(value) OVER (PARTITION BY series_id ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW), 1) AS ttm FROM fx")
def ttm_sum(spark, d):
    return r(S.trailing_year(X.nation_series(spark, d)).select("series_id", "date", "ttm"), 1, "ttm")


@query(f"""WITH {FX}, a AS (SELECT * FROM fx WHERE date < DATE '2000-01-01'), l AS (SELECT series_id, max(date) AS d, arg_max(value, date) AS v FROM a GROUP BY 1), o AS (SELECT series_id, date, value * 2 + 7 AS value FROM fx)
SELECT * FROM a UNION ALL SELECT o.series_id, o.date, round(v * o.value / k.value, 3) FROM o JOIN l ON o.series_id = l.series_id AND o.date > l.d JOIN o k ON k.series_id = l.series_id AND k.date = l.d""")
def level_match_extend(spark, d):
    fx = X.nation_series(spark, d)
    other = fx.withColumn("value", F.col("value") * 2 + 7)
    return r(S.extend_by_growth(fx.where(F.col("date") < F.lit("2000-01-01").cast("date")), other), 3, "value")


@query(f"""WITH {FX}, b AS (SELECT series_id, month(date) AS m, value AS b FROM fx WHERE year(date) = 1997) SELECT series_id, round(sum(value), 1) AS total, round(sum(b), 1) AS base_total, count(*) AS months FROM (SELECT *, month(date) AS m FROM fx WHERE date >= DATE '1999-04-01' AND date < DATE '2000-10-01') LEFT JOIN b USING (series_id, m) GROUP BY 1""")
def same_months_window_sum(spark, d):
    return r(S.same_months_before(X.nation_series(spark, d), "1999-04-01", "2000-10-01", 1997), 1, "total", "base_total")


@query("""SELECT l_returnflag AS flag, year(l_shipdate)::INTEGER AS year, round(sum(l_extendedprice), 1) AS total FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT quarter(l_shipdate)) = 4""")
def having_complete(spark, d):
    li = X.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("year"))
    return r(li.agg(F.sum("l_extendedprice").alias("total"), F.count_distinct(F.quarter("l_shipdate")).alias("q")).where("q = 4").drop("q"), 1, "total")


@query(f"WITH {BASKET} SELECT year, part, value, max(value) OVER (PARTITION BY year) AS highest, round(value / sum(value) OVER (PARTITION BY year), 8) AS share FROM b")
def group_transform(spark, d):
    w = T.Window.partitionBy("year")
    return r(_basket(spark, d).withColumns({"highest": F.max("value").over(w), "share": F.col("value") / F.sum("value").over(w)}), 8, "share")


@query(f"""WITH {FX} SELECT series_id, make_date(year(date), quarter(date) * 3 - 2, 1) AS bucket, round(avg(value), 3) AS mean, round(sum(value), 1) AS total FROM fx GROUP BY 1, 2""")
def bucket_matrix(spark, d):
    return r(X.nation_series(spark, d).groupBy("series_id", F.to_date(F.date_trunc("quarter", "date")).alias("bucket")).agg(F.round(F.avg("value"), 3).alias("mean"), F.sum("value").alias("total")), 1, "total")


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_shipdate::DATE AS day FROM lineitem), g AS (SELECT l_suppkey, date_trunc('month', day)::DATE AS month, median(gap)::DOUBLE AS step FROM (SELECT *, day - lag(day) OVER (PARTITION BY l_suppkey, date_trunc('month', day) ORDER BY day) AS gap FROM d) GROUP BY 1, 2)
SELECT g.l_suppkey, g.month, count(*) AS n, round(sum(l_quantity), 2) AS total, step, round(sum(l_quantity) * step, 2) AS volume, max(l_shipdate)::DATE AS last FROM lineitem l JOIN g ON g.l_suppkey = l.l_suppkey AND g.month = date_trunc('month', l_shipdate)::DATE GROUP BY g.l_suppkey, g.month, step""")
def plant_month_agg(spark, d):
    """By plant and month: rows, their total, the step between readings as the median gap of their days, total times step, the last reading."""
    li = X.table(spark, d, "lineitem").select("l_suppkey", F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"), F.to_date("l_shipdate").alias("day"), "l_quantity")
    days = li.groupBy("l_suppkey", "month", "day").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    gap = F.datediff("day", F.lag("day").over(S.Window.partitionBy("l_suppkey", "month").orderBy("day")))
    out = days.withColumn("gap", gap).groupBy("l_suppkey", "month").agg(F.sum("n").alias("n"), F.sum("q").alias("total"), F.median("gap").alias("step"), F.max("day").alias("last"))
    return r(out.withColumn("volume", F.col("total") * F.col("step")), 2, "total", "volume")


EVENT_WINDOWS, ESTIMATION = {"short": (0, 2), "long": (-5, 10)}, (-120, -21)
ROWS = lambda a, b: f"ROWS BETWEEN {abs(a)} {'PRECEDING' if a < 0 else 'FOLLOWING'} AND {abs(b)} {'PRECEDING' if b < 0 else 'FOLLOWING'}"
DAILY_CHANGES = """dc AS (SELECT series_id, date, 100 * ln(value / lag(value) OVER (PARTITION BY series_id ORDER BY date)) AS change FROM fd), dk AS (SELECT * FROM dc WHERE change IS NOT NULL),
dm AS (SELECT date, sum(change) AS s, count(*) AS n FROM dk GROUP BY 1), df AS (SELECT dk.*, CASE WHEN n > 1 THEN (s - change) / (n - 1) END AS factor FROM dk JOIN dm USING (date)), de AS (SELECT DISTINCT series_id, make_date(year(date), 6, 15) AS event_date FROM fd)"""


@query(f"""WITH {FD}, {DAILY_CHANGES}, w AS (SELECT *, lag(date) OVER k AS prev, count(change) OVER e AS n, avg(change) OVER e AS mean, count(factor) OVER e AS nb, regr_slope(change, factor) OVER e AS slope, avg(CASE WHEN factor IS NOT NULL THEN change END) OVER e AS my, avg(factor) OVER e AS mx,
{', '.join(f"count(change) OVER w{n} AS n_{n}, sum(change) OVER w{n} AS raw_{n}, sum(coalesce(factor, 0)) OVER w{n} AS f_{n}, max(date) OVER w{n} - min(date) OVER w{n} AS days_{n}" for n in EVENT_WINDOWS)}
FROM df WINDOW k AS (PARTITION BY series_id ORDER BY date), e AS (PARTITION BY series_id ORDER BY date {ROWS(*ESTIMATION)}), {', '.join(f"w{n} AS (PARTITION BY series_id ORDER BY date {ROWS(a, b)})" for n, (a, b) in EVENT_WINDOWS.items())}),
h AS (SELECT * FROM w JOIN de USING (series_id) WHERE date >= event_date AND (prev IS NULL OR prev < event_date) AND n = {ESTIMATION[1] - ESTIMATION[0] + 1})
{' UNION ALL '.join(f"SELECT series_id, event_date, '{n}' AS window, round(raw_{n}, 5) + 0.0 AS raw, round(raw_{n} - {b - a + 1} * mean, 5) + 0.0 AS car, CASE WHEN nb >= 60 THEN round(raw_{n} - {b - a + 1} * (my - slope * mx) - slope * f_{n}, 5) + 0.0 END AS car_factor FROM h WHERE n_{n} = {b - a + 1} AND days_{n} <= 2.2 * {b - a + 1} + 15" for n, (a, b) in EVENT_WINDOWS.items())}""")
def event_study_factor(spark, d):
    """Each June's event: changes of two windows, raw, less the usual mean, and less the line on the other series' mean change."""
    c = X.daily_prices(spark, d).withColumn("change", 100 * F.log(F.col("value") / F.lag("value").over(T.by()))).where("change is not null").select("series_id", "date", "change")
    mean = c.groupBy("date").agg(F.sum("change").alias("s"), F.count("*").alias("n"))
    rows = c.join(mean, "date").withColumn("factor", F.when(F.col("n") > 1, (F.col("s") - F.col("change")) / (F.col("n") - 1))).select("series_id", "date", "change", "factor")
    events = X.daily_prices(spark, d).select("series_id", F.make_date(F.year("date"), F.lit(6), F.lit(15)).alias("date")).distinct()
    return r(P.event_cars(rows, events, EVENT_WINDOWS, ESTIMATION, 60), 5, "raw", "car", "car_factor")


@query(f"WITH {X.EDITIONS} SELECT series_id, topic, max(value) AS peak, arg_max(date, (value, -epoch(date))) AS at, round(max(value) / avg(value), 6) AS over_mean FROM ed GROUP BY 1, 2")
def extreme_with_date(spark, d):
    """The highest month of each series, the earliest of equal ones, and how far it is above the mean."""
    first = F.max_by("date", F.struct("value", (-F.unix_date("date")).alias("d")))
    return r(X.editions(spark, d).groupBy("series_id", "topic").agg(F.max("value").alias("peak"), first.alias("at"), (F.max("value") / F.avg("value")).alias("over_mean")), 6, "over_mean")


@query(f"WITH {X.EDITIONS}, m AS (SELECT topic, series_id, round(avg(value), 2) AS v FROM ed WHERE kind = 's' GROUP BY 1, 2) SELECT topic, series_id, v, rank() OVER (PARTITION BY topic ORDER BY v DESC)::INTEGER AS place, count(*) OVER (PARTITION BY topic) AS members, round(v - median(v) OVER (PARTITION BY topic), 2) + 0.0 AS gap FROM m")
def contrast_ranks(spark, d):
    """Each unit's rank within its group and its gap to the group's median."""
    m = X.editions(spark, d).where("kind = 's'").groupBy("topic", "series_id").agg(F.round(F.avg("value"), 2).alias("v"))
    middle = m.groupBy("topic").agg(F.median("v").alias("_m"), F.count("*").alias("members"))
    place = F.rank().over(S.Window.partitionBy("topic").orderBy(F.desc("v")))
    return r(m.withColumn("place", place).join(middle, "topic").withColumn("gap", F.col("v") - F.col("_m")).select("topic", "series_id", "v", "place", "members", "gap"), 2, "gap")


@query("""WITH c AS (SELECT l_suppkey AS k, count(*) AS n, min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1), a AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS head FROM part)
SELECT 'span' AS kind, 'years' AS name, min(year(first)) || '-' || least(max(year(last)), 2001) AS value, sum(n)::BIGINT AS n FROM c UNION ALL SELECT 'source', n_name, 's', count(*) FROM c JOIN supplier ON s_suppkey = k JOIN nation ON n_nationkey = s_nationkey GROUP BY 2
UNION ALL SELECT 'pending', s_name, 'no data since 2001-10', 1 FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM c WHERE last >= DATE '2001-10-25') UNION ALL SELECT 'alias', p_partkey::VARCHAR, head::VARCHAR, 1 FROM a WHERE head <> p_partkey""")
def build_facts_lists(spark, d):
    """Facts of a build as rows: the years covered up to a year, series by source, what is pending, and where merged ids went."""
    s = X.table(spark, d, "supplier").join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    c = X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last"))
    row = lambda df, kind, name, value, n: df.select(F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.cast("string").alias("value"), n.cast("long").alias("n"))
    span = c.agg(F.min(F.year("first")).alias("a"), F.least(F.max(F.year("last")), F.lit(2001)).alias("b"), F.sum("n").alias("n"))
    out = row(span, "span", F.lit("years"), F.concat_ws("-", "a", "b"), F.col("n"))
    out = out.unionByName(row(c.join(s, "s_suppkey").groupBy("n_name").agg(F.count("*").alias("n")), "source", F.col("n_name"), F.lit("s"), F.col("n")))
    pending = s.join(c.where("last >= date'2001-10-25'"), "s_suppkey", "left_anti")
    out = out.unionByName(row(pending, "pending", F.col("s_name"), F.lit("no data since 2001-10"), F.lit(1)))
    part = X.table(spark, d, "part")
    heads = part.groupBy("p_name", "p_brand", "p_type").agg(F.min("p_partkey").alias("head"))
    return out.unionByName(row(part.join(heads, ["p_name", "p_brand", "p_type"]).where("head <> p_partkey"), "alias", F.col("p_partkey"), F.col("head"), F.lit(1)))
