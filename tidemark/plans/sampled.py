"""Registered queries of regressions, bootstraps, permutations and placebos, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import regression as G
from tidemark.operators import rollups as R
from tidemark.operators import sampling as S
from tidemark.operators import timeseries as T
from tidemark.sources import tables as X

from .warehouse import EVENTS_DIM, FC, FD, FX, W12, _event_dates, query


def r(df, places, *columns):
    """Rounded, with minus zero as zero."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def boot_sql(src: str, key: str, columns: str, count: int, length: int, circular: bool = False, seed: str = "", tag: str = "d") -> str:
    """CTEs that end in {tag}: key, rep, at and columns of the drawn rows."""
    starts = "n" if circular else f"n - least({length}, n) + 1"
    return f"""{tag}n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date) - 1 AS pos FROM {src}), {tag}z AS (SELECT {key}, count(*) AS n FROM {src} GROUP BY 1),
{tag}b AS (SELECT z.*, r.rep, unnest(range(0, (n - 1) // least({length}, n) + 1)) AS b FROM {tag}z z, range({count}) r(rep)),
{tag}s AS (SELECT *, {draw_sql(f"'{seed}'", key, "rep", "b")} % ({starts}) AS start, unnest(range(0, least({length}, n))) AS k FROM {tag}b),
{tag} AS (SELECT e.{key}, e.rep, e.b * least({length}, e.n) + e.k AS place, {columns} FROM {tag}s e JOIN {tag}n m ON m.{key} = e.{key} AND m.pos = (e.start + e.k) % e.n WHERE e.b * least({length}, e.n) + e.k < e.n)"""


def quantile_sql(value: str, places: int) -> str:
    return ", ".join([f"count({value}) AS reps", *[f"round(quantile_cont({value}, {q}), {places}) + 0.0 AS {n}" for q, n in ((0.05, "low"), (0.5, "mid"), (0.95, "high"))]])


@query(f"WITH {FX}, {boot_sql('fx', 'series_id', 'value', 30, 6)}, v AS (SELECT series_id, rep, avg(value) AS v FROM d GROUP BY 1, 2) SELECT series_id, {quantile_sql('v', 3)} FROM v GROUP BY 1")
def moving_block_bootstrap(spark, d):
    drawn = S.block_bootstrap(X.nation_series(spark, d), ["series_id"], ["date"], 30, 6)
    return r(S.interval(drawn.groupBy("series_id", "rep").agg(F.avg("value").alias("v")), ["series_id"], "v"), 3, "low", "mid", "high")


@query(f"WITH {FD}, {boot_sql('fd', 'series_id', 'value, y', 20, 20, True)}, v AS (SELECT series_id, rep, corr(value, y) AS v FROM d GROUP BY 1, 2) SELECT series_id, {quantile_sql('v', 6)} FROM v GROUP BY 1")
def circular_block_bootstrap(spark, d):
    drawn = S.block_bootstrap(X.daily_prices(spark, d), ["series_id"], ["date"], 20, 20, circular=True)
    return r(S.interval(drawn.groupBy("series_id", "rep").agg(F.corr("value", "y").alias("v")), ["series_id"], "v"), 6, "low", "mid", "high")


@query(f"""WITH {FX}, fa AS (SELECT * FROM fx WHERE year(date) < 1998), fb AS (SELECT * FROM fx WHERE year(date) >= 1998), {boot_sql('fa', 'series_id', 'value', 25, 1, seed='a', tag='p')}, {boot_sql('fb', 'series_id', 'value', 25, 1, seed='b', tag='q')},
v AS (SELECT * FROM (SELECT series_id, rep, avg(value) AS a FROM p GROUP BY 1, 2) JOIN (SELECT series_id, rep, avg(value) AS b FROM q GROUP BY 1, 2) USING (series_id, rep)) SELECT series_id, {quantile_sql('b - a', 3)} FROM v GROUP BY 1""")
def mean_diff_bootstrap(spark, d):
    fx = X.nation_series(spark, d)
    side = lambda rows, seed: S.block_bootstrap(rows, ["series_id"], ["date"], 25, 1, seed=seed).groupBy("series_id", "rep").agg(F.avg("value").alias(seed))
    both = side(fx.where(F.year("date") < 1998), "a").join(side(fx.where(F.year("date") >= 1998), "b"), ["series_id", "rep"])
    return r(S.interval(both.withColumn("v", F.col("b") - F.col("a")), ["series_id"], "v"), 3, "low", "mid", "high")


AGE = "(year(date) * 12 + month(date))"


@query(f"""WITH {FX}, fa AS (SELECT *, {AGE} AS t FROM fx WHERE year(date) < 1998), fb AS (SELECT *, {AGE} AS t FROM fx WHERE year(date) >= 1998), {boot_sql('fa', 'series_id', 'value, t', 25, 6, seed='a', tag='p')}, {boot_sql('fb', 'series_id', 'value, t', 25, 6, seed='b', tag='q')},
v AS (SELECT * FROM (SELECT series_id, rep, regr_slope(value, t) AS a FROM p GROUP BY 1, 2) JOIN (SELECT series_id, rep, regr_slope(value, t) AS b FROM q GROUP BY 1, 2) USING (series_id, rep)) SELECT series_id, {quantile_sql('b - a', 2)} FROM v GROUP BY 1""")
def slope_difference_bootstrap(spark, d):
    fx = X.nation_series(spark, d).withColumn("t", F.year("date") * 12 + F.month("date"))
    side = lambda rows, seed: S.block_bootstrap(rows, ["series_id"], ["date"], 25, 6, seed=seed).groupBy("series_id", "rep").agg(F.regr_slope("value", "t").alias(seed))
    both = side(fx.where(F.year("date") < 1998), "a").join(side(fx.where(F.year("date") >= 1998), "b"), ["series_id", "rep"])
    return r(S.interval(both.withColumn("v", F.col("b") - F.col("a")), ["series_id"], "v"), 2, "low", "mid", "high")


@query(f"""WITH {FX}, {FC}, c AS (SELECT topic, series_id, date, value, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS m, dense_rank() OVER (PARTITION BY topic ORDER BY series_id) - 1 AS c FROM fx JOIN fc USING (series_id)),
t AS (SELECT topic, count(DISTINCT series_id) AS n FROM c GROUP BY 1), a AS (SELECT t.*, r.rep, unnest(range(0, n)) AS draw FROM t, range(15) r(rep)),
b AS (SELECT a.*, {draw_sql("'c'", "topic", "rep", "draw")} % n AS c FROM a), e AS (SELECT b.*, k.series_id, unnest(range(0, m)) AS k, m FROM b JOIN (SELECT DISTINCT topic, c, series_id, m FROM c) k USING (topic, c)),
v AS (SELECT e.topic, rep, avg(value) AS v FROM e JOIN c ON c.series_id = e.series_id AND c.pos = {draw_sql("'r'", "e.topic", "rep", "draw", "k")} % e.m GROUP BY 1, 2) SELECT topic, {quantile_sql('v', 3)} FROM v GROUP BY 1""")
def cluster_bootstrap(spark, d):
    fx = X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic")), "series_id")
    drawn = S.cluster_bootstrap(fx, ["topic"], "series_id", ["date"], 15)
    return r(S.interval(drawn.groupBy("topic", "rep").agg(F.avg("value").alias("v")), ["topic"], "v"), 3, "low", "mid", "high")


SHUFFLED = f"""s AS (SELECT *, year(date) AS x, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos FROM fx),
h AS (SELECT series_id, rep, x, row_number() OVER (PARTITION BY series_id, rep ORDER BY {draw_sql("series_id", "rep", "pos")}, pos) - 1 AS pos FROM s, range(19) r(rep)),
v AS (SELECT series_id, rep, corr(value, h.x) AS v FROM s JOIN h USING (series_id, pos) GROUP BY 1, 2), o AS (SELECT series_id, corr(value, x) AS observed FROM s GROUP BY 1),
mp AS (SELECT series_id, observed, (1 + count(*) FILTER (WHERE abs(v) >= abs(observed) - 1e-12)) / (1 + count(v)) AS p FROM v JOIN o USING (series_id) GROUP BY 1, 2)"""


def _permuted(spark, d):
    fx = X.nation_series(spark, d).withColumn("x", F.year("date"))
    stat = lambda df, *by: df.groupBy("series_id", *by).agg(F.corr("value", "x").alias("v"))
    return S.permutation_p(stat(fx), stat(S.shuffled(fx, ["series_id"], "x", ["date"], 19), "rep"), ["series_id"], "v")


@query(f"WITH {FX}, {SHUFFLED} SELECT series_id, round(observed, 6) AS observed, round(p, 6) AS p FROM mp")
def permutation_mc(spark, d):
    return r(_permuted(spark, d), 6, "observed", "p")


@query(f"""WITH {FX}, {FC}, {SHUFFLED}, q AS (SELECT series_id, topic, p, count(*) OVER (PARTITION BY topic) AS m, row_number() OVER (PARTITION BY topic ORDER BY p) AS i FROM mp JOIN fc USING (series_id))
SELECT series_id, topic, round(p, 6) AS p, round(least(1.0, (SELECT min(k.p * k.m / k.i) FROM q k WHERE k.topic = q.topic AND k.p >= q.p)), 6) AS p_adj, round(least(1.0, (SELECT max((k.m - k.i + 1) * k.p) FROM q k WHERE k.topic = q.topic AND k.p <= q.p)), 6) AS p_holm FROM q""")
def p_adjust(spark, d):
    p = _permuted(spark, d).join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic")), "series_id")
    both = S.holm(R.benjamini_hochberg(p, "p", ["topic"]), "p", ["topic"])
    return r(both, 6, "p", "p_adj", "p_holm").select("series_id", "topic", "p", "p_adj", "p_holm")


@query(f"""WITH {FX}, {FC}, w AS (SELECT topic, series_id, agg = 'sum' AS flag, avg(value) AS v FROM fx JOIN fc USING (series_id) GROUP BY ALL), u AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY series_id) - 1 AS i FROM w),
z AS (SELECT topic, count(*) AS n, count(*) FILTER (WHERE flag) AS k, avg(v) FILTER (WHERE flag) - avg(v) FILTER (WHERE NOT flag) AS diff, max(abs(v)) AS top FROM u GROUP BY 1 HAVING k > 0 AND k < n),
m AS (SELECT *, unnest(range(0, (1::BIGINT << n))) AS mask FROM z), e AS (SELECT m.topic, diff, top, mask, avg(v) FILTER (WHERE (mask >> i) & 1 = 1) - avg(v) FILTER (WHERE (mask >> i) & 1 = 0) AS x FROM m JOIN u USING (topic) WHERE bit_count(mask) = k GROUP BY ALL)
SELECT topic, round(diff, 3) AS diff, count(*) AS relabellings, round(count(*) FILTER (WHERE abs(x) >= abs(diff) - 1e-9 * top) / count(*), 6) AS p, round(1 / count(*), 6) AS least_p FROM e GROUP BY topic, diff""")
def permutation_exact(spark, d):
    fx = X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic", "agg")), "series_id")
    units = fx.groupBy("topic", "series_id", (F.col("agg") == "sum").alias("flag")).agg(F.avg("value").alias("v"))
    return r(r(S.permutation_exact(units, ["topic"], "series_id", "flag", "v"), 3, "diff"), 6, "p", "least_p")


EFFECTS = f"""l AS (SELECT series_id, date, 100 * ln(value / lag(value) {W12}) AS effect FROM fx), ev AS (SELECT fe.series_id, max(fx.date) AS date FROM fe JOIN fx ON fx.series_id = fe.series_id AND fx.date <= fe.date GROUP BY 1)"""


def _effects(spark, d):
    """Monthly log changes, and for each series the month of its event."""
    fx = X.nation_series(spark, d)
    change = fx.select("series_id", "date", (100 * F.log(F.col("value") / F.lag("value").over(T.by()))).alias("effect"))
    events = _event_dates(spark, d).withColumnRenamed("date", "_d").join(fx, "series_id").where("date <= _d").groupBy("series_id").agg(F.max("date").alias("date"))
    return change, events


@query(f"""WITH {FX}, {EVENTS_DIM}, {EFFECTS}, f AS (SELECT l.series_id, l.date, effect, row_number() OVER (PARTITION BY l.series_id ORDER BY {draw_sql("l.series_id", "l.date")}, l.date) AS k FROM l JOIN ev USING (series_id) WHERE abs(l.date - ev.date) > 90 AND effect IS NOT NULL),
o AS (SELECT ev.series_id, ev.date, l.effect FROM ev JOIN l USING (series_id, date) WHERE effect IS NOT NULL)
SELECT o.series_id, o.date, round(o.effect, 5) AS effect, count(*) AS n, round(avg((abs(f.effect) >= abs(o.effect))::INT), 6) AS p, round(avg((f.effect <= o.effect)::INT), 6) AS percentile, round((o.effect - avg(f.effect)) / stddev_samp(f.effect), 5) AS z
FROM o JOIN f ON f.series_id = o.series_id AND k <= 40 GROUP BY o.series_id, o.date, o.effect""")
def placebo_distribution(spark, d):
    change, events = _effects(spark, d)
    return r(r(S.placebo(change, events, "series_id", 90, 40), 6, "p", "percentile"), 5, "effect", "z")


@query(f"""WITH {FX}, {EVENTS_DIM}, {EFFECTS}, s AS (SELECT series_id, stddev_samp(effect) AS sd FROM l GROUP BY 1), w AS (SELECT ev.series_id, sum(effect) AS effect, count(effect) AS n FROM ev JOIN l ON l.series_id = ev.series_id AND l.date >= ev.date AND l.date < (ev.date + INTERVAL 3 MONTH)::DATE GROUP BY 1)
SELECT series_id, n, round(effect, 5) AS effect, round(effect / (sd * sqrt(n)), 5) AS z, rank() OVER (ORDER BY round(abs(effect / (sd * sqrt(n))), 9) DESC)::INTEGER AS place FROM w JOIN s USING (series_id)""")
def event_z_score(spark, d):
    change, events = _effects(spark, d)
    sd = change.groupBy("series_id").agg(F.stddev_samp("effect").alias("_sd"))
    window = events.select("series_id", F.col("date").alias("_e")).join(change, "series_id").where((F.col("date") >= F.col("_e")) & (F.col("date") < F.add_months("_e", 3)))
    out = window.groupBy("series_id").agg(F.sum("effect").alias("effect"), F.count("effect").alias("n")).join(sd, "series_id").withColumn("z", F.col("effect") / (F.col("_sd") * F.sqrt("n")))
    # one row a series
    return r(out.withColumn("place", F.rank().over(T.Window.orderBy(F.desc(F.round(F.abs("z"), 9))))), 5, "effect", "z").select("series_id", "n", "effect", "z", "place")


@query(f"""WITH {FX}, l AS (SELECT series_id, value - lag(value) {W12} AS c FROM fx), a AS (SELECT series_id, count(*) FILTER (WHERE c > 0) AS k, count(*) FILTER (WHERE c <> 0) AS n FROM l GROUP BY 1)
SELECT series_id, k, n, round((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(k, n + 1) t(i)), 6) AS p FROM a""")
def sign_test(spark, d):
    c = F.col("value") - F.lag("value").over(T.by())
    out = X.nation_series(spark, d).withColumn("c", c).groupBy("series_id").agg(F.count_if(F.col("c") > 0).alias("k"), F.count_if(F.col("c") != 0).alias("n"))
    return out.withColumn("p", F.round(S.binomial_tail(F.col("k"), F.col("n")), 6))


def ols2_sql(src: str, keys: str) -> str:
    """CTEs m2 (moments) and o2: keys, n, b1, b2, r2, intercept of y on a and b."""
    return f"""m2 AS (SELECT {keys}, count(*) AS n, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(y, a) AS sya, covar_pop(y, b) AS syb, var_pop(y) AS syy, avg(y) AS my, avg(a) AS ma, avg(b) AS mb
FROM {src} WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), o1 AS (SELECT *, (sya * sbb - syb * sab) / (saa * sbb - sab * sab) AS b1, (syb * saa - sya * sab) / (saa * sbb - sab * sab) AS b2 FROM m2),
o2 AS (SELECT *, (b1 * sya + b2 * syb) / syy AS r2, my - b1 * ma - b2 * mb AS intercept FROM o1), ot AS (SELECT *, b1 / sqrt((1 - r2) * syy / (n - 3) * sbb / (saa * sbb - sab * sab)) AS t1, b2 / sqrt((1 - r2) * syy / (n - 3) * saa / (saa * sbb - sab * sab)) AS t2 FROM o2)"""


PRICES = "xy AS (SELECT series_id, date, value AS y, y AS a, month(date)::DOUBLE AS b FROM fd)"


def _prices(spark, d):
    return X.daily_prices(spark, d).select("series_id", "date", F.col("value").alias("y"), F.col("y").alias("a"), F.month("date").cast("double").alias("b"))


@query(f"WITH {FD}, {PRICES}, {ols2_sql('xy', 'series_id')} SELECT series_id, n, round(intercept, 2) AS intercept, round(b1, 5) AS beta_1, round(b2, 4) AS beta_2, round(t1, 4) AS t_1, round(t2, 4) AS t_2, round(r2, 8) AS r2 FROM ot")
def ols_fit(spark, d):
    out = G.ols(_prices(spark, d), ["series_id"], "y", ["a", "b"])
    at = lambda c, i, places: (F.round(F.get(c, i), places) + F.lit(0.0)).alias(f"{c}_{i + 1}")
    return out.select("series_id", "n", F.round("intercept", 2).alias("intercept"), at("beta", 0, 5), at("beta", 1, 4), at("t", 0, 4), at("t", 1, 4), F.round("r2", 8).alias("r2"))


@query(f"WITH {FD}, {PRICES}, {ols2_sql('xy', 'series_id')}, c AS (SELECT series_id, corr(y, a) AS c FROM xy GROUP BY 1) SELECT series_id, n, round(r2, 8) AS r2_full, round(c * c, 8) AS r2_less, round(r2 - c * c, 8) + 0.0 AS gain FROM o2 JOIN c USING (series_id)")
def incremental_r2(spark, d):
    return r(G.incremental_r2(_prices(spark, d), ["series_id"], "y", ["a", "b"], "b"), 8, "r2_full", "r2_less", "gain")


@query(f"""WITH {FD}, f AS (SELECT series_id, year(date) >= 1999 AS post, regr_slope(value, y) AS s, regr_intercept(value, y) AS i, count(*) AS n FROM fd GROUP BY 1, 2)
SELECT b.series_id, a.n + b.n AS n, round(b.s, 4) AS slope, round(a.i - b.i, 2) AS shift, round(a.s - b.s, 4) AS interaction FROM f a JOIN f b ON a.series_id = b.series_id AND a.post AND NOT b.post""")
def interaction_ols(spark, d):
    post = (F.year("date") >= 1999).cast("double")
    df = X.daily_prices(spark, d).withColumnsRenamed({"value": "v", "y": "x"}).withColumns({"post": post, "both": F.col("x") * post})
    out = G.ols(df, ["series_id"], "v", ["x", "post", "both"])
    return out.select("series_id", "n", F.round(F.get("beta", 0), 4).alias("slope"), F.round(F.get("beta", 1), 2).alias("shift"), F.round(F.get("beta", 2), 4).alias("interaction"))


@query(f"""WITH {FX}, g AS (SELECT series_id, date, value, lag(value) {W12} AS p FROM fx), k AS (SELECT unnest([1, 2, 3, 4])::INTEGER AS h), xy AS (SELECT g.series_id, h, f.value - g.p AS y, g.value - g.p AS a, g.p AS b FROM g, k, fx f WHERE f.series_id = g.series_id AND f.date = (g.date + h * INTERVAL 1 MONTH)::DATE),
{ols2_sql('xy', 'series_id, h')} SELECT series_id, h, n, round(b1, 6) AS response, round(t1, 4) AS t FROM ot""")
def local_projection(spark, d):
    fx = X.nation_series(spark, d)
    lag = F.lag("value").over(T.by())
    now = fx.withColumn("p", lag).withColumn("h", F.explode(F.array(*[F.lit(h) for h in (1, 2, 3, 4)]))).select("series_id", "h", F.col("value").alias("v"), "p", F.expr("add_months(date, h)").alias("date"))
    ahead = now.join(fx, ["series_id", "date"]).select("series_id", "h", (F.col("value") - F.col("p")).alias("y"), (F.col("v") - F.col("p")).alias("a"), F.col("p").alias("b"))
    out = G.ols(ahead, ["series_id", "h"], "y", ["a", "b"])
    return out.select("series_id", "h", "n", F.round(F.get("beta", 0), 6).alias("response"), F.round(F.get("t", 0), 4).alias("t"))


FACTORS = f"""l AS (SELECT series_id, date, 100 * ln(value / lag(value) {W12}) AS y FROM fx), k AS (SELECT l.*, topic, row_number() OVER (PARTITION BY series_id ORDER BY date) AS pos FROM l JOIN fc USING (series_id) WHERE y IS NOT NULL),
mk AS (SELECT date, avg(y) AS a FROM k GROUP BY 1), tk AS (SELECT date, topic, avg(y) AS b FROM k GROUP BY 1, 2), rf AS (SELECT k.*, a, b FROM k JOIN mk USING (date) JOIN tk USING (date, topic)),
e0 AS (SELECT rf.series_id, max(pos) AS ep FROM rf JOIN fe ON rf.series_id = fe.series_id AND rf.date <= fe.date GROUP BY 1 HAVING max(pos) > 12), est AS (SELECT rf.* FROM rf JOIN e0 USING (series_id) WHERE abs(pos - ep) > 2)"""


def _factors(spark, d):
    """Monthly log changes with two factors, the mean of all series and that of the topic, and each series' event position."""
    fx = X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic")), "series_id")
    k = fx.withColumn("y", 100 * F.log(F.col("value") / F.lag("value").over(T.by()))).where("y is not null").withColumn("pos", F.row_number().over(T.by()))
    mean = lambda by, name: k.groupBy(*by).agg(F.avg("y").alias(name))
    rows = k.join(mean(["date"], "a"), "date").join(mean(["date", "topic"], "b"), ["date", "topic"])
    events = _event_dates(spark, d).withColumnRenamed("date", "_d").join(k, "series_id").where("date <= _d").groupBy("series_id").agg(F.max("pos").alias("at")).where("at > 12")
    return rows.join(events, "series_id")


@query(f"""WITH {FX}, {FC}, {EVENTS_DIM}, {FACTORS}, {ols2_sql('est', 'series_id')}, ab AS (SELECT rf.series_id, y - (intercept + b1 * a + b2 * b) AS ab, n, sqrt((1 - r2) * syy * n / (n - 3)) AS sd FROM rf JOIN e0 USING (series_id) JOIN o2 USING (series_id) WHERE pos - ep BETWEEN 0 AND 2)
SELECT series_id, n, round(sum(ab), 4) AS car, count(*) AS days, round(sum(ab) / (any_value(sd) * sqrt(count(*))), 4) AS t FROM ab GROUP BY series_id, n""")
def multi_factor_car(spark, d):
    rows = _factors(spark, d)
    out = rows.where(F.abs(F.col("pos") - F.col("at")) > 2)
    fit = G.ols(out, ["series_id"], "y", ["a", "b"]).join(out.groupBy("series_id").agg(F.var_pop("y").alias("_v")), "series_id")
    expected = F.col("intercept") + F.get("beta", 0) * F.col("a") + F.get("beta", 1) * F.col("b")
    sd = F.sqrt((1 - F.col("r2")) * F.col("_v") * F.col("n") / (F.col("n") - 3))
    window = rows.where((F.col("pos") - F.col("at")).between(0, 2)).join(fit, "series_id").withColumns({"_ab": F.col("y") - expected, "_sd": sd})
    car = window.groupBy("series_id", "n").agg(F.sum("_ab").alias("car"), F.count("*").alias("days"), F.first("_sd").alias("_sd"))
    return car.select("series_id", "n", F.round("car", 4).alias("car"), "days", F.round(F.col("car") / (F.col("_sd") * F.sqrt("days")), 4).alias("t"))


@query(f"""WITH {FX}, {FC}, {EVENTS_DIM}, {FACTORS}, ln_ AS (SELECT series_id, regr_slope(b, a) AS s, regr_intercept(b, a) AS i FROM rf GROUP BY 1), xz AS (SELECT rf.series_id, year(date)::INTEGER AS year, rf.y, b - i - s * a AS z FROM rf JOIN ln_ USING (series_id))
SELECT series_id, year, count(*) AS n, round(regr_slope(y, z), 5) AS beta FROM xz GROUP BY 1, 2 HAVING count(*) >= 6""")
def orthogonal_factor(spark, d):
    every = X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d).select("series_id", "topic")), "series_id")
    k = every.withColumn("y", 100 * F.log(F.col("value") / F.lag("value").over(T.by()))).where("y is not null")
    mean = lambda by, name: k.groupBy(*by).agg(F.avg("y").alias(name))
    rows = k.join(mean(["date"], "a"), "date").join(mean(["date", "topic"], "b"), ["date", "topic"])
    line = G.ols(rows, ["series_id"], "b", ["a"]).select("series_id", "intercept", F.get("beta", 0).alias("_s"))
    z = rows.join(line, "series_id").withColumn("z", F.col("b") - F.col("intercept") - F.col("_s") * F.col("a"))
    out = G.ols(z.withColumn("year", F.year("date")), ["series_id", "year"], "y", ["z"])
    return out.where("n >= 6").select("series_id", "year", "n", F.round(F.get("beta", 0), 5).alias("beta"))
