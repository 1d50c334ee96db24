"""Registered queries of the warehouse operators over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import joins as J
from tidemark.operators import rollups as R
from tidemark.operators import timeseries as T
from tidemark.sources import tables as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FX, FD, FC, FT = X.NATION_SERIES, X.DAILY_PRICES, X.CATALOGUE, X.TERMS_SQL
W12 = "OVER (PARTITION BY series_id ORDER BY date)"


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def yearly(spark: SparkSession, d: str) -> DataFrame:
    """The fixture series with its catalogue rule, one value a year."""
    return R.annual(X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d)), "series_id"), 2001)


YEARLY = f"""{FX}, {FC}, fy AS (
  SELECT series_id, year(date)::INTEGER AS year, CASE agg WHEN 'sum' THEN sum(value) WHEN 'last' THEN arg_max(value, date) ELSE avg(value) END AS value,
         count(*) AS n, count(*) >= 12 AND year(date) < 2001 AS is_complete
  FROM fx JOIN fc USING (series_id) GROUP BY series_id, year(date), agg)"""


@query(f"WITH {YEARLY} SELECT series_id, year, round(value, 4) AS value, n, is_complete FROM fy")
def annual_rollup(spark, d):
    return yearly(spark, d).withColumn("value", F.round("value", 4))


@query(f"""WITH {YEARLY}, l AS (SELECT *, lag(value) OVER w AS v, lag(year) OVER w AS y, lag(is_complete) OVER w AS c FROM fy WINDOW w AS (PARTITION BY series_id ORDER BY year))
SELECT series_id, year, round(100 * (value / v - 1), 6) AS yoy FROM l WHERE is_complete AND c AND year = y + 1 AND abs(v) > 1e-9""")
def annual_yoy(spark, d):
    return r6(R.annual_yoy(yearly(spark, d)), "yoy")


@query(f"WITH {FX}, {FC} SELECT series_id, date, value, topic, agg FROM fx JOIN fc USING (series_id)")
def v_observations(spark, d):
    return X.nation_series(spark, d).join(F.broadcast(X.catalogue(spark, d)), "series_id").select("series_id", "date", "value", "topic", "agg")


@query(f"WITH {FX} SELECT series_id, max(date) AS date, arg_max(value, date) AS value FROM fx GROUP BY 1")
def v_latest(spark, d):
    return T.latest(X.nation_series(spark, d))


@query(f'WITH {FX}, {FT} SELECT series_id, date, value, lean FROM fx LEFT JOIN ft ON date >= start AND date < "end"')
def v_politics(spark, d):
    return J.interval_join(X.nation_series(spark, d), X.terms(spark)).select("series_id", "date", "value", "lean")


@query(f'WITH {FX}, {FT} SELECT series_id, lean, round(avg(value), 4) AS mean, min(date) AS first, max(date) AS last, count(*) AS n FROM fx LEFT JOIN ft ON date >= start AND date < "end" WHERE lean IS NOT NULL GROUP BY 1, 2')
def v_by_term(spark, d):
    both = J.interval_join(X.nation_series(spark, d), X.terms(spark)).where("lean is not null")
    return both.groupBy("series_id", "lean").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


@query("SELECT n_name AS series_id, n_name AS title FROM nation WHERE n_name ILIKE '%n%1%'")
def v_search(spark, d):
    return X.table(spark, d, "nation").where(F.col("n_name").ilike("%n%1%")).select(F.col("n_name").alias("series_id"), F.col("n_name").alias("title"))


@query(f"WITH {FX} SELECT series_id, min(date) AS first, max(date) AS last, count(value) AS n_obs, arg_max(value, date) AS last_value FROM fx GROUP BY 1")
def series_stats(spark, d):
    return R.series_stats(X.nation_series(spark, d))


@query(f"WITH {FX}, l AS (SELECT *, lag(value, 12) {W12} AS b FROM fx) SELECT series_id, date, value, round(100 * (value / b - 1), 6) AS yoy FROM l WHERE b <> 0")
def yoy_positional(spark, d):
    return r6(T.yoy_positional(X.nation_series(spark, d)), "yoy")


@query(f"WITH {FX} SELECT a.series_id, a.date, a.value, round(100 * (a.value / b.value - 1), 6) AS yoy FROM fx a JOIN fx b ON a.series_id = b.series_id AND b.date = (a.date - INTERVAL 1 YEAR)::DATE WHERE b.value <> 0")
def yoy_calendar(spark, d):
    return r6(T.yoy_calendar(X.nation_series(spark, d)), "yoy")


GRID = "g AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS date FROM (SELECT series_id, min(date) AS a, max(date) AS b FROM fx GROUP BY 1))"


@query(f"WITH {FX}, {GRID} SELECT series_id, date, value FROM g LEFT JOIN fx USING (series_id, date)")
def densify(spark, d):
    return T.densify(X.nation_series(spark, d))


@query(f"WITH {FX}, {GRID} SELECT series_id, date, coalesce(value, 0) AS value FROM g LEFT JOIN fx USING (series_id, date)")
def densify_zero(spark, d):
    return T.densify(X.nation_series(spark, d), fill=0.0)


@query(f"""WITH {FX}, l AS (SELECT *, count(*) OVER w AS c, sum(value) OVER w AS s, avg(value) OVER w AS m, median(value) OVER w AS q FROM fx
WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 11 PRECEDING))
SELECT series_id, date, value, CASE WHEN c >= 12 THEN round(s, 2) END AS roll_sum, CASE WHEN c >= 12 THEN round(m, 4) END AS roll_mean, CASE WHEN c >= 12 THEN round(q, 4) END AS roll_median FROM l""")
def rolling_agg(spark, d):
    out = T.rolling(X.nation_series(spark, d), 12)
    return out.withColumns({"roll_sum": F.round("roll_sum", 2), "roll_mean": F.round("roll_mean", 4), "roll_median": F.round("roll_median", 4)})


@query(f"""WITH {FD}, l AS (SELECT series_id, date, count(*) OVER w AS c, corr(value, y) OVER w AS k, covar_samp(y, value) OVER w / var_samp(value) OVER w AS b FROM fd
WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 59 PRECEDING)) SELECT series_id, date, CASE WHEN c = 60 THEN round(k, 5) + 0.0 END AS roll_corr, CASE WHEN c = 60 THEN round(b * 1000, 5) + 0.0 END AS roll_beta FROM l""")
def rolling_corr_beta(spark, d):
    out = T.rolling_pair(X.daily_prices(spark, d).withColumnRenamed("value", "x"), 60)
    return out.select("series_id", "date", (F.round("roll_corr", 5) + F.lit(0.0)).alias("roll_corr"), (F.round(F.col("roll_beta") * 1000, 5) + F.lit(0.0)).alias("roll_beta"))


@query(f"""WITH {FX}, {GRID}, h AS (SELECT series_id, date, value FROM g LEFT JOIN fx USING (series_id, date))
SELECT series_id, date, value, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS ffill,
first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill FROM h""")
def fill_forward_back(spark, d):
    return T.fill_forward_back(T.densify(X.nation_series(spark, d)))


@query(f"""WITH {FX}, {GRID}, h AS (SELECT series_id, date, value FROM g LEFT JOIN fx USING (series_id, date)), k AS (
SELECT *, (SELECT max(date) FROM fx WHERE fx.series_id = h.series_id AND fx.date <= h.date) AS pd, (SELECT min(date) FROM fx WHERE fx.series_id = h.series_id AND fx.date >= h.date) AS nd FROM h)
SELECT k.series_id, k.date, round(coalesce(k.value, p.value + (n.value - p.value) * (k.date - pd) / (nd - pd)), 4) AS filled
FROM k JOIN fx p ON p.series_id = k.series_id AND p.date = pd JOIN fx n ON n.series_id = k.series_id AND n.date = nd""")
def interpolate_inside(spark, d):
    return T.interpolate_inside(T.densify(X.nation_series(spark, d))).select("series_id", "date", F.round("filled", 4).alias("filled"))


@query(f"""WITH {FX}, f AS (SELECT *, value < avg(value) OVER (PARTITION BY series_id) AS low FROM fx),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - row_number() OVER (PARTITION BY series_id, low ORDER BY date) AS run FROM f)
SELECT series_id, min(date) AS start, max(date) AS "end", count(*) AS n, min(value) AS lowest, round(avg(value), 4) AS mean FROM r WHERE low GROUP BY series_id, run HAVING count(*) >= 3""")
def run_length_episodes(spark, d):
    df = X.nation_series(spark, d).withColumn("m", F.avg("value").over(T.every()))
    return T.episodes(df, F.col("value") < F.col("m"), 3).withColumn("mean", F.round("mean", 4))


@query(f"""WITH {FD}, f AS (SELECT * FROM fd WHERE value < 30000), s AS (SELECT *, coalesce(date - lag(date) {W12} > 8, true)::INT AS new FROM f),
r AS (SELECT *, sum(new) {W12} AS run FROM s)
SELECT series_id, min(date) AS start, max(date) AS "end", count(*) AS n, min(value) AS lowest, round(avg(value), 4) AS mean FROM r GROUP BY series_id, run HAVING count(*) >= 4""")
def gap_merged_episodes(spark, d):
    return T.episodes(X.daily_prices(spark, d).drop("y"), F.col("value") < 30000, 4, 8).withColumn("mean", F.round("mean", 4))


@query(f"""WITH {FX}, l AS (SELECT *, lag(date) {W12} AS prev FROM fx)
SELECT series_id, prev, date, ((year(date) - year(prev)) * 12 + month(date) - month(prev))::INTEGER AS months FROM l WHERE (year(date) - year(prev)) * 12 + month(date) - month(prev) > 1""")
def find_gaps(spark, d):
    return T.gaps(X.nation_series(spark, d))


@query(f"""WITH {FX}, l AS (SELECT *, value < 0.85 * avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AND row_number() {W12} > 13 AS low FROM fx)
SELECT series_id, date, value FROM l WHERE date <= (SELECT max(date) FROM l k WHERE k.series_id = l.series_id AND NOT coalesce(k.low, false))""")
def trim_incomplete_tail(spark, d):
    return T.trim_incomplete_tail(X.nation_series(spark, d))


@query(f"WITH {FX}, b AS (SELECT series_id, arg_min(value, date) AS base FROM fx WHERE date >= DATE '1998-01-01' GROUP BY 1) SELECT series_id, date, value, round(value / base * 100, 6) AS rebased FROM fx JOIN b USING (series_id) WHERE date >= DATE '1998-01-01'")
def rebase(spark, d):
    return r6(T.rebase(X.nation_series(spark, d), "1998-01-01"), "rebased")


RATES = f"{FX}, fr AS (SELECT series_id, date, value, (date_part('day', date) + length(series_id) + month(date)) / 10.0 AS rate FROM fx)"


def _rates(spark, d):
    return X.nation_series(spark, d).withColumn("rate", (F.day("date") + F.length("series_id") + F.month("date")) / 10.0)


@query(f"WITH {RATES} SELECT series_id, date, round((exp(sum(ln(1 + rate / 100)) {W12}) - 1) * 100, 6) AS compounded FROM fr")
def chain_index(spark, d):
    return r6(T.compound(_rates(spark, d), "rate").select("series_id", "date", "compounded"), "compounded")


@query(f"""WITH {RATES}, l AS (SELECT *, count(*) OVER w AS c, sum(ln(1 + rate / 100)) OVER w AS s FROM fr WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 11 PRECEDING))
SELECT series_id, date, CASE WHEN c = 12 THEN round((exp(s) - 1) * 100, 6) END AS compounded FROM l""")
def compound_12m(spark, d):
    return r6(T.compound(_rates(spark, d), "rate", 12).select("series_id", "date", "compounded"), "compounded")


@query(f"""WITH {FX}, s AS (SELECT *, value / sum(value) OVER w AS s, count(*) OVER w AS n FROM fx WINDOW w AS (PARTITION BY series_id, year(date)))
SELECT series_id, month(date)::INTEGER AS month, round(avg(s), 6) AS factor FROM s WHERE n = 12 GROUP BY 1, 2""")
def seasonal_factor(spark, d):
    return r6(T.seasonal_factors(X.nation_series(spark, d)), "factor")


@query(f"WITH {FX} SELECT series_id, date, round(value - avg(value) OVER (PARTITION BY series_id, year(date)), 3) AS demeaned FROM fx")
def within_year_demean(spark, d):
    return T.year_demeaned(X.nation_series(spark, d)).select("series_id", "date", F.round("demeaned", 3).alias("demeaned"))


@query(f"""WITH {FX}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS r FROM fx), a AS (
SELECT series_id, sum(value) FILTER (WHERE r <= 12) AS x, sum(value) FILTER (WHERE r BETWEEN 13 AND 24) AS y FROM r GROUP BY 1 HAVING count(*) >= 24)
SELECT series_id, round(x, 2) AS last_n, round(y, 2) AS prior_n, round(100 * (x / y - 1), 6) AS pct FROM a WHERE y <> 0""")
def last_n_vs_prior_n(spark, d):
    out = T.last_n_vs_prior_n(X.nation_series(spark, d))
    return out.select("series_id", F.round("last_n", 2).alias("last_n"), F.round("prior_n", 2).alias("prior_n"), F.round("pct", 6).alias("pct"))


@query(f"""WITH {FX}, y AS (SELECT series_id, make_date(year(date), 12, 31) AS date, sum(value) AS value FROM fx GROUP BY 1, 2), a AS (
SELECT series_id, arg_min(value, date) AS v0, arg_max(value, date) AS v1, max(year(date)) - min(year(date)) AS n FROM y GROUP BY 1)
SELECT series_id, round(100 * (pow(v1 / v0, 1.0 / n) - 1), 6) AS cagr FROM a WHERE n > 0""")
def cagr(spark, d):
    y = X.nation_series(spark, d).groupBy("series_id", F.make_date(F.year("date"), F.lit(12), F.lit(31)).alias("date")).agg(F.sum("value").alias("value"))
    return r6(T.growth(y), "cagr")


@query(f"""WITH {FX}, l AS (SELECT *, lag(value, 12) {W12} AS b, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS r FROM fx) SELECT series_id, date, round(value - b, 3) AS diff FROM l WHERE r = 1""")
def nth_from_end(spark, d):
    return T.change_from_nth(X.nation_series(spark, d)).withColumn("diff", F.round("diff", 3))


@query(f"WITH {FX}, l AS (SELECT series_id, arg_max(value, date) AS v FROM fx GROUP BY 1) SELECT series_id, round(avg((value <= v)::INT), 6) AS pct_rank FROM fx JOIN l USING (series_id) GROUP BY 1")
def percentile_rank(spark, d):
    return r6(T.percentile_of_last(X.nation_series(spark, d)), "pct_rank")


@query(f"WITH {FX} SELECT series_id, min(date) AS first_below FROM fx WHERE value < 300000 GROUP BY 1")
def first_crossing(spark, d):
    return T.first_crossing(X.nation_series(spark, d), 300000)


@query(f"""WITH {FX}, l AS (SELECT *, max(date) OVER (PARTITION BY series_id) AS m FROM fx)
SELECT series_id, round(avg(value) FILTER (WHERE year(date) = year(m)), 4) AS ytd, round(avg(value) FILTER (WHERE year(date) = year(m) - 1), 4) AS prior_ytd FROM l WHERE month(date) <= month(m) GROUP BY 1""")
def ytd_vs_prior_ytd(spark, d):
    return T.ytd_vs_prior(X.nation_series(spark, d)).select("series_id", F.round("ytd", 4).alias("ytd"), F.round("prior_ytd", 4).alias("prior_ytd"))


@query(f"""WITH {FX}, k AS (SELECT unnest([-2, -1, 0, 1, 2])::INTEGER AS lag)
SELECT a.series_id, lag, count(*) AS n, round(corr(a.value, b.value), 6) AS corr FROM fx a CROSS JOIN k JOIN fx b ON a.series_id = b.series_id AND b.date = (a.date + lag * INTERVAL 1 MONTH)::DATE GROUP BY 1, 2""")
def lead_lag_pairs(spark, d):
    df = X.nation_series(spark, d)
    return r6(T.lead_lag(df, df, range(-2, 3)), "corr")


EVENTS_DIM = "fe AS (SELECT n_name AS series_id, (DATE '1996-01-15' + (n_nationkey * 61)::INTEGER) AS date FROM nation)"


def _event_dates(spark, d):
    return X.table(spark, d, "nation").select(F.col("n_name").alias("series_id"), F.expr("date_add(date'1996-01-15', cast(n_nationkey * 61 as int))").alias("date"))


@query(f"WITH {FX}, {EVENTS_DIM} SELECT fe.series_id, fe.date, max(fx.date) AS asof_date, arg_max(fx.value, fx.date) AS asof_value FROM fe LEFT JOIN fx ON fe.series_id = fx.series_id AND fx.date <= fe.date GROUP BY 1, 2")
def asof_backward(spark, d):
    return J.asof(_event_dates(spark, d), X.nation_series(spark, d), "series_id")


@query(f"WITH {FX}, {EVENTS_DIM} SELECT fe.series_id, fe.date, min(fx.date) AS asof_date, arg_min(fx.value, fx.date) AS asof_value FROM fe LEFT JOIN fx ON fe.series_id = fx.series_id AND fx.date > fe.date GROUP BY 1, 2")
def asof_forward(spark, d):
    return J.asof(_event_dates(spark, d), X.nation_series(spark, d), "series_id", direction="forward", strict=True)


@query(f"""WITH {FX}, {EVENTS_DIM}, r AS (SELECT fe.series_id, fe.date, fx.date AS asof_date, fx.value AS asof_value, row_number() OVER (PARTITION BY fe.series_id, fe.date ORDER BY abs(fx.date - fe.date), fx.date DESC) AS k
FROM fe JOIN fx ON fe.series_id = fx.series_id) SELECT series_id, date, asof_date, asof_value FROM r WHERE k = 1""")
def asof_nearest(spark, d):
    return J.asof_nearest(_event_dates(spark, d), X.nation_series(spark, d), "series_id")


SPANS = """sp AS (SELECT o_custkey AS key, o_orderstatus AS name, min(o_orderdate)::DATE AS start, max(o_orderdate)::DATE AS "end" FROM orders GROUP BY 1, 2)"""


@query(f"""WITH {SPANS} SELECT a.key, a.name AS a, b.name AS b, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end",
date_diff('month', greatest(a.start, b.start), least(a."end", b."end"))::INTEGER AS months FROM sp a JOIN sp b ON a.key = b.key AND a.name < b.name AND a.start < b."end" AND a."end" > b.start
WHERE date_diff('month', greatest(a.start, b.start), least(a."end", b."end")) >= 12""")
def interval_overlap(spark, d):
    """Spans from the first to the last order of each customer and status: where two of a customer overlap."""
    day = lambda f, n: F.to_date(f("o_orderdate")).alias(n)
    spans = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("name")).agg(day(F.min, "start"), day(F.max, "end"))
    return J.interval_overlap(spans, spans, 12, "key").where("a < b")


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) SELECT * FROM a UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM a)""")
def priority_merge(spark, d):
    urgent = X.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    a = X.table(spark, d, "customer").join(urgent, "c_custkey", "left_semi").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return J.priority_merge(a, X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ["id"])


@query("""WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE ' ' END AS name FROM customer), b AS (SELECT s_suppkey AS id, s_name AS name FROM supplier)
SELECT coalesce(a.id, b.id) AS id, coalesce(nullif(trim(a.name), ''), b.name) AS name FROM a FULL JOIN b ON a.id = b.id""")
def gap_fill_join(spark, d):
    a = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lit(" ")).alias("name"))
    return J.gap_fill(a, X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ["id"], ["name"])


@query(f"""WITH {FX}, a AS (SELECT * FROM fx WHERE month(date) <= 8), b AS (SELECT * FROM fx WHERE month(date) >= 6)
SELECT series_id, date, round(coalesce(a.value, 0) - coalesce(b.value, 0), 2) AS value FROM a FULL JOIN b USING (series_id, date)""")
def outer_arith(spark, d):
    fx = X.nation_series(spark, d)
    return J.outer_sum(fx.where(F.month("date") <= 8), fx.where(F.month("date") >= 6), ["series_id", "date"], -1).withColumn("value", F.round("value", 2))


@query(f"""WITH {FX}, o AS (SELECT n_name AS series_id, s_suppkey, s_acctbal, sum(s_acctbal) OVER w AS t, count(*) OVER w AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey WINDOW w AS (PARTITION BY n_name))
SELECT series_id, date, s_suppkey, round(value * CASE WHEN t <> 0 THEN s_acctbal / t ELSE 1.0 / c END, 2) AS part FROM fx JOIN o USING (series_id)""")
def prorata_join(spark, d):
    owners = X.table(spark, d, "supplier").join(F.broadcast(X.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("series_id"), "s_suppkey", "s_acctbal")
    return J.prorata(X.nation_series(spark, d), owners, "series_id", "s_acctbal").select("series_id", "date", "s_suppkey", F.round("part", 2).alias("part"))


@query(f"WITH {FX}, {FC}, m AS (SELECT date FROM fx GROUP BY 1 HAVING count(DISTINCT series_id) = (SELECT count(*) FROM fc) ORDER BY date DESC LIMIT 1) SELECT series_id, date, value FROM fx JOIN m USING (date)")
def last_common_period(spark, d):
    return J.last_common(X.nation_series(spark, d), X.catalogue(spark, d)).select("series_id", "date", "value")


BASKET = "b AS (SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority AS part, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"


def _basket(spark, d):
    return X.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("part")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


@query(f"""WITH {BASKET}, s AS (SELECT *, value / sum(value) OVER (PARTITION BY year) AS s FROM b)
SELECT year, round(sum(s * s), 6) AS hhi, round(1 / sum(s * s), 6) AS effective, round(1 - sum(s * s), 6) AS fragmentation, count(*) FILTER (WHERE s > 0.05) AS above_5 FROM s GROUP BY 1""")
def concentration(spark, d):
    return r6(R.concentration(_basket(spark, d), ["year"]), "hhi", "effective", "fragmentation")


@query(f"""WITH {BASKET}, s AS (SELECT *, value / sum(value) OVER (PARTITION BY year) AS share, row_number() OVER (PARTITION BY year ORDER BY value DESC, part)::INTEGER AS pos FROM b)
SELECT year, part, round(share, 6) AS share, pos FROM s WHERE pos <= 3""")
def top_k_within(spark, d):
    return r6(R.top_k_within(_basket(spark, d), ["year"], "part", "value", 3), "share")


@query(f"""WITH {FD} SELECT series_id, count(*) AS n, round(corr(value, y), 6) AS corr, round(avg(abs(y - value)), 4) AS mad, round(median(CASE WHEN value <> 0 THEN 100 * abs(y - value) / abs(value) END), 6) AS med_rel_pct FROM fd GROUP BY 1 HAVING count(*) >= 4""")
def reconcile_pairs(spark, d):
    out = R.pair_stats(X.daily_prices(spark, d).withColumnRenamed("value", "x"))
    return out.select("series_id", "n", F.round("corr", 6).alias("corr"), F.round("mad", 4).alias("mad"), F.round("med_rel_pct", 6).alias("med_rel_pct"))


@query(f"""WITH {FD}, r AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY value) + (count(*) OVER (PARTITION BY series_id, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY series_id ORDER BY y) + (count(*) OVER (PARTITION BY series_id, y) - 1) / 2.0 AS b FROM fd)
SELECT series_id, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def rank_corr(spark, d):
    return r6(R.rank_corr(X.daily_prices(spark, d).withColumnRenamed("value", "x")), "spearman")


@query(f"""WITH {FD}, a AS (SELECT series_id, regr_slope(y, value) AS s, regr_intercept(y, value) AS i, regr_r2(y, value) AS r2, regr_sxx(y, value) AS sxx, regr_syy(y, value) AS syy, count(*) AS n FROM fd GROUP BY 1)
SELECT series_id, round(s, 8) AS slope, round(i, 4) AS intercept, round(r2, 6) AS r2, n, round(sqrt((1 - r2) * syy / (n - 2) / sxx), 8) AS se, round(s / sqrt((1 - r2) * syy / (n - 2) / sxx), 4) AS t FROM a""")
def ols_by_series(spark, d):
    out = R.regress(X.daily_prices(spark, d).withColumnRenamed("value", "x"))
    return out.select("series_id", F.round("slope", 8).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n", F.round("se", 8).alias("se"), F.round("t", 4).alias("t"))


RISES = """rs AS (SELECT p_brand AS g, l_suppkey AS id, count(*) FILTER (WHERE l_returnflag = 'R') AS k, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
p AS (SELECT id, g, CASE WHEN n >= 5 THEN exp(-2.0 * n * pow(greatest(k / n - 1 / 3.0, 0), 2)) END AS p FROM rs)"""


@query(f"""WITH {RISES}, q AS (SELECT *, p * count(p) OVER (PARTITION BY g) / row_number() OVER (PARTITION BY g, p IS NULL ORDER BY p) AS raw FROM p), w AS (SELECT *, min(raw) OVER (PARTITION BY g, p IS NULL ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least_ FROM q)
SELECT id, g, round(p, 8) AS p, CASE WHEN p IS NOT NULL THEN round(least(1.0, least_), 8) END AS p_adj FROM w""")
def benjamini_hochberg(spark, d):
    """Bounds (Hoeffding's) on the chance of so many returned lines, by supplier, adjusted within each brand."""
    li = X.table(spark, d, "lineitem").join(X.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    s = li.groupBy(F.col("p_brand").alias("g"), F.col("l_suppkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    p = F.when(F.col("n") >= 5, F.exp(-2.0 * F.col("n") * F.pow(F.greatest(F.col("k") / F.col("n") - 1 / 3.0, F.lit(0.0)), F.lit(2))))
    out = R.benjamini_hochberg(s.withColumn("p", p), "p", ["g"])
    return out.select("id", "g", F.round("p", 8).alias("p"), F.when(F.col("p").isNotNull(), F.round("p_adj", 8)).alias("p_adj"))


@query(f"""WITH {FD} SELECT series_id, CASE WHEN value < 20000 THEN 0 WHEN value < 40000 THEN 1 ELSE 2 END AS band, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM fd GROUP BY 1, 2""")
def band_stats(spark, d):
    return R.bands(X.daily_prices(spark, d), [20000, 40000], ["series_id"]).withColumn("mean", F.round("mean", 4))


@query("SELECT c_mktsegment AS segment, round(quantile_cont(c_acctbal, 0.05), 4) AS p5, round(median(c_acctbal), 4) AS p50, round(quantile_cont(c_acctbal, 0.95), 4) AS p95, round(stddev_pop(c_acctbal), 4) AS sd_pop, round(stddev_samp(c_acctbal), 4) AS sd_samp FROM customer GROUP BY 1")
def quantiles_moments(spark, d):
    q = lambda p: F.round(F.percentile("c_acctbal", F.lit(p)), 4)
    return X.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(q(0.05).alias("p5"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.round(F.stddev_pop("c_acctbal"), 4).alias("sd_pop"), F.round(F.stddev_samp("c_acctbal"), 4).alias("sd_samp"))


@query("SELECT l_returnflag AS flag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted, round(sum(l_extendedprice) / sum(l_quantity), 6) AS ratio FROM lineitem GROUP BY 1")
def weighted_mean_ratio(spark, d):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return X.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.sum(p * q) / F.sum(q), 4).alias("weighted"), F.round(F.sum(p) / F.sum(q), 6).alias("ratio"))


@query(f"WITH {FD} SELECT series_id, year(date)::INTEGER AS year, count(*) FILTER (WHERE value < 30000) AS n_below, round(avg(value), 4) AS mean, max(value) AS peak, arg_max(date, value) AS peak_date FROM fd GROUP BY 1, 2")
def count_if_by_year(spark, d):
    return X.daily_prices(spark, d).groupBy("series_id", F.year("date").alias("year")).agg(F.count_if(F.col("value") < 30000).alias("n_below"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("peak"), F.max_by("date", "value").alias("peak_date"))


@query("""SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def crosstab(spark, d):
    out = X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("priority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])


@query(f"""WITH {FX} SELECT series_id, count(*) AS n, min(date) AS first, max(date) AS last, date_diff('day', max(date), DATE '2001-09-01')::INTEGER AS stale_days,
CASE WHEN date_diff('day', max(date), DATE '2001-09-01') > 60 THEN 'STALE' ELSE 'fresh' END AS status FROM fx GROUP BY 1""")
def dq_report(spark, d):
    age = F.datediff(F.lit("2001-09-01").cast("date"), F.max("date"))
    return X.nation_series(spark, d).groupBy("series_id").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), age.alias("stale_days"), F.when(age > 60, "STALE").otherwise("fresh").alias("status"))


@query("SELECT l_orderkey, l_linenumber, replace(format('{:.2f}', l_extendedprice), '.', ',') AS text, round(l_extendedprice, 2) AS value FROM lineitem")
def parse_br_number(spark, d):
    text = F.regexp_replace(F.format_string("%.2f", F.col("l_extendedprice")), r"\.", ",")
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text")).withColumn("value", S.br_number(F.col("text")))


@query("""SELECT o_orderkey, period, CASE o_orderkey % 3 WHEN 0 THEN make_date(y, 12, 31) WHEN 1 THEN last_day(make_date(y, q * 3, 1)) ELSE last_day(make_date(y, m, 1)) END AS period_end FROM (
SELECT o_orderkey, y, q, m, CASE o_orderkey % 3 WHEN 0 THEN y::VARCHAR WHEN 1 THEN y || 'Q' || q ELSE y || 'M' || lpad(m::VARCHAR, 2, '0') END AS period
FROM (SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, month(o_orderdate)::INTEGER AS m FROM orders))""")
def parse_period(spark, d):
    y, m = F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, y).when(F.col("o_orderkey") % 3 == 1, F.concat(y, F.lit("Q"), F.quarter("o_orderdate").cast("string"))).otherwise(F.concat(y, F.lit("M"), F.lpad(m, 2, "0")))
    return X.table(spark, d, "orders").select("o_orderkey", text.alias("period")).withColumn("period_end", S.period_end(F.col("period")))


@query("SELECT p_partkey, round(least(100.0, greatest(0.0, 100 * (p_retailprice - 950) / (1900 - 950))), 6) AS gauge FROM part")
def gauge_position(spark, d):
    return X.table(spark, d, "part").select("p_partkey", F.round(S.gauge(F.col("p_retailprice"), 950, 1900), 6).alias("gauge"))


@query("""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda t: t NOT IN ('the', 'and', 'that')))) AS n_tokens FROM documents""")
def tokenize(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.size(S.tokens(F.col("text"), ["the", "and", "that"])).cast("long").alias("n_tokens"))
