"""Window operators on long series tables (series_id, date, value). Each takes and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import correlation

def by():
    """A series in the order of its dates."""
    return Window.partitionBy("series_id").orderBy("date")


def every():
    return Window.partitionBy("series_id")


def months_between_starts(later: Column, earlier: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def change(now: Column, before: Column) -> Column:
    """Percentage change; null where the earlier value is 0."""
    return F.when(before != 0, 100 * (now / before - 1))


def yoy_positional(df: DataFrame, rows: int = 12) -> DataFrame:
    """Change against the value `rows` rows back, whatever its date."""
    return df.withColumn("yoy", change(F.col("value"), F.lag("value", rows).over(by()))).where(F.col("yoy").isNotNull())


def densify(df: DataFrame, step: str = "1 month", fill: float | None = None) -> DataFrame:
    """One row for each step from a series' first to its last date; missing values are null or `fill`."""
    grid = df.groupBy("series_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = grid.select("series_id", F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("date"))
    out = grid.join(df, ["series_id", "date"], "left")
    return out if fill is None else out.fillna(fill, ["value"])


def yoy_calendar(df: DataFrame) -> DataFrame:
    """Change against the same month a year before; months without either value are left out."""
    return yoy_positional(densify(df), 12)


def rolling(df: DataFrame, rows: int, least: int | None = None) -> DataFrame:
    """Sum, mean and median of the last `rows` rows; null until `least` of them have a value."""
    w = by().rowsBetween(1 - rows, 0)
    enough = F.count("value").over(w) >= (least or rows)
    fits = lambda c: F.when(enough, c)
    values = F.sort_array(F.collect_list("value").over(w))  # at most `rows` values
    middle = lambda k: F.get(values, F.floor((F.size(values) - k) / 2).cast("int"))
    return df.withColumns({"roll_sum": fits(F.sum("value").over(w)), "roll_mean": fits(F.avg("value").over(w)), "roll_median": fits((middle(1) + middle(0)) / 2)})


def rolling_pair(df: DataFrame, rows: int) -> DataFrame:
    """Correlation of x and y and slope of y on x over the last `rows` rows; null where flat."""
    w = by().rowsBetween(1 - rows, 0)
    full = F.count("*").over(w) == rows
    return df.withColumns({"roll_corr": F.when(full, F.try_divide(F.covar_samp("x", "y").over(w), F.stddev_samp("x").over(w) * F.stddev_samp("y").over(w))), "roll_beta": F.when(full, F.try_divide(F.covar_samp("x", "y").over(w), F.var_samp("x").over(w)))})


def fill_forward_back(df: DataFrame) -> DataFrame:
    ahead = by().rowsBetween(0, Window.unboundedFollowing)
    behind = by().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"ffill": F.last("value", True).over(behind), "bfill": F.first("value", True).over(ahead)})


def interpolate_inside(df: DataFrame) -> DataFrame:
    """Straight lines by time between known values; nothing before the first or after the last."""
    known = F.when(F.col("value").isNotNull(), F.struct("date", "value"))
    prev = F.last(known, True).over(by().rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(known, True).over(by().rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumns({"_p": prev, "_n": nxt})
    share = F.datediff("date", "_p.date") / F.datediff("_n.date", "_p.date")
    line = F.col("_p.value") + (F.col("_n.value") - F.col("_p.value")) * share
    return out.withColumn("filled", F.coalesce("value", line)).drop("_p", "_n")


def episodes(df: DataFrame, flag: Column, least: int, max_gap_days: int | None = None) -> DataFrame:
    """Runs of flagged rows: with max_gap_days, flagged rows at most that many days apart; otherwise rows in a row."""
    if max_gap_days is None:
        rows = df.withColumn("_f", flag.cast("int"))
        rows = rows.withColumn("_run", F.row_number().over(by()) - F.row_number().over(Window.partitionBy("series_id", "_f").orderBy("date"))).where("_f = 1")
    else:
        rows = df.where(flag)
        new = F.coalesce(F.datediff("date", F.lag("date").over(by())) > max_gap_days, F.lit(True)).cast("int")
        rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by().rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("series_id", "_run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n"), F.min("value").alias("lowest"), F.avg("value").alias("mean"))
    return out.where(F.col("n") >= least).drop("_run")


def gaps(df: DataFrame, most_months: int = 1) -> DataFrame:
    """Steps of more than most_months months."""
    out = df.withColumn("prev", F.lag("date").over(by())).withColumn("months", months_between_starts(F.col("date"), F.col("prev")))
    return out.where(F.col("months") > most_months).select("series_id", "prev", "date", "months")


def trim_incomplete_tail(df: DataFrame, share: float = 0.85, rows: int = 12) -> DataFrame:
    """Drop trailing rows while they are below `share` of the mean of the `rows` rows before; needs more than rows + 1 rows."""
    before = F.avg("value").over(by().rowsBetween(-rows, -1))
    out = df.withColumn("_low", (F.col("value") < share * before) & (F.row_number().over(by()) > rows + 1))
    last = F.max(F.when(~F.coalesce("_low", F.lit(False)), F.col("date"))).over(every())
    return out.withColumn("_last", last).where(F.col("date") <= F.col("_last")).drop("_low", "_last")


def rebase(df: DataFrame, base: str, level: float = 100) -> DataFrame:
    """Level at the first date on or after base; earlier rows are left out."""
    out = df.where(F.col("date") >= F.lit(base).cast("date"))
    return out.withColumn("rebased", F.col("value") / F.first("value", True).over(by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * level)


def compound(df: DataFrame, rate: str, rows: int | None = None) -> DataFrame:
    """Compounded percentage rates, over the last `rows` rows (null until there are as many) or since the start."""
    w = by().rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, 0)
    total = F.expm1(F.sum(F.log1p(F.col(rate) / 100)).over(w)) * 100
    return df.withColumn("compounded", total if rows is None else F.when(F.count(rate).over(w) == rows, total))


def seasonal_factors(df: DataFrame) -> DataFrame:
    """Mean share of each calendar month in its year, over years with twelve months."""
    year = Window.partitionBy("series_id", F.year("date"))
    out = df.withColumns({"_s": F.col("value") / F.sum("value").over(year), "_n": F.count("*").over(year)}).where("_n = 12")
    return out.groupBy("series_id", F.month("date").alias("month")).agg(F.avg("_s").alias("factor"))


def year_demeaned(df: DataFrame) -> DataFrame:
    return df.withColumn("demeaned", F.col("value") - F.avg("value").over(Window.partitionBy("series_id", F.year("date"))))


def last_n_vs_prior_n(df: DataFrame, n: int = 12) -> DataFrame:
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date"))))
    part = lambda lo, hi: F.sum(F.when(F.col("_r").between(lo, hi), F.col("value")))
    out = rows.groupBy("series_id").agg(part(1, n).alias("last_n"), part(n + 1, 2 * n).alias("prior_n"), F.count("*").alias("_c")).where(F.col("_c") >= 2 * n)
    return out.drop("_c").withColumn("pct", change(F.col("last_n"), F.col("prior_n")))


def growth(df: DataFrame) -> DataFrame:
    """Yearly compound growth between the first and last value of yearly rows."""
    out = df.groupBy("series_id").agg(F.min_by("value", "date").alias("v0"), F.max_by("value", "date").alias("v1"), F.min("date").alias("d0"), F.max("date").alias("d1"))
    years = F.year("d1") - F.year("d0")
    return out.where(years > 0).select("series_id", (100 * (F.pow(F.col("v1") / F.col("v0"), 1 / years) - 1)).alias("cagr"))


def latest(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))


def change_from_nth(df: DataFrame, n: int = 12) -> DataFrame:
    """Last value minus the value n rows before."""
    out = df.withColumn("_b", F.lag("value", n).over(by())).withColumn("_r", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date"))))
    return out.where("_r = 1").select("series_id", "date", (F.col("value") - F.col("_b")).alias("diff"))


def percentile_of_last(df: DataFrame) -> DataFrame:
    """Share of a series' values at or below its last one."""
    last = F.last("value").over(by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("_l", last).groupBy("series_id").agg(F.avg((F.col("value") <= F.col("_l")).cast("double")).alias("pct_rank"))


def first_crossing(df: DataFrame, below: float) -> DataFrame:
    return df.where(F.col("value") < below).groupBy("series_id").agg(F.min("date").alias("first_below"))


def ytd_vs_prior(df: DataFrame) -> DataFrame:
    """Mean of the last year's months against the mean of the same months a year before."""
    out = df.withColumn("_last", F.max("date").over(every())).where(F.month("date") <= F.month("_last"))
    part = lambda k: F.avg(F.when(F.year("date") == F.year("_last") - k, F.col("value")))
    return out.groupBy("series_id").agg(part(0).alias("ytd"), part(1).alias("prior_ytd"))


def lead_lag(df: DataFrame, other: DataFrame, lags: range) -> DataFrame:
    """Correlation of x at a month with y `lag` months later, for each series and lag."""
    x = df.select("series_id", "date", F.col("value").alias("x")).withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    y = other.select("series_id", F.col("date").alias("_d"), F.col("value").alias("y"))
    both = x.withColumn("_d", F.add_months("date", F.col("lag"))).join(y, ["series_id", "_d"])
    return both.groupBy("series_id", "lag").agg(F.count("*").alias("n"), correlation("x", "y").alias("corr"))


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def fourth_quarter(df: DataFrame) -> DataFrame:
    """q4: the full year fy less ytd, or less the sum of the three quarters (parts) where ytd is missing or 0."""
    return df.withColumn("q4", F.col("fy") - F.coalesce(F.nullif("ytd", F.lit(0.0)), "parts"))


def splice(df: DataFrame, segments: DataFrame, line: str) -> DataFrame:
    """One line from series that take turns: rows inside a series' segment (half open), with ret, which never crosses a seam."""
    inside = df.join(segments, "series_id").where((F.col("date") >= F.col("start")) & (F.col("date") < F.col("end")))
    before = F.lag("value").over(Window.partitionBy(line, "series_id").orderBy("date"))
    return inside.withColumn("ret", F.col("value") / before - 1)


def adjusted_returns(df: DataFrame) -> DataFrame:
    """ret: log change plus the log of the split ratio and the dividend on the last value; level compounds it."""
    before = F.lag("value").over(by())
    ret = F.log(F.col("value") / before) + F.log(F.col("split").cast("double")) + F.col("dividend") / before
    out = df.withColumn("ret", ret)
    return out.withColumn("level", F.exp(F.sum(F.coalesce("ret", F.lit(0.0))).over(by().rowsBetween(Window.unboundedPreceding, 0))))


def window_did(df: DataFrame, breaks: DataFrame, months: int) -> DataFrame:
    """did: growth on the same months a year before, of the months from a break on less that of as many before it.

    breaks: at. Null if any of the months or of those a year before is missing. Every break meets the months around it.
    """
    ago = df.select("series_id", F.add_months("date", 12).alias("date"), F.col("value").alias("_p"))
    pairs = df.join(ago, ["series_id", "date"]).withColumn("at", F.explode(F.transform(F.sequence(F.lit(1 - months), F.lit(months)), lambda k: F.add_months("date", k))))
    near = pairs.join(breaks, "at")
    after = F.col("date") >= F.col("at")
    growth = lambda side: F.sum(F.when(side, F.col("value"))) / F.sum(F.when(side, F.col("_p")))
    whole = (F.count_if(after) == months) & (F.count_if(~after) == months)
    return near.groupBy("series_id", "at").agg(F.when(whole, 100 * (growth(after) - growth(~after))).alias("did"))


def change_before(df: DataFrame, events: DataFrame, lead: int, stale_start: int, stale_end: int) -> DataFrame:
    """change: last value before an event less the last one `lead` days before it, each of so many days at most.

    z and usual compare it with the series' other events: standard score, and within the middle half. events: series_id, event.
    """
    near = df.join(events, "series_id").withColumn("_d", F.datediff("event", "date"))
    last = lambda lo, hi: F.max_by("value", F.when((F.col("_d") > lo) & (F.col("_d") <= hi), F.col("date")))
    near = near.where((F.col("_d") > 0) & (F.col("_d") <= lead + stale_start))
    g = near.groupBy("series_id", "event").agg(last(lead, lead + stale_start).alias("_a"), last(0, stale_end).alias("_b")).where("_a is not null and _b is not null").withColumn("change", F.col("_b") - F.col("_a"))
    s = g.groupBy("series_id").agg(F.avg("change").alias("_m"), F.stddev_samp("change").alias("_s"), F.percentile("change", F.lit(0.25)).alias("_lo"), F.percentile("change", F.lit(0.75)).alias("_hi"))
    return g.join(s, "series_id").withColumns({"z": (F.col("change") - F.col("_m")) / F.col("_s"), "usual": F.col("change").between(F.col("_lo"), F.col("_hi"))})


def derived(wide: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """series_id, date, value: a series for each rule, where it has a value. wide: date and one column an input."""
    values = wide.select("date", *[v.alias(f"_{i}") for i, v in enumerate(rules.values())])
    each = F.array(*[F.struct(F.lit(name).alias("series_id"), F.col(f"_{i}").alias("value")) for i, name in enumerate(rules)])
    return values.select("date", F.inline(each)).where("value is not null")


def transformed(yearly: DataFrame, specs: DataFrame) -> DataFrame:
    """outcome: the level, difference or log difference (per cent) of v, as each series' transform in specs says."""
    before = F.lag("v").over(Window.partitionBy("series_id").orderBy("year"))
    rows = yearly.withColumn("_p", before).join(specs, "series_id")
    outcome = F.when(F.col("transform") == "level", F.col("v")).when(F.col("transform") == "diff", F.col("v") - F.col("_p")).when(F.col("transform") == "log_diff", 100 * F.log(F.col("v") / F.col("_p")))
    return rows.withColumn("outcome", outcome).where("outcome is not null").drop("_p")


def splice_by_overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, then new rescaled by the geometric mean of their ratio at common dates, after old's last date."""
    ratio = old.select("series_id", "date", F.col("value").alias("_o")).join(new, ["series_id", "date"]).groupBy("series_id").agg(F.exp(F.avg(F.log(F.col("_o") / F.col("value")))).alias("_k"))
    last = old.groupBy("series_id").agg(F.max("date").alias("_last"))
    after = new.join(ratio, "series_id").join(last, "series_id").where(F.col("date") > F.col("_last"))
    return old.select("series_id", "date", "value").unionByName(after.select("series_id", "date", (F.col("value") * F.col("_k")).alias("value")))
