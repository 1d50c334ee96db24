"""Statistics of panels and samples by key: regressions, contrasts, splits of change, event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import correlation


def log_trend(df: DataFrame, least: int = 8) -> DataFrame:
    """Yearly growth in per cent by the slope of log value on years; positive values, at least so many."""
    t = F.year("date") + (F.dayofyear("date") - 1) / 365.25
    out = df.where("value > 0").groupBy("series_id").agg(F.count("*").alias("n"), F.regr_slope(F.log("value"), t).alias("_s"))
    return out.where(F.col("n") >= least).select("series_id", "n", (100 * F.expm1("_s")).alias("growth"))


def residualize(df: DataFrame, y: str, x: str, fit: Column | None = None) -> DataFrame:
    """y less its line on x, recentred on y's mean; the line is fitted to the rows of `fit` alone."""
    rows = df if fit is None else df.where(fit)
    line = rows.groupBy("series_id").agg(F.regr_slope(y, x).alias("_s"), F.avg(x).alias("_mx"))
    return df.join(line, "series_id").withColumn("residual", F.col(y) - F.col("_s") * (F.col(x) - F.col("_mx"))).drop("_s", "_mx")


def two_factor_r2(df: DataFrame) -> DataFrame:
    """R squared of y on x1, on x2 and on both, from correlations, and each one's Shapley share of the last."""
    out = df.groupBy("series_id").agg(F.count("*").alias("n"), correlation("y", "x1").alias("_a"), correlation("y", "x2").alias("_b"), correlation("x1", "x2").alias("_c"))
    a, b, c = (F.col(k) for k in ("_a", "_b", "_c"))
    out = out.withColumns({"r2_1": a * a, "r2_2": b * b, "r2_both": F.try_divide(a * a + b * b - 2 * a * b * c, 1 - c * c)})
    both, one, two = F.col("r2_both"), F.col("r2_1"), F.col("r2_2")
    return out.withColumns({"shapley_1": (both - two + one) / 2, "shapley_2": (both - one + two) / 2}).drop("_a", "_b", "_c")


def twfe(df: DataFrame, unit: str, time: str, y: str, x: str) -> DataFrame:
    """One row: the coefficient of x with effects of unit and time, of a balanced panel, by demeaning both ways."""
    means = lambda c: F.avg(c).over(Window.partitionBy(unit)) + F.avg(c).over(Window.partitionBy(time))
    total = F.broadcast(df.agg(F.avg(y).alias("_gy"), F.avg(x).alias("_gx")))  # one row
    d = df.withColumns({"_my": means(y), "_mx": means(x)}).join(total, F.lit(True))
    dy, dx = F.col(y) - F.col("_my") + F.col("_gy"), F.col(x) - F.col("_mx") + F.col("_gx")
    return d.agg(F.count("*").alias("n"), F.try_divide(F.sum(dx * dy), F.sum(dx * dx)).alias("beta"))


def zscores(df: DataFrame, base: Column) -> DataFrame:
    """Values as standard scores of the series' base period; null where that has no spread."""
    b = df.where(base).groupBy("series_id").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return df.join(b, "series_id").withColumn("z", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def group_delta(df: DataFrame, outcome: str, unit: str, group: str, left: str, right: str) -> DataFrame:
    """Mean of unit means of left less that of right, by outcome; two units a side at least."""
    units = df.groupBy(outcome, group, unit).agg(F.avg("value").alias("_m"))
    side = lambda g: (F.avg(F.when(F.col(group) == g, F.col("_m"))), F.count(F.when(F.col(group) == g, F.col("_m"))))
    (a, na), (b, nb) = side(left), side(right)
    return units.groupBy(outcome).agg((a - b).alias("delta"), na.alias("n_left"), nb.alias("n_right")).where("n_left >= 2 and n_right >= 2")


def leave_one_out(df: DataFrame, group: str, unit: str) -> DataFrame:
    """Smallest and largest mean of unit means without one unit, from sums alone."""
    units = df.groupBy(group, unit).agg(F.avg("value").alias("_m"))
    w = Window.partitionBy(group)
    rest = units.withColumn("_x", (F.sum("_m").over(w) - F.col("_m")) / (F.count("*").over(w) - 1)).where("_x is not null")
    return rest.groupBy(group).agg(F.min("_x").alias("lowest"), F.max("_x").alias("highest"), F.min_by(unit, F.struct("_x", unit)).alias("lowest_without"))


def conditional_ratio(df: DataFrame, flag: Column, least: int = 3) -> DataFrame:
    """Mean where the flag holds over the mean elsewhere, with enough rows on both sides."""
    out = df.groupBy("series_id").agg(F.count_if(flag).alias("n_in"), F.count_if(~flag).alias("n_out"), F.try_divide(F.avg(F.when(flag, F.col("value"))), F.avg(F.when(~flag, F.col("value")))).alias("ratio"))
    return out.where((F.col("n_in") >= least) & (F.col("n_out") >= least))


def capture(df: DataFrame, y: str, x: str) -> DataFrame:
    """Mean of y over mean of x where x rises and where it falls, and their difference."""
    part = lambda c: F.try_divide(F.avg(F.when(c, F.col(y))), F.avg(F.when(c, F.col(x))))
    out = df.groupBy("series_id").agg(part(F.col(x) > 0).alias("up"), part(F.col(x) < 0).alias("down"))
    return out.withColumn("asymmetry", F.col("up") - F.col("down"))


def event_windows(df: DataFrame, events: DataFrame, before: int, after: int, estimation: int) -> DataFrame:
    """Cumulative abnormal change around each event: changes in rows [-before, after] from its first row, less the mean change
    of the `estimation` rows before those. Events whose windows run over a series' ends are left out.
    """
    w = Window.partitionBy("series_id").orderBy("date")
    frame = lambda a, b: w.rowsBetween(a, b)
    c = df.withColumn("_c", F.col("value") - F.lag("value").over(w))
    usual, n_usual = F.avg("_c").over(frame(-before - estimation, -before - 1)), F.count("_c").over(frame(-before - estimation, -before - 1))
    total, n_total = F.sum("_c").over(frame(-before, after)), F.count("_c").over(frame(-before, after))
    full = (n_usual == estimation) & (n_total == before + after + 1)
    rows = c.withColumn("car", F.when(full, total - (before + after + 1) * usual)).withColumn("_prev", F.lag("date").over(w))
    # the event's row is the first on or after its date, so each event meets one row of its series
    hit = rows.join(events.withColumnRenamed("date", "event_date"), "series_id").where((F.col("date") >= F.col("event_date")) & (F.col("_prev") < F.col("event_date")))
    return hit.where("car is not null").select("series_id", "event_date", "date", "car")


def growth_contribution(df: DataFrame, time: str, part: str) -> DataFrame:
    """A part's change over the change of the total, from one time to the next."""
    w = Window.partitionBy(part).orderBy(time)
    total = F.sum("value").over(Window.partitionBy(time))
    before = F.sum("_b").over(Window.partitionBy(time))
    out = df.withColumn("_b", F.when(F.lag(time).over(w) == F.col(time) - 1, F.lag("value").over(w)))
    return out.withColumn("contribution", F.try_divide(F.col("value") - F.col("_b"), total - before)).where("contribution is not null").drop("_b")


def price_volume(df: DataFrame, key: str, time: str) -> DataFrame:
    """Log change of value as log change of quantity plus that of unit value."""
    w = Window.partitionBy(key).orderBy(time)
    d = lambda c: F.log(c / F.lag(c).over(w))
    v, q = F.col("value"), F.col("quantity")
    return df.withColumns({"d_value": d(v), "d_quantity": d(q), "d_price": d(v / q)}).where("d_value is not null").drop("value", "quantity")


def balanced(df: DataFrame, group: str, unit: str, time: str) -> DataFrame:
    """Rows of the units that are there at every time of their group."""
    times = df.groupBy(group).agg(F.count_distinct(time).alias("_k"))
    whole = df.groupBy(group, unit).agg(F.count("*").alias("_n")).join(times, group).where("_n = _k").select(group, unit)
    return df.join(whole, [group, unit], "left_semi")


def twfe_by(df: DataFrame, group: str, unit: str, time: str, y: str, x: str) -> DataFrame:
    """group, n, beta: two-way fixed effects within each group's balanced panel."""
    mean = lambda c, *by: F.avg(c).over(Window.partitionBy(group, *by))
    off = lambda c: F.col(c) - mean(c, unit) - mean(c, time) + mean(c)
    d = df.withColumns({"_dy": off(y), "_dx": off(x)})
    return d.groupBy(group).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("_dx") * F.col("_dy")), F.sum(F.col("_dx") * F.col("_dx"))).alias("beta"))


def event_cars(df: DataFrame, events: DataFrame, windows: dict[str, tuple[int, int]], estimation: tuple[int, int], least: int, span: tuple[float, int] = (2.2, 15)) -> DataFrame:
    """series_id, event_date, window, raw, car, car_factor: what changes add up to in rows [a, b] around each event.

    df: series_id, date, change, factor. The event's row is the first on or after its date. car takes off the mean change of
    the estimation rows, car_factor their line on the factor (null with fewer than `least` rows that have it; a factor that
    lacks in the window counts as 0). Windows or estimation rows that run over a series' start or end are left out, and so
    are windows that cover more days than span[0] * rows + span[1]: series with holes there.
    """
    w = Window.partitionBy("series_id").orderBy("date")
    frame = lambda a, b: w.rowsBetween(a, b)
    est, size = frame(*estimation), estimation[1] - estimation[0] + 1
    both = F.when(F.col("factor").isNotNull(), F.col("change"))
    rows = df.withColumns({
        "_prev": F.lag("date").over(w), "_n": F.count("change").over(est), "_mean": F.avg("change").over(est), "_both": F.count("factor").over(est),
        "_slope": F.regr_slope("change", "factor").over(est), "_my": F.avg(both).over(est), "_mx": F.avg("factor").over(est),
    })
    sums = [
        F.struct(
            F.lit(name).alias("window"), F.lit(b - a + 1).alias("size"), F.count("change").over(frame(a, b)).alias("n"), F.sum("change").over(frame(a, b)).alias("raw"),
            F.sum(F.coalesce("factor", F.lit(0.0))).over(frame(a, b)).alias("f"), F.datediff(F.max("date").over(frame(a, b)), F.min("date").over(frame(a, b))).alias("days"),
        )
        for name, (a, b) in windows.items()
    ]
    rows = rows.withColumn("_w", F.array(*sums))
    hit = rows.join(events.select("series_id", F.col("date").alias("event_date")), "series_id").where((F.col("date") >= F.col("event_date")) & (F.col("_prev").isNull() | (F.col("_prev") < F.col("event_date"))))
    each = hit.select("*", F.explode("_w").alias("x")).where((F.col("_n") == size) & (F.col("x.n") == F.col("x.size")) & (F.col("x.days") <= span[0] * F.col("x.size") + span[1]))
    line = F.when(F.col("_both") >= least, F.col("x.raw") - F.col("x.size") * (F.col("_my") - F.col("_slope") * F.col("_mx")) - F.col("_slope") * F.col("x.f"))
    return each.select("series_id", "event_date", "x.window", "x.raw", (F.col("x.raw") - F.col("x.size") * F.col("_mean")).alias("car"), line.alias("car_factor"))
