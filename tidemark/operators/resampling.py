"""Resampling of series: rows (series_id, date, value) at another frequency, or marked where they break."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("date")


def resample(df: DataFrame, unit: str) -> DataFrame:
    """mean, last, total and n of each period of `unit` (month, quarter, year), dated at its start."""
    period = F.trunc("date", unit).alias("date")
    return df.groupBy("series_id", period).agg(F.avg("value").alias("mean"), F.max_by("value", "date").alias("last"), F.sum("value").alias("total"), F.count("value").alias("n"))


def month_last_partial(df: DataFrame) -> DataFrame:
    """A month's last value at its last day; a series' final month at its last observation."""
    monthly = df.groupBy("series_id", F.last_day("date").alias("month")).agg(F.max("date").alias("seen"), F.max_by("value", "date").alias("value"))
    final = F.max("month").over(Window.partitionBy("series_id"))
    return monthly.select("series_id", F.when(F.col("month") == final, F.col("seen")).otherwise(F.col("month")).alias("date"), "value")


def complete_months(df: DataFrame) -> DataFrame:
    """Sum and days of months that are observed up to their last day."""
    monthly = df.groupBy("series_id", F.last_day("date").alias("month")).agg(F.max("date").alias("seen"), F.sum("value").alias("total"), F.count("*").alias("days"))
    return monthly.where(F.col("seen") == F.col("month")).drop("seen")


def step_annual_mean(df: DataFrame) -> DataFrame:
    """Mean of each year of a step function, weighted by days; a value holds until the next date, the last one not at all."""
    spans = df.withColumn("until", F.lead("date").over(by_date())).where("until is not null")
    years = spans.withColumn("year", F.explode(F.sequence(F.year("date"), F.year(F.date_sub("until", 1)))))
    begin, end = F.greatest("date", F.make_date("year", F.lit(1), F.lit(1))), F.least("until", F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)))
    days = F.datediff(end, begin)
    return years.groupBy("series_id", "year").agg((F.sum(F.col("value") * days) / F.sum(days)).alias("mean"), F.sum(days).alias("days"))


def line_breaks(df: DataFrame, least_days: int = 45, times: float = 4) -> DataFrame:
    """The rows and, the day after a row, one without value where the next step exceeds least_days and `times` median steps."""
    steps = df.withColumn("step", F.datediff(F.lead("date").over(by_date()), "date"))
    usual = F.median("step").over(Window.partitionBy("series_id"))
    marked = steps.withColumn("gap", F.col("step") > F.greatest(F.lit(float(least_days)), times * usual))
    own = F.struct("date", "value")
    marker = F.struct(F.date_add("date", 1).alias("date"), F.lit(None).cast("double").alias("value"))
    rows = F.when(F.col("gap"), F.array(own, marker)).otherwise(F.array(own))
    return marked.select("series_id", F.explode(rows).alias("r")).select("series_id", "r.date", "r.value")


def ytd_to_quarter(df: DataFrame) -> DataFrame:
    """Quarters from year-to-date values (series_id, year, quarter, ytd): the first as it is, others only next to theirs."""
    w = Window.partitionBy("series_id", "year").orderBy("quarter")
    follows = F.lag("quarter").over(w) == F.col("quarter") - 1
    value = F.when(F.col("quarter") == 1, F.col("ytd")).when(follows, F.col("ytd") - F.lag("ytd").over(w))
    return df.withColumn("value", value).where("value is not null").drop("ytd")


def nearest_to(df: DataFrame, keys: list[str], column: str, target: float, within: float, ties: list[str]) -> DataFrame:
    """Of the rows of each key the one whose column is nearest the target and within the tolerance, without a sort."""
    gap = F.abs(F.col(column) - target)
    rest = [c for c in df.columns if c not in keys]
    return df.where(gap <= within).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(gap.alias("gap"), *ties)).alias("r")).select(*keys, "r.*")


def split_adjust(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Values divided by the product of the ratios of later splits (series_id, date, ratio), by one running sum from the end."""
    both = df.withColumn("_r", F.lit(None).cast("double")).unionByName(splits.select("series_id", "date", F.lit(None).cast("double").alias("value"), F.col("ratio").cast("double").alias("_r")), allowMissingColumns=True)
    w = Window.partitionBy("series_id").orderBy(F.desc("date")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = F.sum(F.coalesce(F.log("_r"), F.lit(0.0))).over(w) - F.sum(F.coalesce(F.log("_r"), F.lit(0.0))).over(Window.partitionBy("series_id", "date"))
    return both.withColumn("adjusted", F.col("value") / F.exp(later)).where("_r is null").drop("_r")


def total_return(df: DataFrame) -> DataFrame:
    """Index from 100 of price changes and payments: (value + paid) over the value before, multiplied up."""
    before = F.lag("value").over(by_date())
    step = F.coalesce(F.log((F.col("value") + F.col("paid")) / before), F.lit(0.0))
    return df.withColumn("_s", step).withColumn("index", 100 * F.exp(F.sum("_s").over(by_date().rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def trailing_year(df: DataFrame) -> DataFrame:
    """Sum of a series' values in the 365 days up to each row."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    return df.withColumn("ttm", F.sum("value").over(Window.partitionBy("series_id").orderBy(day).rangeBetween(-364, 0)))


def extend_by_growth(df: DataFrame, other: DataFrame) -> DataFrame:
    """df, and after its last date the other's values scaled to meet it there; a series without a common last date ends."""
    last = df.groupBy("series_id").agg(F.max("date").alias("_last"), F.max_by("value", "date").alias("_v"))
    o = other.select("series_id", "date", F.col("value").alias("_o")).join(last, "series_id")
    at = F.max(F.when(F.col("date") == F.col("_last"), F.col("_o"))).over(Window.partitionBy("series_id"))
    more = o.withColumn("value", F.col("_v") * F.col("_o") / at).where((F.col("date") > F.col("_last")) & F.col("value").isNotNull())
    return df.select("series_id", "date", "value").unionByName(more.select("series_id", "date", "value"))


def same_months_before(df: DataFrame, start: str, end: str, base: int) -> DataFrame:
    """Sum over months [start, end) and over the same calendar months of the base year, as often as each comes."""
    inside = df.where((F.col("date") >= start) & (F.col("date") < end)).select("series_id", F.month("date").alias("m"), "value")
    ref = df.where(F.year("date") == base).select("series_id", F.month("date").alias("m"), F.col("value").alias("_b"))
    return inside.join(ref, ["series_id", "m"], "left").groupBy("series_id").agg(F.sum("value").alias("total"), F.sum("_b").alias("base_total"), F.count("*").alias("months"))
