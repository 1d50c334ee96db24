"""Checks of series and tables; each returns the rows or counts that a report shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timeseries as T


def gap_scan(df: DataFrame, most_months: int = 1) -> DataFrame:
    """For each series its rows, gaps and verdict."""
    found = T.gaps(df, most_months).groupBy("series_id").agg(F.count("*").alias("gaps"))
    out = df.groupBy("series_id").agg(F.count("*").alias("n")).join(found, "series_id", "left").fillna(0, ["gaps"])
    return out.withColumn("verdict", F.when(F.col("gaps") == 0, "pass").otherwise("fail"))


def coverage(df: DataFrame, theme: str, done: Column) -> DataFrame:
    """done, total and share of rows by theme."""
    return df.groupBy(theme).agg(F.count_if(done).alias("done"), F.count("*").alias("total")).withColumn("share", F.col("done") / F.col("total"))


def reference_equality(df: DataFrame, reference: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """For each series: points equal to the reference within a relative tolerance, unequal, missing and extra ones."""
    a = df.select("series_id", "date", F.col("value").alias("_a"))
    both = a.join(reference.select("series_id", "date", F.col("value").alias("_b")), ["series_id", "date"], "full")
    near = F.abs(F.col("_a") - F.col("_b")) <= tolerance * F.greatest(F.abs("_b"), F.lit(1e-300))
    count = lambda c, n: F.count_if(c).alias(n)
    return both.groupBy("series_id").agg(count(near, "equal"), count(~near, "unequal"), count(F.col("_a").isNull(), "missing"), count(F.col("_b").isNull(), "extra"))


def deviation(df: DataFrame, other: DataFrame) -> DataFrame:
    """Median and largest percentage deviation of other from df on common dates."""
    both = df.join(other.select("series_id", "date", F.col("value").alias("_o")), ["series_id", "date"])
    pct = F.when(F.col("value") != 0, 100 * F.abs(F.col("_o") / F.col("value") - 1))
    return both.groupBy("series_id").agg(F.count("*").alias("n"), F.median(pct).alias("median_pct"), F.max(pct).alias("max_pct"))


def parts_sum(parts: DataFrame, totals: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Keys whose parts (column part) do not add up to the total (column total) within the tolerance."""
    out = parts.groupBy(key).agg(F.sum("part").alias("parts")).join(totals.select(key, "total"), key)
    return out.where(F.abs(F.col("parts") - F.col("total")) > tolerance)


def restated(df: DataFrame, keys: list[str], version: str, value: str, share: float = 0.005) -> DataFrame:
    """First and last version of each key where they differ by more than the share."""
    out = df.groupBy(*keys).agg(F.min_by(value, version).alias("original"), F.max_by(value, version).alias("restated"), F.count("*").alias("versions"))
    return out.where((F.col("original") != 0) & (F.abs(F.col("restated") / F.col("original") - 1) > share))


def outliers(df: DataFrame, most: float = 0.2) -> DataFrame:
    """Rows whose change from the row before exceeds the share."""
    before = F.lag("value").over(T.by())
    return df.withColumn("change", F.when(before != 0, F.col("value") / before - 1)).where(F.abs("change") > most)


def shrink_gate(new: DataFrame, old: DataFrame, least: float = 0.9) -> DataFrame:
    """One row: series and points of both, and whether neither fell below the share."""
    count = lambda df, p: df.agg(F.count_distinct("series_id").alias(f"{p}_series"), F.count("*").alias(f"{p}_points"))
    both = count(new, "new").join(F.broadcast(count(old, "old")), F.lit(True))  # one row each
    ok = (F.col("new_series") >= least * F.col("old_series")) & (F.col("new_points") >= least * F.col("old_points"))
    return both.withColumn("ok", ok)


def incomplete_years(df: DataFrame, needed: int = 12) -> DataFrame:
    """Years between a series' first and last year that lack rows."""
    years = df.groupBy("series_id", F.year("date").alias("year")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("series_id")
    out = years.withColumns({"_a": F.min("year").over(w), "_b": F.max("year").over(w)})
    return out.where((F.col("n") < needed) & (F.col("year") > F.col("_a")) & (F.col("year") < F.col("_b"))).drop("_a", "_b")


def carried_class(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Whether any earlier row of the key was flagged; false for its first row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({"flag": flag, "predicted": F.coalesce(F.bool_or(flag).over(w), F.lit(False))})
