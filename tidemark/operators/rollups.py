"""Aggregations of series, and the statistics of pairs and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import correlation


def series_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("value").alias("n_obs"), F.max_by("value", "date").alias("last_value"))


def annual(df: DataFrame, as_of_year: int, needed: int = 12) -> DataFrame:
    """Yearly value by the rule in column agg (sum, last or mean), with the count and whether the year is complete."""
    rule = F.first("agg")
    value = F.when(rule == "sum", F.sum("value")).when(rule == "last", F.max_by("value", "date")).otherwise(F.avg("value"))
    out = df.groupBy("series_id", F.year("date").alias("year")).agg(value.alias("value"), F.count("*").alias("n"))
    return out.withColumn("is_complete", (F.col("n") >= needed) & (F.col("year") < as_of_year))


def annual_yoy(yearly: DataFrame) -> DataFrame:
    """Change from year to year where both years are complete and follow each other."""
    w = Window.partitionBy("series_id").orderBy("year")
    lag = lambda c: F.lag(c).over(w)
    out = yearly.withColumns({"_v": lag("value"), "_y": lag("year"), "_c": lag("is_complete")})
    fit = F.col("is_complete") & F.col("_c") & (F.col("year") == F.col("_y") + 1) & (F.abs("_v") > 1e-9)
    return out.where(fit).select("series_id", "year", (100 * (F.col("value") / F.col("_v") - 1)).alias("yoy"))


def concentration(df: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Herfindahl index, effective number, fragmentation and number of parts above 5 %."""
    share = F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*group)))
    hhi = F.sum(F.pow("_s", F.lit(2)))
    return df.withColumn("_s", share).groupBy(*group).agg(hhi.alias("hhi"), F.try_divide(F.lit(1.0), hhi).alias("effective"), (1 - hhi).alias("fragmentation"), F.count_if(F.col("_s") > 0.05).alias("above_5"))


def top_k_within(df: DataFrame, group: list[str], label: str, value: str, k: int) -> DataFrame:
    """The k largest labels of each group with their share; ties by label."""
    w = Window.partitionBy(*group)
    out = df.withColumns({"share": F.try_divide(F.col(value), F.sum(value).over(w)), "pos": F.row_number().over(w.orderBy(F.desc(value), label))})
    return out.where(F.col("pos") <= k).select(*group, label, "share", "pos")


def pair_stats(df: DataFrame, least: int = 4) -> DataFrame:
    """For each series: points, Pearson correlation, mean absolute and median relative difference of x and y."""
    rel = F.when(F.col("x") != 0, 100 * F.abs(F.col("y") - F.col("x")) / F.abs("x"))
    out = df.groupBy("series_id").agg(F.count("*").alias("n"), correlation("x", "y").alias("corr"), F.avg(F.abs(F.col("y") - F.col("x"))).alias("mad"), F.median(rel).alias("med_rel_pct"))
    return out.where(F.col("n") >= least)


def average_rank(df: DataFrame, column: str, name: str, group: list[str]) -> DataFrame:
    """Ranks from 1, ties sharing their mean rank."""
    w = Window.partitionBy(*group)
    return df.withColumn(name, F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*group, column)) - 1) / 2)


def rank_corr(df: DataFrame) -> DataFrame:
    out = average_rank(average_rank(df, "x", "_rx", ["series_id"]), "y", "_ry", ["series_id"])
    return out.groupBy("series_id").agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("spearman"))


def regress(df: DataFrame) -> DataFrame:
    """Least squares of y on x for each series: slope, intercept, R squared, standard error and t of the slope."""
    out = df.groupBy("series_id").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"), F.count("*").alias("n")).where("n > 2")
    se = F.sqrt(F.try_divide(F.greatest(F.lit(0.0), (1 - F.col("r2")) * F.col("_syy")) / (F.col("n") - 2), F.col("_sxx")))
    return out.withColumn("se", se).withColumn("t", F.try_divide(F.col("slope"), F.col("se"))).drop("_sxx", "_syy")


def benjamini_hochberg(df: DataFrame, p: str, group: list[str]) -> DataFrame:
    """Adjusted p-values; null p-values stay null and do not count.

    The least over larger p runs along descending p: a frame that ends with its partition is worked out anew for each row.
    """
    w = Window.partitionBy(*group, F.col(p).isNull())
    raw = F.col(p) * F.count(p).over(w) / F.row_number().over(w.orderBy(p))
    tail = w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_raw", raw).withColumn("p_adj", F.least(F.lit(1.0), F.min("_raw").over(tail))).drop("_raw")


def bands(df: DataFrame, edges: list[float], group: list[str]) -> DataFrame:
    """Count, mean, lowest and highest value by value band; band i holds values below edges[i] and not below the one before."""
    band: Column = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        band = F.when(F.col("value") < e, F.lit(i)).otherwise(band)
    return df.groupBy(*group, band.alias("band")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def headline(df: DataFrame, keys: list[str], codes: str, total: str, sep: str = r"\|") -> DataFrame:
    """Rows whose codes are all totals; of a key without such rows those with the smallest code combination."""
    w = Window.partitionBy(*keys)
    is_total = F.forall(F.split(codes, sep), lambda c: c.rlike(total))
    out = df.withColumn("_total", is_total).withColumns({"_has": F.bool_or("_total").over(w), "_least": F.min(codes).over(w)})
    return out.where(F.when(F.col("_has"), F.col("_total")).otherwise(F.col(codes) == F.col("_least"))).drop("_total", "_has", "_least")


def finite(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither null nor NaN nor infinite."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))


def year_to_date(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """keys, year, months, total, to_date, change: sums by year, and by the part of each year that the last year has as well.

    The last month of the whole table sets that part, so that an unfinished year meets the same months of others. change: by
    how much to_date grew in percent; null where the year before is missing or its sum is 0. Rows without a date are left out.
    """
    rows = df.where(F.col(time).isNotNull()).withColumns({"year": F.year(time), "_m": F.month(time)})
    last = rows.agg(F.month(F.max(time)).alias("_last"))  # one row
    sums = rows.join(F.broadcast(last), F.lit(True)).groupBy(*keys, "year").agg(F.count_distinct("_m").alias("months"), F.sum(value).alias("total"), F.sum(F.when(F.col("_m") <= F.col("_last"), F.col(value))).alias("to_date"))
    w = Window.partitionBy(*keys).orderBy("year")  # a row a year
    before = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("to_date").over(w))
    return sums.withColumn("change", 100 * (F.try_divide(F.col("to_date"), before) - 1))
