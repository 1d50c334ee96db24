"""A catalogue built in stages that are written down: one log of what went and why, and a restart after the last whole stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.sources.replacing import exists, replace_table

from .linking import rank_score

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run_stages(cat: DataFrame, stages: list[Stage], folder: str) -> tuple[DataFrame, DataFrame]:
    """The catalogue after all stages, and the log: series_id, title, stage, reason of each series that went.

    A stage takes the catalogue and gives it back with a column `reason`, null for what stays. Its result is written to the
    folder, whole or not at all; a run in a folder that holds the results of some stages goes on after the last of these.
    """
    spark = cat.sparkSession
    log = None
    for k, (name, stage) in enumerate(stages):
        path = f"{folder}/{k:02d}-{name}"
        if not exists(spark, path):
            replace_table(stage(cat), path, least=0)
        done = spark.read.parquet(path)
        cat = done.where("reason is null").drop("reason")
        gone = done.where("reason is not null").select("series_id", "title", F.lit(name).alias("stage"), "reason")
        log = gone if log is None else log.unionByName(gone)
    return cat, log


def curated(cat: DataFrame, least: int, coded: str) -> DataFrame:
    """Of series that are not native, those with too few points or a title that matches `coded` go."""
    reason = F.when(F.col("title").rlike(coded), "questionnaire item or by-product").when(F.coalesce("n_obs", F.lit(0)) < least, F.format_string("fewer than %d observations", F.lit(least)))
    return cat.withColumn("reason", F.when(F.col("priority") > 0, reason))


def cleaned(cat: DataFrame) -> DataFrame:
    """Titles and units of series that are not native: the unit is cleaned, else taken from a packed title, else from its brackets."""
    name, packed = C.packed_title(F.col("title"))
    is_packed = (F.col("priority") > 0) & F.col("title").rlike(r"^[^(]*,[^ ]")
    unit = F.coalesce(C.clean_unit(F.col("unit")), F.when(is_packed, packed), C.unit_of_title(F.col("title")))
    return cat.withColumns({"unit": F.when(F.col("priority") > 0, unit).otherwise(F.col("unit")), "title": C.clean_title(F.when(is_packed, name).otherwise(F.col("title"))), "reason": F.lit(None).cast("string")})


def without_annual_copies(cat: DataFrame, monthly: Column, annual_id: Column) -> DataFrame:
    """Yearly series go where a monthly one is there that names them; annual_id: what the yearly one of a monthly is called."""
    named = cat.where(monthly).select(annual_id.alias("series_id"), F.lit("annual copy of a monthly series").alias("reason")).distinct()
    return cat.join(named, "series_id", "left")


def merged_families(cat: DataFrame, source: str) -> DataFrame:
    """Tables of one statistic with several breakdowns: the one with fewest breakdowns (then most points, then id) stays, protected."""
    family, dims = C.family_key(F.col("series_id"))
    rows = cat.withColumns({"_f": F.when(F.col("series_id").startswith(source), family), "_d": F.size(dims)})
    w = Window.partitionBy("_f")
    first = F.first("series_id").over(w.orderBy("_d", F.desc("n_obs"), "series_id"))
    rows = rows.where("_f is not null").withColumns({"_first": first, "_n": F.count("*").over(w)}).unionByName(rows.where("_f is null"), allowMissingColumns=True)
    several = F.coalesce(F.col("_n"), F.lit(1)) > 1
    reason = F.when(several & (F.col("series_id") != F.col("_first")), F.concat(F.lit("merged into "), "_first"))
    return rows.withColumns({"reason": reason, "protected": F.col("protected") | several}).drop("_f", "_d", "_first", "_n")


def ranked(cat: DataFrame, as_of: str) -> DataFrame:
    return rank_score(cat.drop("rank"), as_of).withColumn("reason", F.lit(None).cast("string"))


def without_twins(cat: DataFrame, judged_pairs: DataFrame) -> DataFrame:
    """Series that a pair removes go; what they were copies of becomes canonical, all others single."""
    gone = judged_pairs.where("outcome = 'removed'")
    why = gone.select(F.col("dup").alias("series_id"), F.format_string("duplicate of %s (%s)", "keep", "basis").alias("reason"))
    kept = gone.select(F.col("keep").alias("series_id"), F.lit("canonical").alias("role")).distinct()
    return cat.join(why, "series_id", "left").join(kept, "series_id", "left").withColumn("role", F.coalesce("role", F.lit("single")))


def with_rule(cat: DataFrame) -> DataFrame:
    """How each series rolls up to a year."""
    rule = C.agg_rule(F.col("series_id"), F.col("title"), F.col("unit"), F.col("priority") == 0, F.col("freq") == "annual")
    return cat.withColumns({"agg": rule, "reason": F.lit(None).cast("string")})
