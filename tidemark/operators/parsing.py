"""From text lines, wide tables and markup to typed rows, and from series to packed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.files import sum_before


def fixed_width(df: DataFrame, line: str, fields: dict[str, tuple[int, int, str]]) -> DataFrame:
    """Slices of a line as columns: name -> (first character from 1, length, type); what does not parse is null."""
    part = lambda at, n: F.trim(F.substring(line, at, n))
    return df.select(*[part(at, n).try_cast(kind).alias(name) for name, (at, n, kind) in fields.items()])


def melt_periods(df: DataFrame, ids: list[str], periods: list[str], missing: str = "..") -> DataFrame:
    """One row for each id and period column that holds a number; the period's name stays text."""
    long = df.unpivot(ids, periods, "period", "text")
    return long.where(F.col("text") != missing).withColumn("value", F.col("text").try_cast("double")).where("value is not null").drop("text")


def strip_html(html: Column) -> Column:
    """Tags become blanks, runs of white space one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \t\n\r\f]+", " "))


def conform(df: DataFrame, value: str, **columns: Column) -> DataFrame:
    """The named columns and the value as double; rows whose value is null, NaN or infinite go."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(*[c.alias(n) for n, c in columns.items()], v.alias("value"))


def first_rule(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern found in the text."""
    out = F.lit(other)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def phrase_rates(df: DataFrame, text: str, left: list[str], right: list[str], least: int = 300) -> DataFrame:
    """Words of a text, hits of two word lists per thousand, and (left - right) / (left + right) of long enough texts."""
    words = df.withColumn("_w", F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)))
    hits = lambda ws: F.size(F.filter("_w", lambda w: w.isin(ws)))
    out = words.withColumns({"n_words": F.size("_w").cast("long"), "_l": hits(left), "_r": hits(right)}).where(F.col("n_words") >= least)
    score = F.when(F.col("_l") + F.col("_r") > 0, (F.col("_l") - F.col("_r")) / (F.col("_l") + F.col("_r")))
    return out.withColumns({"left_rate": 1000 * F.col("_l") / F.col("n_words"), "right_rate": 1000 * F.col("_r") / F.col("n_words"), "score": score}).drop("_w", "_l", "_r", text)


def series_chunks(df: DataFrame, points: int) -> DataFrame:
    """Each series as an array of (epoch day, value), and the chunk of about so many points that it goes to."""
    packed = df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), "value"))).alias("points"))
    starts = sum_before(df.groupBy("series_id").agg(F.count("*").alias("n")), "series_id", "n", "before")
    return packed.join(starts.select("series_id", "n", F.floor(F.col("before") / points).cast("long").alias("chunk")), "series_id")


def unnest_lookup(df: DataFrame, codes: str, labels: DataFrame) -> DataFrame:
    """df with the labels of its codes joined by |, joined by commas in the same order; a code without label stays.

    Each distinct combination is looked up once.
    """
    each = df.select(codes).distinct().select(codes, F.posexplode(F.split(codes, r"\|")).alias("_at", "code")).join(labels, "code", "left")
    named = each.groupBy(codes).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("label", "code").alias("label")))).alias("_l"))
    return df.join(named.select(codes, F.array_join("_l.label", ", ").alias("labels")), codes, "left")
