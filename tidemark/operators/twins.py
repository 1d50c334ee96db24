"""Copies of series among other editions: candidate pairs, and which of a pair goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import tokens
from tidemark.sources.files import materialize

from .overlap import met

#: Series of a catalogue that are sent to every task of their pairs; with more, pairs are shuffled to them.
SENT = 500_000


def with_changes(df: DataFrame, id_col: str, time: str, value: str, before: Column) -> DataFrame:
    """df with `change`, the value less that of the date before; null where the series lacks that date."""
    w = Window.partitionBy(id_col).orderBy(time)
    return df.withColumn("change", F.when(F.lag(time).over(w) == before, F.col(value) - F.lag(value).over(w)))


def twin_candidates(keep: DataFrame, dup: DataFrame, block: list[str], time: str, least: int, corr: float, tolerance: float, scaled: bool, basis: str) -> DataFrame:
    """(dup, keep, basis, n, corr, ratio): series of `dup` that run with one of `keep`, at a power of ten times its level if `scaled`.

    Both tables hold series_id, the block, time, value and change, or are lists of these (`overlap.listed`). Level correlation, that of changes (0.9 at least, or corr
    if that is less) and the median ratio within the tolerance all have to fit, over `least` common dates.
    """
    changes = min(0.9, corr)
    runs = met(keep, dup, block, "series_id", time, least, ["value", "change"], corr, changes=changes).where("a <> b").withColumn("corr", F.round("corr", 9))
    out = runs.where((F.col("corr") >= corr) & (F.round("changes", 9) >= changes))
    power = F.when((F.col("ratio") > 0) & F.lit(scaled), F.rint(F.log10("ratio"))).otherwise(0)
    fit = out.where(F.abs(F.col("ratio") / F.pow(F.lit(10.0), power) - 1) <= tolerance)
    return fit.select(F.col("b").alias("dup"), F.col("a").alias("keep"), F.lit(basis).alias("basis"), "n", "corr", "ratio")


def judged(pairs: DataFrame, cat: DataFrame, qualifiers: list[str], stop: list[str], same_title: str) -> DataFrame:
    """pairs with `outcome`: the first rule that saves the dup of this pair, or 'removed'.

    cat: series_id, title, unit, priority, rank, protected. In turn: the titles share too few words (two; one is enough for
    a kept series of priority 0; none needed where the basis is `same_title`); a word of `qualifiers` stands in one title
    only; a rate is no scaled copy; the other edition is not better (priority, then rank, then id); another pair of the dup
    fits better (second); the dup is itself what another pair keeps; it is protected. So what is kept never goes.
    Pairs are written down with the first rules, which need nothing but the pair; only those that no such rule saves move.
    """
    about = lambda end: cat.select(F.col("series_id").alias(end), *[F.col(c).alias(f"_{c}_{end}") for c in ("unit", "priority", "rank", "protected")], tokens(F.col("title"), stop).alias(f"_t_{end}"))
    hint = F.broadcast if cat.count() <= SENT else lambda df: df
    rows = pairs.join(hint(about("dup")), "dup").join(hint(about("keep")), "keep")
    need = F.when(F.col("basis") == same_title, 0).when(F.col("_priority_keep") == 0, 1).otherwise(2)
    apart = F.concat(F.array_except("_t_dup", "_t_keep"), F.array_except("_t_keep", "_t_dup"))
    rate = F.col("_unit_keep").startswith("pct") | F.col("_unit_keep").startswith("annual_pct")
    order = lambda end: F.struct(F.col(f"_priority_{end}"), -F.coalesce(F.col(f"_rank_{end}"), F.lit(0.0)), F.col(end))
    rule = (
        F.when(F.size(F.array_intersect("_t_dup", "_t_keep")) < need, "words")
        .when(F.arrays_overlap(apart, F.array(*map(F.lit, qualifiers))), "qualifier")
        .when(rate & (F.abs(F.log10(F.abs("ratio"))) > 0.03), "rate")
        .when(~(order("keep") < order("dup")), "not better")
    )
    rows = materialize(rows.select(*pairs.columns, "_protected_dup", rule.alias("_rule")))
    saved = rows.where("_rule is not null").select(*pairs.columns, F.col("_rule").alias("outcome"))
    place = F.row_number().over(Window.partitionBy("dup").orderBy(F.desc("corr"), "keep", "basis"))
    rows = rows.where("_rule is null").withColumn("_rule", F.when(place > 1, "second"))
    kept = rows.where("_rule is null").select(F.col("keep").alias("dup"), F.lit(True).alias("_kept")).distinct()
    outcome = F.coalesce("_rule", F.when(F.col("_kept"), "kept"), F.when(F.col("_protected_dup"), "protected"), F.lit("removed"))
    return saved.unionByName(rows.join(kept, "dup", "left").select(*pairs.columns, outcome.alias("outcome")))
