"""Joins by interval, by nearest date and by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(df: DataFrame, terms: DataFrame, date: str = "date", how: str = "left") -> DataFrame:
    """Rows with the half-open interval [start, end) that holds their date. terms: a small dimension, a row an interval."""
    return df.join(F.broadcast(terms), (F.col(date) >= terms["start"]) & (F.col(date) < terms["end"]), how)


def interval_overlap(a: DataFrame, b: DataFrame, least_months: int, key: str) -> DataFrame:
    """Overlaps [start, end) of intervals (key, name, start, end) of one key that cover at least so many month borders."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.start") < F.col("y.end")) & (F.col("x.end") > F.col("y.start")))
    start, end = F.greatest("x.start", "y.start"), F.least("x.end", "y.end")
    out = both.select(F.col(f"x.{key}").alias(key), F.col("x.name").alias("a"), F.col("y.name").alias("b"), start.alias("start"), end.alias("end"))
    months = (F.year("end") - F.year("start")) * 12 + F.month("end") - F.month("start")
    return out.withColumn("months", months).where(F.col("months") >= least_months)


def asof(left: DataFrame, right: DataFrame, key: str, date: str = "date", value: str = "value", direction: str = "backward", strict: bool = False) -> DataFrame:
    """left with the right table's last value at or before each date (backward), or its first at or after it (forward).

    One union, one shuffle by key and one running window: no row meets more than its neighbour. strict leaves equal
    dates out. Of rights with equal dates the largest value counts.
    """
    back = direction == "backward"
    side = (1 if strict else 0) if back else (0 if strict else 1)
    l = left.withColumns({"_right": F.lit(None).cast("struct<d:date,v:double>"), "_side": F.lit(1 - side)})
    r = right.groupBy(key, date).agg(F.max(value).alias("_v")).select(key, date, F.struct(F.col(date).cast("date").alias("d"), F.col("_v").cast("double").alias("v")).alias("_right"), F.lit(side).alias("_side"))
    order = Window.partitionBy(key).orderBy(date, "_side")
    w = order.rowsBetween(Window.unboundedPreceding, 0) if back else order.rowsBetween(0, Window.unboundedFollowing)
    found = F.last("_right", True).over(w) if back else F.first("_right", True).over(w)
    both = l.withColumn("_mine", F.lit(True)).unionByName(r.withColumn("_mine", F.lit(False)), allowMissingColumns=True)
    out = both.withColumn("_f", found).where("_mine")
    return out.select(*left.columns, F.col("_f.d").alias("asof_date"), F.col("_f.v").alias("asof_value"))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, date: str = "date", value: str = "value") -> DataFrame:
    """The nearer of the values before and after; the later one if both are as near."""
    back = asof(left, right, key, date, value).withColumnsRenamed({"asof_date": "_bd", "asof_value": "_bv"})
    both = asof(back, right, key, date, value, "forward")
    later = F.col("_bd").isNull() | (F.col("asof_date").isNotNull() & (F.datediff("asof_date", date) <= F.datediff(date, "_bd")))
    pick = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b))
    return both.withColumns({"asof_date": pick("asof_date", "_bd"), "asof_value": pick("asof_value", "_bv")}).drop("_bd", "_bv")


def priority_merge(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of first, and those of second whose keys first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def gap_fill(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer join; blanks in a's columns come from b."""
    x, y = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns]), b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    return x.join(y, keys, "full").select(*keys, *[F.coalesce(blank(f"_a_{c}"), F.col(f"_b_{c}")).alias(c) for c in columns])


def outer_sum(a: DataFrame, b: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """a + sign * b, a missing side counting as 0."""
    both = a.select(*keys, F.col("value").alias("_a")).join(b.select(*keys, F.col("value").alias("_b")), keys, "full")
    return both.select(*keys, (F.coalesce("_a", F.lit(0.0)) + sign * F.coalesce("_b", F.lit(0.0))).alias("value"))


def prorata(df: DataFrame, owners: DataFrame, key: str, weight: str) -> DataFrame:
    """Split df's values over a key's owners by weight, evenly where a key's weights add up to 0."""
    w = Window.partitionBy(key)
    total = F.sum(weight).over(w)
    share = F.when(total != 0, F.col(weight) / total).otherwise(1 / F.count("*").over(w))
    return df.join(owners.withColumn("_share", share), key).withColumn("part", F.col("value") * F.col("_share")).drop("_share")


def last_common(df: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of the latest date at which every series of `members` (series_id) has one."""
    wanted = members.select("series_id").distinct()
    of = df.join(wanted, "series_id", "left_semi")
    # one row each
    number, last = wanted.agg(F.count("*").alias("_all")), of.groupBy("date").agg(F.count_distinct("series_id").alias("_n"))
    last = last.join(F.broadcast(number), F.col("_n") == F.col("_all")).agg(F.max("date").alias("date"))
    return of.join(F.broadcast(last), "date")


def cover_by_prefix(leaves: DataFrame, leaf: str, codes: DataFrame, lengths: tuple[int, ...], parent: int) -> DataFrame:
    """parent, leaves, covered: share of a parent's leaf codes that a listed code covers; codes of any of the lengths, weighed by f.

    One equi-join a length; a leaf takes its largest weight.
    """
    hits = None
    for n in lengths:
        part = leaves.withColumn("_c", F.substring(leaf, 1, n)).join(codes.where(F.length("code") == n).select(F.col("code").alias("_c"), "f"), "_c").select(leaf, "f")
        hits = part if hits is None else hits.unionByName(part)
    best = hits.groupBy(leaf).agg(F.max("f").alias("f"))
    return leaves.join(best, leaf, "left").groupBy(F.substring(leaf, 1, parent).alias("parent")).agg(F.count("*").alias("leaves"), (F.sum(F.coalesce("f", F.lit(0.0))) / F.count("*")).alias("covered"))
