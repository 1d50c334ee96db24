"""Resampling statistics by key: bootstraps of blocks and clusters, permutations, placebos.

A draw is a hash of its key, replicate and number, so every run and every SQL engine draws alike, and lost tasks repeat
their draws. Replicates are rows; rows are drawn by joining on their number within the key, and each statistic is a
grouped aggregate. Work is the number of replicates times the rows of the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import materialize


def draw(*parts: str | Column) -> Column:
    """A whole number below 2**32 for the parts, as text: the first 8 hex digits of their md5."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """df with the number, from 0, of each row within its key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def numbered_widely(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """As `numbered`, for keys of any number of rows: ranges of key and order are written down and numbered side by side.

    Only one row a key and range is summed up in order. Rows of one key and order are numbered as they come.
    """
    ranged = materialize(materialize(df).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_c")).select(*keys, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(starts, [*keys, "_range"]).withColumn(name, F.col("_first") + F.col("_inside")).drop("_range", "_first", "_inside")


def replicates(sizes: DataFrame, count: int) -> DataFrame:
    return sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def block_bootstrap(df: DataFrame, keys: list[str], order: list[str], count: int, length: int, circular: bool = False, seed: str = "", wide: bool = False) -> DataFrame:
    """Rows of df, drawn in blocks of consecutive rows, with rep and at (place in the drawn sample); as many as the key has.

    Blocks of a circular bootstrap wrap around the end; others start where they fit. length 1 draws rows one by one. `wide`
    is for keys whose rows are too many for one task: rows are numbered by ranges and written down, blocks are drawn where
    the rows lie, and drawn rows are met by a sort, as neither side may be small enough to be sent everywhere.
    """
    rows = materialize(numbered_widely(df, keys, order)) if wide else numbered(df, keys, order)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    length_ = F.least(F.lit(length).cast("long"), F.col("_n"))
    if wide:
        first = rows.select(*keys, "pos").join(F.broadcast(sizes), keys).where(F.col("pos") % length_ == 0)
        blocks = replicates(first.withColumn("_b", F.floor(F.col("pos") / length_).cast("int")).drop("pos"), count)
    else:
        blocks = replicates(sizes, count).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / length_).cast("int"))))
    starts = F.col("_n") if circular else F.col("_n") - length_ + 1
    begun = blocks.withColumn("_start", draw(F.lit(seed), *keys, "rep", "_b") % starts)
    each = begun.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), length_ - 1))).withColumn("at", F.col("_b") * length_ + F.col("_k")).where("at < _n")
    placed = each.select(*keys, "rep", "at", ((F.col("_start") + F.col("_k")) % F.col("_n")).alias("pos"))
    return (placed.hint("merge") if wide else placed).join(rows, [*keys, "pos"]).drop("pos")


def interval(reps: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Percentiles of a statistic over replicates."""
    q = lambda p: F.percentile(value, F.lit(p))
    return reps.groupBy(*keys).agg(F.count(value).alias("reps"), q(low).alias("low"), q(0.5).alias("mid"), q(high).alias("high"))


def cluster_bootstrap(df: DataFrame, keys: list[str], cluster: str, order: list[str], count: int) -> DataFrame:
    """Rows of df by rep and draw: clusters of a key are drawn, then as many rows of each as it has (two stages)."""
    clusters = numbered(df.groupBy(*keys, cluster).agg(F.count("*").alias("_rows")), keys, [cluster], "_c")
    sizes = clusters.groupBy(*keys).agg(F.count("*").alias("_n"))
    first = replicates(sizes, count).withColumn("draw", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    first = first.withColumn("_c", draw(F.lit("c"), *keys, "rep", "draw") % F.col("_n")).join(clusters, [*keys, "_c"])
    second = first.withColumn("_k", F.explode(F.sequence(F.lit(0), (F.col("_rows") - 1).cast("int"))))
    second = second.select(*keys, cluster, "rep", "draw", (draw(F.lit("r"), *keys, "rep", "draw", "_k") % F.col("_rows")).alias("_pos"))
    return second.join(numbered(df, [*keys, cluster], order, "_pos"), [*keys, cluster, "_pos"]).drop("_pos")


def shuffled(df: DataFrame, keys: list[str], column: str, order: list[str], count: int) -> DataFrame:
    """Rows of df by rep with the values of one column dealt out anew within the key."""
    rows = numbered(df, keys, order)
    values = replicates(rows.select(*keys, "pos", F.col(column).alias("_v")), count)
    by_hash = Window.partitionBy(*keys, "rep").orderBy(draw(*keys, "rep", "pos"), "pos")
    dealt = values.withColumn("_to", (F.row_number().over(by_hash) - 1).cast("long")).select(*keys, "rep", F.col("_to").alias("pos"), F.col("_v").alias(column))
    return rows.drop(column).join(dealt, [*keys, "pos"]).drop("pos")


def permutation_p(observed: DataFrame, reps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(1 + replicates at least as far from 0 as observed) / (1 + replicates)."""
    out = reps.select(*keys, F.col(value).alias("_r")).join(observed.select(*keys, F.col(value).alias("observed")), keys)
    far = F.count_if(F.abs("_r") >= F.abs("observed") - 1e-12)
    return out.groupBy(*keys, "observed").agg(((1 + far) / (1 + F.count("_r"))).alias("p"))


def permutation_exact(units: DataFrame, keys: list[str], unit: str, flag: str, value: str) -> DataFrame:
    """Difference of means of flagged and other units, and its p-value over all relabellings with as many flagged.

    Differences that are within 1e-9 of the largest value (by size) count as equal.
    Relabellings are bit masks over a key's units, which must be few (20 at most, a million masks; more raise an error).
    """
    rows = numbered(units, keys, [unit], "_i")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(flag).alias("_k")).where("_k > 0 and _k < _n")
    top = F.when(F.col("_n") > 20, F.raise_error(F.lit("more than 20 units"))).otherwise(F.expr("shiftleft(1L, cast(_n as int)) - 1"))
    masks = sizes.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), top))).where(F.bit_count("mask") == F.col("_k"))
    bit = F.expr("shiftright(mask, cast(_i as int)) & 1L") == 1
    mean = lambda c: F.avg(F.when(c, F.col(value)))
    each = masks.join(rows, keys).groupBy(*keys, "mask").agg((mean(bit) - mean(~bit)).alias("_d"))
    own = rows.groupBy(*keys).agg((mean(F.col(flag)) - mean(~F.col(flag))).alias("diff"), F.max(F.abs(value)).alias("_top"))
    # equal differences may come out apart by rounding, which grows with the values
    far = F.count_if(F.abs("_d") >= F.abs("diff") - 1e-9 * F.col("_top"))
    return each.join(own, keys).groupBy(*keys, "diff").agg(F.count("*").alias("relabellings"), (far / F.count("*")).alias("p"), (F.lit(1.0) / F.count("*")).alias("least_p"))


def holm(df: DataFrame, p: str, group: list[str]) -> DataFrame:
    """p_holm: running maximum of (m - i + 1) p over ascending p, 1 at most; null p stay null and do not count."""
    w = Window.partitionBy(*group, F.col(p).isNull()).orderBy(p)
    m = F.count(p).over(Window.partitionBy(*group))
    raw = df.withColumn("_raw", (m - F.row_number().over(w.orderBy(p)) + 1) * F.col(p))
    most = F.max("_raw").over(w.rangeBetween(Window.unboundedPreceding, 0))
    return raw.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), most))).drop("_raw")


def placebo(df: DataFrame, events: DataFrame, key: str, days: int, most: int) -> DataFrame:
    """For each event its effect, and where it lies among the effects at `most` other dates of the series.

    df: key, date, effect; events: key, date. Placebo dates are further than `days` from every event of the series, taken
    in the order of their hashes.
    """
    near = events.select(key, F.col("date").alias("_e"))
    free = df.join(near, key).groupBy(key, "date").agg(F.first("effect").alias("_x"), F.min(F.abs(F.datediff("date", "_e"))).alias("_far")).where((F.col("_far") > days) & F.col("_x").isNotNull())
    order = Window.partitionBy(key).orderBy(draw(key, "date"), "date")
    drawn = free.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select(key, "_x")
    own = events.join(df, [key, "date"]).where("effect is not null")
    out = own.join(drawn, key).groupBy(key, "date", "effect").agg(F.count("_x").alias("n"), F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"), F.avg((F.abs("_x") >= F.abs("effect")).cast("double")).alias("p"), F.avg((F.col("_x") <= F.col("effect")).cast("double")).alias("percentile"))
    return out.withColumn("z", F.try_divide(F.col("effect") - F.col("_m"), "_s")).drop("_m", "_s")


def placebo_means(free: DataFrame, events: DataFrame, key: str, group: str, count: int) -> DataFrame:
    """group, rep, mean: in each replicate every event of a group takes the effect of one drawn row of its key in `free`.

    free: key, pos, effect, the rows that may stand in; events: key, group. Events of keys without such rows are left out.
    As many rows as replicates times events are drawn, whatever the length of the series.
    """
    rows = numbered(free, [key], ["pos"], "_i").select(key, "_i", F.col("effect").alias("_x"))
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    drawn = replicates(events.select(key, group).join(sizes, key), count).withColumn("_i", draw(group, key, "rep") % F.col("_n"))
    return drawn.join(rows, [key, "_i"]).groupBy(group, "rep").agg(F.avg("_x").alias("mean"))


def binomial_tail(k: Column, n: Column) -> Column:
    """Chance of k or more heads in n fair throws, from logarithms of binomial coefficients."""
    log_choose = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda s, j: s + F.when(i > 0, F.log((n - j + 1) / j)).otherwise(0.0))
    each = F.transform(F.sequence(k.cast("int"), n.cast("int")), lambda i: F.exp(log_choose(i) - n * F.log(F.lit(2.0))))
    return F.when(k <= n, F.least(F.lit(1.0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x)))
