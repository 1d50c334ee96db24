"""Local projections with bootstrap intervals from sums of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .regression import ols, solved
from .sampling import draw, replicates


def horizons(df: DataFrame, key: str, time: str, y: str, most: int) -> DataFrame:
    """df with h (0 to most) and response, y h rows ahead less y of the row before; rows without both are left out."""
    w = Window.partitionBy(key).orderBy(time)
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), (F.lead(y, h).over(w) - F.lag(y).over(w)).alias("response")) for h in range(most + 1)])
    return df.withColumn("_a", ahead).select(*df.columns, F.explode("_a").alias("_e")).select(*df.columns, "_e.h", "_e.response").where("response is not null")


def block_sums(df: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """keys, pos (from 1), n (rows of the key) and s: running sums of the columns and of their products, around the key's means."""
    all_ = Window.partitionBy(*keys)
    running = all_.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*keys, time, *[(F.col(c) - F.avg(c).over(all_)).alias(f"_v{i}") for i, c in enumerate(columns)], F.count("*").over(all_).alias("n"))
    names = [f"_v{i}" for i in range(len(columns))]
    parts = [*map(F.col, names), *[F.col(names[i]) * F.col(names[j]) for i in range(len(names)) for j in range(i, len(names))]]
    return rows.select(*keys, "n", F.row_number().over(all_.orderBy(time)).cast("long").alias("pos"), F.array(*[F.sum(p).over(running) for p in parts]).alias("s"))


def block_replicates(sums: DataFrame, keys: list[str], k: int, count: int, length: int, seed: str = "") -> DataFrame:
    """keys, rep, n, m, c of moving-block samples, for `solved`: of each block drawn two rows of running sums are read, not its rows.

    As many rows are drawn as the key has; the last block is cut short.
    """
    sizes = sums.groupBy(*keys).agg(F.max("n").alias("_n")).withColumn("_l", F.least(F.lit(length).cast("long"), F.col("_n")))
    blocks = replicates(sizes, count).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / F.col("_l")).cast("int"))))
    drawn = blocks.withColumn("_from", draw(F.lit(seed), *keys, "rep", "_b") % (F.col("_n") - F.col("_l") + 1))
    drawn = drawn.withColumn("_to", F.col("_from") + F.least(F.col("_l"), F.col("_n") - F.col("_b") * F.col("_l")))
    at = lambda name, s: sums.select(*keys, F.col("pos").alias(name), F.col("s").alias(s))
    met = drawn.join(at("_to", "_hi"), [*keys, "_to"]).join(at("_from", "_lo"), [*keys, "_from"], "left")
    size = (k + 1) + (k + 1) * (k + 2) // 2
    part = lambda i: F.sum(F.get("_hi", F.lit(i)) - F.coalesce(F.get("_lo", F.lit(i)), F.lit(0.0)))
    total = met.groupBy(*keys, "rep").agg(F.first("_n").alias("n"), *[part(i).alias(f"_p{i}") for i in range(size)])
    mean = [F.col(f"_p{i}") / F.col("n") for i in range(k + 1)]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    cov = [F.col(f"_p{k + 1 + at}") / F.col("n") - mean[i] * mean[j] for at, (i, j) in enumerate(pairs)]
    return total.select(*keys, "rep", "n", F.array(*mean).alias("m"), F.array(*cov).alias("c"))


def local_projections(df: DataFrame, key: str, time: str, y: str, shock: str, controls: list[str], most: int = 12, count: int = 1000, length: int = 12, least: int = 30) -> DataFrame:
    """key, h, n, beta, low, high, p: response of y to the shock after h rows, with the 5th and 95th percentile of moving-block samples.

    Controls enter beside the shock. p is twice the smaller share of samples on either side of zero. Rows with a null are
    left out; with fewer than `least` rows a horizon gives nulls.
    """
    xs, keys = [shock, *controls], [key, "h"]
    rows = horizons(df, key, time, y, most).dropna(subset=["response", *xs])
    fit = ols(rows, keys, "response", xs).select(*keys, "n", F.get("beta", F.lit(0)).alias("beta"))
    samples = solved(block_replicates(block_sums(rows, keys, time, [*xs, "response"]), keys, len(xs), count, length), [*keys, "rep"], len(xs))
    b = F.get("beta", F.lit(0))
    side = lambda c: F.avg(F.when(b.isNotNull(), c.cast("double")))
    band = samples.groupBy(*keys).agg(F.percentile(b, F.lit(0.05)).alias("low"), F.percentile(b, F.lit(0.95)).alias("high"), F.least(F.lit(1.0), 2 * F.least(side(b <= 0), side(b >= 0))).alias("p"))
    enough = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    return fit.join(band, keys, "left").select(*keys, "n", *map(enough, ("beta", "low", "high", "p")))
