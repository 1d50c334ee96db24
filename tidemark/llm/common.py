"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine, where it is unset, a folder of our own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dir[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portable_hash(col: Column) -> Column:
    """A 32-bit hash (as long) of a string that other SQL engines can compute too: the first 8 hex digits of its md5."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long")


def ranked(df: DataFrame, keys: list[str], order: list[str], rows_per_bucket: int = 50_000, name: str = "rank", in_order: bool = False) -> DataFrame:
    """Add the 0-based rank of each row among the rows with equal keys.

    A group may hold a third of all rows, so it is split into hash buckets of about rows_per_bucket rows: buckets are
    counted, their starts summed up per key (as many rows as there are buckets), and rows numbered within a bucket.
    Rows of a group come by bucket, then by `order`; with in_order the buckets are ranges, so rows come by `order` alone.
    """
    buckets = max(16, -(-df.count() // rows_per_bucket))
    if in_order:
        # written down, so that every use sees the same borders
        df = materialize(df.repartitionByRange(buckets, *order).withColumn("_bucket", F.spark_partition_id()))
    else:
        df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    starts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(starts, [*keys, "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_inside") - 1)
        .drop("_bucket", "_start", "_inside")
    )
