"""Replacing and revising written tables without loss: new data are written aside, and the old stay until those are whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import materialize


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def settle(spark: SparkSession, path: str) -> None:
    """Finish or undo a replacement that was broken off: the table is at path afterwards, whole, or was never written."""
    files, place = _files(spark, path)
    old, now = place(f"{path}.old"), place(path)
    if files.exists(old):
        if files.exists(now):
            files.delete(old, True)
        elif not files.rename(old, now):
            raise OSError(f"cannot bring back {path}")


def exists(spark: SparkSession, path: str) -> bool:
    settle(spark, path)
    files, place = _files(spark, path)
    return files.exists(place(path))


def replace_table(df: DataFrame, path: str, partitions: list[str] | None = None, least: int = 1) -> int:
    """Write df as Parquet to path in place of what is there; the number of rows written.

    df may read path itself. Rows are written to a folder beside it first and counted there; fewer than `least` are refused.
    Only a whole new folder takes the old one's place, by renaming; if that is broken off, `settle` (called first by each
    function here) brings a whole table back. Whatever fails, the old table stays.
    """
    spark = df.sparkSession
    settle(spark, path)
    files, place = _files(spark, path)
    aside = f"{path}.new-{uuid.uuid4().hex}"
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(aside)
        n = spark.read.parquet(aside).count() if df.columns else 0
        if n < least:
            raise ValueError(f"{n} rows, {least} wanted at least" if n else "nothing to write")
        if files.exists(place(path)) and not files.rename(place(path), place(f"{path}.old")):
            raise OSError(f"cannot set {path} aside")
        if not files.rename(place(aside), place(path)):
            raise OSError(f"cannot put {path} in place")
    finally:
        files.delete(place(aside), True)
        settle(spark, path)
    return n


def upsert(df: DataFrame, path: str, keys: list[str], partitions: list[str], newest: list[Column] | None = None) -> int:
    """Merge df into the table at path by key and rewrite the partitions that df touches alone; the number of rows of those.

    Of rows with equal keys those of df win; within df, the first by `newest` (by default any, all columns deciding). A key
    belongs to one partition. The merged rows are written aside before the partitions are overwritten, all at once when the
    job commits, so a failed merge leaves the table as it was. A null key is a key like others. Without a table there, df
    is written as one.
    """
    spark = df.sparkSession
    order = newest or [F.col(c).desc_nulls_last() for c in df.columns if c not in keys]
    first = lambda d, *by: d.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_k = 1").drop("_k")
    new = first(df, *(order or [F.lit(1)]))
    if not exists(spark, path):
        return replace_table(new, path, partitions)
    new = materialize(new)
    touched = new.select(*partitions).distinct()
    old = spark.read.parquet(path).select(*df.columns)
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    old = old.join(touched, same(old, touched, partitions), "left_semi")
    old = old.join(new.select(*keys), same(old, new, keys), "left_anti")
    merged = materialize(new.unionByName(old))
    merged.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    return merged.count()


def refresh(spark: SparkSession, df: DataFrame, path: str, period: str, last: int) -> DataFrame:
    """The part of df that a table at path still lacks: its last periods, which are always fetched again, and those that it has not.

    period: a column of ordered periods (such as 202401). Without a table all of df.
    """
    if not exists(spark, path):
        return df
    place = F.row_number().over(Window.orderBy(F.desc(period)))
    # a row a period
    ends = df.select(period).distinct().withColumn("_p", place).where(F.col("_p") <= last).select(period)
    there = spark.read.parquet(path).select(period).distinct()
    wanted = df.select(period).distinct().join(there, period, "left_anti").unionByName(ends).distinct()
    return df.join(F.broadcast(wanted), period, "left_semi")
