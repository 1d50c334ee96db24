"""Readers and writers of the file shapes that series come in: long, exported, locale-specific and drifting tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; on one machine, where it is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return f"{folder.rstrip('/')}/tidemark-files/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sum_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of a column over all rows before, by order.

    Rows are dealt out by ranges of the order and written down, so that the ranges stay; only one row a range is summed
    up in order as a whole.
    """
    path = shared_folder(df.sparkSession)
    df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy("_range").agg(F.sum(value).alias(value)).select("_range", before(Window.orderBy("_range")).alias("_start"))
    inside = rows.withColumn("_inside", before(Window.partitionBy("_range").orderBy(order)))
    return inside.join(ranges, "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")


def read_long_csv(spark: SparkSession, path: str, schema: str, default_entity: str = "BR") -> DataFrame:
    """Long CSV files as one table: rows with a value, blank entities as the default one, and the year of the date."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    entity = F.coalesce(F.nullif(F.trim("entity_id"), F.lit("")), F.lit(default_entity))
    return df.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumns({"entity_id": entity, "year": F.substring(F.col("date").cast("string"), 1, 4).cast("int")})


def read_exports(spark: SparkSession, path: str, schema: str, mapping: DataFrame, pattern: str = r"series=([^/]+)/") -> DataFrame:
    """One CSV file or folder a series, whose name is in the path, at the ends of years; series without a mapping go."""
    df = spark.read.schema(schema).option("header", True).csv(f"{path}/*")
    named = df.withColumn("series_id", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    return named.where("value is not null").withColumn("date", F.make_date("year", F.lit(12), F.lit(31))).join(mapping, "series_id")


def read_locale(spark: SparkSession, path: str, numbers: list[str], sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Delimited files of another locale: all text, headers stripped, numbers with decimal comma and thousands dots."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])
    number = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"\.", ""), ",", ".").try_cast("double")
    return df.withColumns({c: number(c) for c in numbers})


def read_drifting(spark: SparkSession, path: str, labels: list[str], period: str = r"^\d{4}/\d{2}$", sep: str = ";") -> DataFrame:
    """file, and one text column a label: tables that start after a preamble of any length, with columns in any order.

    In each file the header is the first line that holds all labels; of the lines after it those count whose first label
    is a period. Files are taken whole: each must fit a task.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    cells = files.withColumn("cells", F.transform(F.split("text", sep), lambda x: F.trim(x)))
    holds = F.forall(F.array(*[F.lit(x) for x in labels]), lambda x: F.array_contains("cells", x))
    headers = cells.where(holds).groupBy("file").agg(F.min("line").alias("_at"), F.min_by("cells", "line").alias("_head"))
    rows = cells.join(headers, "file").where("line > _at")
    out = rows.select("file", *[F.get("cells", (F.array_position("_head", x) - 1).cast("int")).alias(x) for x in labels])
    return out.where(F.col(labels[0]).rlike(period))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """tier, metric, and the fields of each line `metric: {source: s, unit: u}` under its `tier:` line."""
    entry = lambda k: F.nullif(F.regexp_extract("text", rf"^\s+\S+:\s*\{{.*\b{k}:\s*([^,}}]+?)\s*[,}}]", 1), F.lit(""))
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\w)")).alias("block"))
    files = blocks.select(F.regexp_extract("block", r"^([^:\n]+):", 1).alias("tier"), F.explode(F.split("block", "\n")).alias("text"))
    metric = F.regexp_extract("text", r"^\s+([^:\s]+):\s*\{", 1)
    return files.where(metric != "").select("tier", metric.alias("metric"), entry("source").alias("source"), entry("unit").alias("unit"))


def write_bronze(df: DataFrame, path: str, required: list[str], sort: list[str], value: str = "value", dates: list[str] | None = None) -> int:
    """Write the rows with a finite value as Parquet, sorted inside files, in place of what is at path; the number of rows.

    `dates` are written as text yyyy-mm-dd, whether they come as dates, times or text; what is no date becomes null. A
    missing column or an empty table is refused, and then, or if writing fails, path stays as it was.
    """
    from .replacing import replace_table

    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {lacking}")
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    good = good.withColumns({c: F.date_format(F.col(c).try_cast("date"), "yyyy-MM-dd") for c in dates or []})
    return replace_table(good.sortWithinPartitions(*sort), path)


def write_typed(df: DataFrame, path: str, schema: StructType) -> int:
    """Write df with exactly the columns and types of schema, missing ones as nulls, in place of what is at path; the number of rows.

    The new table is written aside first, so a failed write leaves the old one.
    """
    from .replacing import replace_table

    column = lambda f: (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
    return replace_table(df.select(*[column(f) for f in schema.fields]), path, least=0)


def xml_items(xml: Column, schema: str, unescape: bool = False) -> Column:
    """Structs of the items of an XML text; unescape: the text holds its XML escaped once."""
    if unescape:
        for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
            xml = F.replace(xml, F.lit(mark), F.lit(char))
    return F.from_xml(xml, schema, {"rowTag": "items"})


def pre_table(html: Column) -> Column:
    """Array of (label, numbers) of the lines `label;number` in an HTML text's PRE block, without totals."""
    block = F.regexp_extract(html, r"(?is)<pre>(.*?)</pre>", 1)
    lines = F.filter(F.split(F.replace(block, F.lit("&amp;"), F.lit("&")), "\n"), lambda x: x.rlike(r'^"?[^";]+"?;\d') & ~x.rlike("(?i)total"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r'^"?([^";]+)"?;', 1).alias("label"), F.regexp_extract(x, r";(\d+)", 1).cast("long").alias("value")))


def first_of_pairs(df: DataFrame, keys: list[str], pairs: str, fields: dict[str, list[str]]) -> DataFrame:
    """keys and one column a field from an array of (name, value): the first non-empty value of the first name that has one."""
    values = lambda name: F.get(F.transform(F.filter(pairs, lambda p: (p["name"] == name) & (F.trim(F.coalesce(p["value"], F.lit(""))) != "")), lambda p: p["value"]), 0)
    return df.select(*keys, *[F.coalesce(*[values(n) for n in names]).alias(f) for f, names in fields.items()])
