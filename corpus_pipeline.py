"""A corpus pipeline of five stages, each an operator of tidemark.llm over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from tidemark.llm.common import materialize, read_table


def _set_apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns of these names renamed, and the columns that give docs back."""
    own = {c: f"_own_{c}" for c in names if c in docs.columns}
    return docs.withColumnsRenamed(own), [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go.

    Null and empty texts stay; equal texts share their fate; null ids count as others. An empty table gives no rows.
    """
    return toxicity.clean(docs, read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that came before go from the texts; a document with nothing left goes, one empty before stays.

    The first occurrence by doc_id, then place, stays. Null texts and rows with a null id stay as they are. n_chars, if
    there is such a column, follows the text. An empty table gives no rows.
    """
    apart, back = _set_apart(docs, "n_chunks", "n_removed")
    out = line_dedup.dedup_lines(apart).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_chunks")))
    if "n_chars" in docs.columns:
        # a null text keeps the number it came with
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the smallest id stays.

    Null, blank and wordless texts link with nothing and stay, and so do rows with a null id. Repeated rows of an id that
    stays all stay. An empty table gives no rows.
    """
    return jaccard_join.keep_one(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with mix_order, and in its order: files, rows and later the sequences follow the mix.

    A null source is a source of its own. Ties (rows of one id) come in any order and all stay. A column named mix_order
    gives way to the new one. An empty table gives no rows.
    """
    docs = docs.drop("mix_order")
    apart, back = _set_apart(docs, "block", "slot", "mix_release", "mix_deadline")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixing.mix(apart).repartitionByRange(parts, "mix_order").sortWithinPartitions("mix_order", "doc_id").select(*back, "mix_order")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, in the order of the mix.

    Null and empty texts are one end id; repeated rows and null ids are packed like others. An empty table gives no rows.
    """
    return packing.pack(docs, order="mix_order")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: A classifier and a tokenizer are in it: tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
