"""Line dedup by content-defined chunks of lines.

A text is a list of lines. A rolling hash over the hashes of the last WINDOW lines ends a chunk where it is divisible by
DIVISOR, so that chunk borders depend on the lines around them and not on their number: a passage keeps its chunks when
lines are put before it. No border falls within MIN_LINES lines of the one before or of the end, so every chunk of a text
of several lines can be compared. Chunks of at least MIN_LINES lines that come more than once in the corpus are compared
byte by byte; every occurrence but the first (smallest doc_id, then place) is removed.

All of it is DataFrame and SQL functions. Texts are shuffled once, by document; the search for repeats moves hashes and
places alone, and only repeated chunks are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, portable_hash

WINDOW, DIVISOR, MIN_LINES, TASKS_AT_ONCE = 3, 5, 2, 16


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row: the optimiser does not copy them into the lambdas that use them."""
    return df.withColumn("_x", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).select("*", "_x.*").drop("_x")


def _with_chunks(docs: DataFrame, apart: int) -> DataFrame:
    """docs with _chunk: array of structs (n, s), the number of lines and the text of each chunk in order.

    Borders are at least `apart` lines from each other and from both ends of the text; apart is 1 or 2.
    """
    out = _once(docs, _lines=F.split("text", "\n"))
    out = _once(out, _hash=F.transform("_lines", portable_hash))

    def rolling(i: Column) -> Column:
        before = lambda k: F.when(i >= k, F.get("_hash", i - k)).otherwise(F.lit(0))
        return sum((before(k) * (31**k) for k in range(1, WINDOW)), F.get("_hash", i))

    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    fit = lambda i: (i >= apart - 1) & (i < F.size("_lines") - apart)
    out = _once(out, _ends=F.filter(every, lambda i: fit(i) & (rolling(i) % DIVISOR == 0)))
    # of ends on neighbouring lines, every apart-th from the first is a border
    first = F.filter("_ends", lambda i, k: i - F.coalesce(F.get("_ends", k - 1), F.lit(-2)) > 1)
    last = F.filter("_ends", lambda i, k: F.coalesce(F.get("_ends", k + 1), i + 2) - i > 1)
    ends = F.flatten(F.zip_with(first, last, lambda a, b: F.sequence(a, b, F.lit(apart))))
    out = _once(out, _cuts=F.concat(F.transform(ends, lambda i: i + 1), F.array(F.size("_lines")))).drop("_ends")
    start = lambda k: F.when(k > 0, F.get("_cuts", k - 1)).otherwise(F.lit(0))
    chunk = lambda end, k: F.struct((end - start(k)).alias("n"), F.array_join(F.slice("_lines", start(k) + 1, end - start(k)), "\n").alias("s"))
    return _once(out, _chunk=F.transform("_cuts", chunk)).drop("_lines", "_hash", "_cuts")


def repeated_chunks(docs: DataFrame, row: str = "doc_id", apart: int = MIN_LINES) -> DataFrame:
    """doc_id, _k: the chunks to remove. Rows with equal doc_id count as one document with the chunks of each."""
    texts = docs.where(F.col("text").contains("\n")).select(row, "text")
    keyed = _with_chunks(texts, apart).select(row, F.posexplode(F.transform("_chunk", lambda c: F.struct(c["n"].alias("n"), F.xxhash64(c["s"]).alias("h")))).alias("_k", "c"))
    keyed = keyed.where(F.col("c.n") >= MIN_LINES).select(row, "_k", F.col("c.h").alias("_h"))
    groups = keyed.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h")
    candidates = materialize(keyed.join(materialize(groups), "_h"))
    wanted = candidates.groupBy(row).agg(F.collect_list(F.struct("_k", "_h")).alias("_w"))
    found = _with_chunks(texts.join(wanted.hint("merge"), row), apart).select(row, "_chunk", F.explode("_w").alias("w"))
    found = found.select(row, "w._k", "w._h", F.get("_chunk", F.col("w._k"))["s"].alias("s"))
    found = found.select(row, "_k", "_h", F.sha2("s", 256).alias("_sha"), "s")
    # bytes are compared first among the rows of a few tasks, then among what those leave, so that a chunk of very many
    # documents does not meet in one task
    spread = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(TASKS_AT_ONCE)))
    least = spread.groupBy("_h", "_sha", "_part").agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b"), F.min(F.struct(row, "_k")).alias("_first"))
    same = least.groupBy("_h", "_sha").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("_first").alias("_first"))
    same = materialize(same.select("_h", "_sha", "_first", ((F.col("a") == F.col("b")) & (F.col("n") > 1)).alias("_same")))
    hashes = materialize(same.groupBy("_h").agg(F.count("*").alias("texts"), F.bool_or("_same").alias("_same"), F.min("_first").alias("_first")))
    later = (F.col(row) != F.col("_first")[row]) | (F.col("_k") != F.col("_first._k"))
    out = candidates.join(hashes.where("texts = 1 and _same").select("_h", "_first"), "_h").where(later).select(row, "_k")
    several = hashes.where("texts > 1").select("_h")
    if not several.isEmpty():
        # texts that share their 64-bit hash alone are told apart by the longer one
        apart_ = found.join(several, "_h", "left_semi").join(same.where("_same").select("_h", "_sha", "_first"), ["_h", "_sha"])
        out = out.unionByName(apart_.where(later).select(row, "_k"))
    return out


def dedup_lines(docs: DataFrame, apart: int = MIN_LINES) -> DataFrame:
    """docs with text rid of repeated chunks, plus n_chunks and n_removed. Other columns stay as they are.

    Null text stays null and empty text empty; both have no chunk to remove, like a text of one line. Rows with equal
    doc_id are treated alike: a chunk number removed in one is removed in the others only if it is theirs too, so ids
    should be unique. A null doc_id's row is kept as it is. Columns named n_chunks or n_removed are replaced.
    """
    docs = docs.drop("n_chunks", "n_removed")
    remove = repeated_chunks(docs.where(F.col("doc_id").isNotNull()), apart=apart).groupBy("doc_id").agg(F.collect_set("_k").alias("_remove"))
    joined = _with_chunks(docs.join(remove.hint("merge"), "doc_id", "left"), apart)
    kept = F.filter("_chunk", lambda c, k: ~F.array_contains(F.col("_remove"), k))
    text = F.when(F.col("_remove").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda c: c["s"]), "\n"))
    n_removed = F.coalesce(F.size("_remove"), F.lit(0)).cast("long")
    n_chunks = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_chunk")).cast("long")
    new = {"text": text, "n_chunks": n_chunks, "n_removed": F.when(F.col("_remove").isNull(), F.lit(0)).otherwise(n_removed).cast("long")}
    return _once(joined.withColumnRenamed("text", "_text"), **new).select(*docs.columns, "n_chunks", "n_removed")



QUERY_SQL = r"""
WITH ln AS (
  SELECT doc_id, u.i AS i, u.line AS line, len(a) AS n, ('0x' || substr(md5(u.line), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL) t,
       LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i) u
), roll AS (
  SELECT *, h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0) AS r
  FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ends AS (  -- two lines at least on either side
  SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM roll WHERE r % 5 = 0 AND i >= 1 AND i < n - 2
), border AS (  -- every second of ends on neighbouring lines
  SELECT doc_id, i FROM (SELECT doc_id, i, i - min(i) OVER (PARTITION BY doc_id, run) AS after FROM ends) WHERE after % 2 = 0
), num AS (
  SELECT ln.*, coalesce(count(border.i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM ln LEFT JOIN border USING (doc_id, i)
), chunks AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS s, count(*) AS n FROM num GROUP BY doc_id, k
), marked AS (
  SELECT *, CASE WHEN n >= 2 THEN row_number() OVER (PARTITION BY s, n >= 2 ORDER BY doc_id, k) ELSE 1 END AS o FROM chunks
), done AS (
  SELECT doc_id, string_agg(s, chr(10) ORDER BY k) FILTER (WHERE o = 1) AS text, count(*) AS n_chunks,
         count(*) FILTER (WHERE o > 1) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(done.text, CASE WHEN d.text IS NULL THEN NULL ELSE '' END)) AS kept_sha256
FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id
"""
