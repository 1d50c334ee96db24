"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms within a band of inverse document frequency: those that MIN_SHARE to MAX_SHARE of the
documents have, and two at least. A document's distinct terms in the lexicon are sorted by hash and hashed once for each
of SUBSETS randomised parts of the lexicon. Parts come at rates of 1/8 to 1/512 (RATES), REPLICATES of each: short
documents are told apart by large parts, long ones by small parts, which an edit seldom touches. Likeness is the share of
equal hashes among the parts in which either document has a term, at the rate where that share is highest of those at
which at least half of the parts have one; where there is no such rate, over all parts. A document without any term of
the lexicon is fingerprinted by all of its terms.

Terms are 64-bit hashes. The band alone decides on a term, at every size. Document frequencies add up to the number of
distinct terms of all documents, so the lexicon has at most 1 / MIN_SHARE times the mean number of distinct terms of a
document, whatever the number of documents; Spark broadcasts it within its own limit and else shuffles by term. Texts are
shuffled once, by id; their terms are looked up and gathered again where the text is.

All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MIN_SHARE, MAX_SHARE, REPLICATES = 0.0005, 0.1, 7
RATES = range(3, 10)
SUBSETS = len(RATES) * REPLICATES
ENOUGH = (REPLICATES + 1) // 2
#: A lexicon of up to so many terms (8 bytes each) is broadcast.
BROADCAST_TERMS = 2_000_000


def terms(text: Column) -> Column:
    """Sorted hashes of the distinct lower-case runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda t: F.xxhash64(t))))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """h: the terms in the band, as hashes; written down, and marked for broadcast where they are few enough."""
    n = docs.count()
    df = docs.select(F.explode_outer(terms(F.col("text"))).alias("h")).where("h is not null").groupBy("h").agg(F.count("*").alias("df"))
    band = materialize(df.where((F.col("df") >= max(2, min_share * n)) & (F.col("df") <= max(2, max_share * n))).select("h"))
    return F.broadcast(band) if band.count() <= BROADCAST_TERMS else band


def _part(own: str, r: int, j: int) -> Column:
    """The terms of which certain j bits are 0; a replicate's rarer parts lie in its commoner ones."""
    bits = F.lit(((1 << j) - 1) << (r * RATES[-1])).cast("long")
    return F.filter(own, lambda h: h.bitwiseAND(bits) == 0)


def _hashes() -> Column:
    """Array of SUBSETS hashes from the columns _part0, _part1, ..., by rate, null where the part has no term."""
    parts = [F.col(f"_part{r}") if j == RATES[0] else _part(f"_part{r}", r, j) for j in RATES for r in range(REPLICATES)]
    return F.transform(F.array(*parts), lambda m: F.when(F.size(m) > 0, F.hash(m)))


def fingerprints(docs: DataFrame, words: DataFrame, columns: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """docs with, for each name in columns, an array of part hashes `name` and the hash of all terms `name_all`.

    columns maps names to the columns of texts, which go. Rows dealt out by id_col stay where they are: a row spreads into
    its terms, they meet the lexicon, and gather again by id_col and the row's number within its task.
    """
    texts = list(columns.values())
    for name, text in columns.items():
        docs = docs.withColumn(f"_t_{name}", terms(F.col(text)))
        docs = docs.withColumn(f"{name}_all", F.hash(f"_t_{name}", F.when(F.size(f"_t_{name}") == 0, F.col(text)))).drop(text)
    rest = [c for c in docs.columns if not c.startswith("_t_")]
    row = F.struct(*[F.col(c) for c in rest])
    nothing = F.lit(None).cast(docs.select(row.alias("r")).schema["r"].dataType)
    of = lambda k: lambda h: F.struct(F.lit(k).alias("which"), h.alias("h"), nothing.alias("r"))
    each = [F.transform(f"_t_{name}", of(k)) for k, name in enumerate(columns)]
    itself = F.array(F.struct(F.lit(-1).alias("which"), F.lit(None).cast("long").alias("h"), row.alias("r")))
    # numbers of rows are used within the task that gives them alone
    numbered = docs.withColumn("_n", F.monotonically_increasing_id())
    spread = numbered.select(F.col(id_col).alias("_id"), "_n", F.inline(F.concat(itself, *each)))
    met = spread.join(words.withColumn("_in", F.lit(True)), "h", "left").where("_in or which < 0")
    own = [F.sort_array(F.collect_list(F.when(F.col("which") == k, F.col("h")))).alias(f"_in_{name}") for k, name in enumerate(columns)]
    out = met.groupBy("_id", "_n").agg(F.max("r").alias("_r"), *own).select("_r.*", *[f"_in_{name}" for name in columns])
    for name in columns:
        parts = {f"_part{r}": _part(f"_in_{name}", r, RATES[0]) for r in range(REPLICATES)}
        out = out.withColumns(parts).withColumn(name, _hashes()).drop(f"_in_{name}", *parts)
    return out


def as_text(parts: str, every: str) -> Column:
    """The fingerprint as text: eight hexadecimal digits a part, - for a part without terms."""
    digits = lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    text = F.array_join(F.transform(parts, lambda h: F.coalesce(digits(h), F.lit("-"))), "")
    return F.lower(F.when(F.exists(parts, lambda h: h.isNotNull()), text).otherwise(F.concat(F.lit("all-"), digits(F.col(every)))))


def likeness(a: str, a_all: str, b: str, b_all: str) -> Column:
    told = lambda x, y: F.zip_with(x, y, lambda p, q: F.when(p.isNotNull() | q.isNotNull(), F.coalesce(p == q, F.lit(False))))
    n = lambda t: F.size(F.filter(t, lambda v: v.isNotNull()))
    equal = lambda t: F.size(F.filter(t, lambda v: v))
    at = lambda x, k: F.slice(x, 1 + k * REPLICATES, REPLICATES)
    rates = [told(at(a, k), at(b, k)) for k in range(len(RATES))]
    best = F.greatest(*[F.when(n(t) >= ENOUGH, equal(t) / n(t)) for t in rates])
    every = told(a, b)
    return F.coalesce(best, F.when(n(every) > 0, equal(every) / n(every)), (F.col(a_all) == F.col(b_all)).cast("double"))


def with_next(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n (most code points of a row of that id) and _next: the next larger id, after the largest the smallest.

    Ids are sorted by ranges; the first id of each range closes the range before. Only one row a range is put in order
    as a whole. Written down first, so that the ranges are the same for both uses.
    """
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.length("text")).alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = materialize(ids.repartitionByRange(parts, id_col).withColumn("_range", F.spark_partition_id()))
    firsts = ids.groupBy("_range").agg(F.min(id_col).alias("_first"))
    all_ranges = Window.orderBy("_range")
    after = firsts.select("_range", F.coalesce(F.lead("_first").over(all_ranges), F.first("_first").over(all_ranges)).alias("_after"))
    inside = F.lead(id_col).over(Window.partitionBy("_range").orderBy(id_col))
    return ids.withColumn("_in", inside).join(F.broadcast(after), "_range").select(id_col, "n", F.coalesce("_in", "_after").alias("_next"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint every document and an edited copy, whose last quarter gives way to the start of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text counts as empty.
    Ids should be unique: each row gives a row, rows of one id are each followed by the next larger id (of several such
    rows by the smallest start), and near_next is the largest. A row with a null id has no next document. An empty
    table gives no rows. Other columns are left out.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(docs)
    links = materialize(with_next(docs))
    wanted = links.select(F.col("doc_id").alias("_id"), F.col("_next").alias("doc_id"), F.floor(F.col("n") / 4).cast("int").alias("_need"))
    # both joins deal the same rows of texts by the same key, so Spark shuffles the texts once
    keyed = docs.where(F.col("doc_id").isNotNull())
    heads = keyed.join(wanted.hint("shuffle_hash"), "doc_id").select(F.col("_id").alias("doc_id"), F.col("doc_id").alias("_next"), F.substring("text", F.lit(1), F.col("_need")).alias("_head"))
    heads = heads.groupBy("doc_id").agg(F.max("_next").alias("_next"), F.min("_head").alias("_head"))
    rootless = docs.where(F.col("doc_id").isNull()).select("*", F.lit(None).cast("long").alias("_next"), F.lit("").alias("_head"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_head", F.lit(1), cut))

    def printed(rows: DataFrame) -> DataFrame:
        both = rows.withColumn("_text_edited", edited).withColumn("n_chars", n.cast("long"))
        both = both.withColumn("edited_sha256", F.sha2("_text_edited", 256)).drop("_head")
        return fingerprints(both, words, {"own": "text", "edited": "_text_edited"})

    # rows without an id apart: the others then stay where the join by id has put them
    prints = materialize(printed(keyed.join(heads, "doc_id")).unionByName(printed(rootless)))
    nexts = prints.select(F.col("doc_id").alias("_next"), F.col("own").alias("next"), F.col("own_all").alias("next_all"))
    best = F.max(likeness("own", "own_all", "next", "next_all")).alias("near_next")
    near = prints.select("doc_id", "_next", "own", "own_all").distinct().join(nexts, "_next").groupBy("doc_id", "own_all").agg(best)
    return prints.join(near, ["doc_id", "own_all"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("own", "own_all").alias("fingerprint"),
        as_text("edited", "edited_all").alias("edited_fingerprint"),
        likeness("own", "own_all", "edited", "edited_all").alias("near_edited"),
        F.coalesce("near_next", F.lit(0.0)).alias("near_next"),
    )
