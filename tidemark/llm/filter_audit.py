"""Filter interaction audit: what five filters remove in every order, alone and together, for each source.

Whether a document fails a filter does not depend on the order, so each document is one mask of five bits, and all counts
follow from the number of documents with each mask. Four filters look at a document alone. The fifth, copies of a smaller
id's text, is found with compressed tries (radix tries):

1. The trie of a batch finds copies within it. Of equal texts the smallest id alone goes on with its text; the others are
   known to fail. So a group of copies of any size sends one row a batch.
2. Texts are dealt out by range of an adaptive prefix: the first so many bytes (LEVELS) that hold no more than a share of
   all bytes, counted over all rows. Texts with one prefix are dealt out further by the hash of the text, so no passage that
   many texts begin with ends up in one task, while equal texts do.
3. Each task inserts the full texts that it gets in a trie, whose terminals hold the smallest id; what comes with a greater
   id, or was there with one, fails. What is left in the terminals at the end passes.

Masks are then joined with labels and summed up by source.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize

FILTERS = "ABCDE"
LEVELS, LEAST_HEAVY, MOST_HEAVY, BYTES_A_TASK = (8, 32, 128, 512, 2048), 4_000_000, 2000, 16_000_000
ROW = "doc_id long, source string, mask int, n long, text binary"


class Node:
    """label: the bytes from the node above; least: smallest id of the texts that end here; own: what came with it."""

    __slots__ = ("children", "label", "least", "own")

    def __init__(self, label: bytes):
        self.label, self.children, self.least, self.own = label, {}, None, None


def _common(a: bytes, b: bytes) -> int:
    """How many bytes at their starts are equal."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class Trie:
    """A compressed trie of byte strings."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        """The node at which text ends, put in if it is new."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                return child
            if not text.startswith(child.label, at):
                shared = _common(child.label, text[at : at + len(child.label)])
                upper = node.children[text[at]] = Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                child = upper
            node, at = child, at + len(child.label)
        return node

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """Each text and the node at which it ends."""
        waiting = [(b"", self.root)]
        while waiting:
            before, node = waiting.pop()
            text = before + node.label
            if node.own is not None:
                yield text, node
            waiting += [(text, child) for child in node.children.values()]

    def add(self, text: bytes, doc_id: int, source: str, mask: int, n: int) -> list[tuple[int, str, int, int]]:
        """Put a document in; those (doc_id, source, mask, n) that are now known to be copies of a smaller id's text."""
        node = self.terminal(text)
        if node.least is not None and doc_id > node.least:
            return [(doc_id, source, mask, n)]
        out = []
        if node.least is None or doc_id < node.least:
            out = [(node.least, s, m, k) for (s, m), k in (node.own or {}).items()]
            node.least, node.own = doc_id, {}
        node.own[source, mask] = node.own.get((source, mask), 0) + n
        return out


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, source, mask, n, text: which of the filters A to D each document fails, as bits 1, 2, 4 and 8."""
    text, distinct = F.coalesce("text", F.lit("")), F.size(F.array_distinct("_words"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text.alias("text"))
    rows = rows.withColumn("_words", F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    capitals = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = [F.size("_words") < 50, distinct * 100 < F.size("_words") * 65, capitals.cast("long") * 100 > F.length("text").cast("long") * 5, F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "source", mask.alias("mask"), F.lit(1).cast("long").alias("n"), F.encode("text", "UTF-8").alias("text"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "source", "mask", "n", "text"])


COPY = 1 << FILTERS.index("E")


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are settled, with their mask and without text, and for each text of a batch the rows of its smallest id."""
    for batch in batches:
        for rows in words.slices(batch, 4, 16_000_000):
            trie, out, nobody = Trie(), [], Counter()
            for doc_id, source, mask, n, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if doc_id is None:
                    nobody[source, mask] += n
                else:
                    out += [(i, s, m | COPY, k, None) for i, s, m, k in trie.add(text, doc_id, source, mask, n)]
            out += [(None, s, m, k, None) for (s, m), k in nobody.items()]
            out += [(node.least, s, m, k, text) for text, node in trie.terminals() for (s, m), k in node.own.items()]
            yield _batch(out)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task, all settled."""
    trie = Trie()
    for batch in batches:
        out = []
        for doc_id, source, mask, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text is None:
                out.append((doc_id, source, mask, n, None))
            else:
                out += [(i, s, m | COPY, k, None) for i, s, m, k in trie.add(text, doc_id, source, mask, n)]
        yield _batch(out)
    out = []
    for _, node in trie.terminals():
        out += [(node.least, s, m, k, None) for (s, m), k in node.own.items()]
        if len(out) >= 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _prefix(level: int) -> Column:
    return F.substring("text", 1, LEVELS[level])


def _keyed(rows: DataFrame, docs: DataFrame, total: int) -> DataFrame:
    """rows with _key, the adaptive prefix of a text, and _spread, by which rows of one prefix are dealt out further."""
    text = docs.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    longer = lambda k: F.octet_length("text") > LEVELS[k - 1] if k else F.lit(True)
    steps = F.array(*[F.when(longer(k), F.struct(F.lit(k).alias("level"), F.xxhash64(_prefix(k)).alias("hash"))) for k in range(len(LEVELS) - 1)])
    sizes = text.select(F.explode(steps).alias("s"), F.octet_length("text").cast("long").alias("bytes")).where("s is not null").groupBy("s.level", "s.hash").agg(F.sum("bytes").alias("bytes"))
    # each level has at most MOST_HEAVY of these, whatever the size of the corpus
    heavy = materialize(sizes.where(F.col("bytes") > max(LEAST_HEAVY, total // MOST_HEAVY)).select("level", "hash"))
    key = _prefix(len(LEVELS) - 1)
    for k in reversed(range(len(LEVELS) - 1)):
        rows = rows.join(F.broadcast(heavy.where(F.col("level") == k).select(F.col("hash").alias(f"_h{k}"))), F.xxhash64(_prefix(k)) == F.col(f"_h{k}"), "left")
        key = F.when(F.col(f"_h{k}").isNull(), _prefix(k)).otherwise(key)
    return rows.select("doc_id", "source", "mask", "n", "text", key.alias("_key"), F.xxhash64("text", F.when(F.col("text").isNull(), F.struct("doc_id", "source", "mask"))).alias("_spread"))


def settled(docs: DataFrame) -> DataFrame:
    """doc_id, source, mask, n: how many documents of an id and source fail the filters of the mask (A to E as bits 1 to 16).

    A null text counts as empty, a null source as the empty one. A row without an id is nobody's copy and nobody is its
    copy; rows of one id are not copies of each other. Texts of any length are compared whole, in a task's memory. An
    empty table gives no rows. Other columns are left out.
    """
    docs = docs.select("doc_id", "source", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = _keyed(masks(docs).mapInArrow(_within, ROW), docs, total)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BYTES_A_TASK))
    return rows.repartitionByRange(parts, "_key", "_spread").drop("_key", "_spread").mapInArrow(_across, ROW).drop("text")


def _orders() -> list[dict]:
    """Each order of the filters and step: the bit of its filter and the bits of those before."""
    bit = {name: 1 << k for k, name in enumerate(FILTERS)}
    return [{"filter_order": "".join(o), "step": k + 1, "own": bit[o[k]], "before": sum(bit[x] for x in o[:k])} for o in permutations(FILTERS) for k in range(len(FILTERS))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts for each part (source), filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 50 words; B fewer than 65 different words in 100; C more than 5 capitals in 100 characters; D a sign
    of #$%&*|; E the text of a smaller doc_id. A document counts as good or toxic if a row of labels has 1 for its id.
    Rows count as often as they come. Nulls, lengths and other columns are treated as in `settled`.
    """
    rows = settled(docs)
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    # summed up before the join, as rows of one id may be many; rows without an id have no label and stay out of it
    rows = rows.groupBy("doc_id", "source", "mask").agg(F.sum("n").alias("n"))
    named = rows.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left")
    rows = named.unionByName(rows.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    of = lambda name: F.sum(F.coalesce(name, F.lit(0)) * F.col("n"))
    cells = rows.groupBy("source", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))
    # at most 32 masks a part
    parts = cells.groupBy(F.col("source").alias("part")).agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.from_json(F.lit(json.dumps(_orders())), "array<struct<filter_order string, step int, own int, before int>>")
    each = parts.select("part", "cells", F.explode(orders).alias("o"))

    def count(which, what="n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(which(c["mask"]), c[what]).otherwise(F.lit(0).cast("long")))

    own, before = F.col("o.own"), F.col("o.before")
    fails, first = lambda m: m.bitwiseAND(own) > 0, lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & first(m)
    # of the orders, one in as many as the document fails filters puts this one first
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(fails(c["mask"]), c["n"] * (F.lit(120) / F.greatest(F.bit_count(c["mask"]), F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long")))
    return each.select(
        "part", "o.filter_order", "o.step", count(lambda m: first(m) & ~fails(m)).alias("kept"), count(removed).alias("removed"),
        count(lambda m: fails(m) & ~first(m)).alias("redundant"), count(lambda m: m == own).alias("unique_fails"),
        count(removed, "good").alias("good_lost"), count(removed, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )


QUERY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM d
), c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), s AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, unnest([1, 2, 3, 4, 5]) AS t(step)
)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask::INT), 1)) FILTER (mask & own > 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
