"""Jaccard similarity join on word n-grams with adaptive multi-match prefixes: the classes of linked documents, and the links.

A document is the set of hashes of its word n-grams. Under any one order of all n-grams, two documents at or above the
threshold share at least m of the first n - ceil(t n) + m n-grams of each, for every m. Three uses are made of that:

1. Documents with equal sets form one class by a 128-bit hash of the set; one member goes on.
2. Survival, in hash order: a document whose prefix for a long m holds fewer than m n-grams known to any other document
   cannot have a partner. N-grams are dealt to buckets; each task sends an n-gram once however often it has it, so a
   passage shared by a third of the documents stays small.
3. Candidates, in order of ascending frequency among survivors: n-grams of one document alone come first and lead to
   nobody, so most documents end here. The rest lengthen their prefix step by step while the estimated cost, the lengths
   of the lists read and the candidates expected from them, falls, and a pair needs as many shared n-grams as the
   smaller of its two m. Each n-gram's first document is verified against all documents of its list; after the classes
   of those links are known, only pairs of different classes are left to verify. Where the links themselves are asked
   for, all pairs are verified; an n-gram's list is dealt out in parts of SALT_ROWS rows.

Sets are compared by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize
from .graph import components

N, PERCENT, LONG_SHARE, MOST_MATCHES, TOKENS_PER_BUCKET, LEAST_BUCKETS = 3, 90, 0.15, 4, 8_000_000, 16
SALT_ROWS = 500


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes (uint64) of the word n-grams of each text, in turn; a shorter text is one n-gram."""
    for first, last, h, begins in words.hashed(column, fold=True):
        grams = h.copy()
        for k in range(1, min(n, len(h))):
            grams[: len(h) - k] = words.mix(grams[: len(h) - k] * np.uint64(words.BASE) + h[k:])
        for i in range(last - first):
            own = h[begins[i] : begins[i + 1]]
            if len(own) >= n:
                yield np.unique(grams[begins[i] : begins[i + 1] - n + 1])
            elif len(own):
                x = np.array([len(own)], np.uint64)
                for i in range(len(own)):
                    x = words.mix(x * np.uint64(words.BASE) + own[i : i + 1])
                yield x
            else:
                yield own


def prefix_length(n: int, percent: int, matches: int) -> int:
    """How many of a set's first n-grams must hold `matches` of any partner's."""
    return n - -(-percent * n // 100) + matches


def _long_matches(n: int) -> int:
    return max(1, int(LONG_SHARE * n))


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(1), n):
                at = np.arange(1, len(s) + 1, dtype=np.uint64)
                rows.append((len(s), *(int(words.mix(s * np.uint64(2 * k + 3) + at).sum(dtype=np.uint64).astype(np.int64)) for k in (0, 1))))
            parts = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(p, pa.int64()) for p in parts)], names=["doc_id", "n", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long")


def _known(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """doc_id, known: how many n-grams of the document's long prefix some other document's long prefix has.

    An n-gram is told apart by its bucket and 32 more bits; a mix-up can only let a document survive.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            ids = np.array([-1 if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            for i, s in enumerate(shingle_sets(batch.column(1), n)):
                p = s[: prefix_length(len(s), percent, _long_matches(len(s)))] if len(s) else s
                grams.append(p)
                owner.append(np.full(len(p), i))
            g, o = np.concatenate(grams), np.concatenate(owner)
            order = np.argsort(g, kind="stable")
            g, o = g[order], o[order]
            head = np.append(True, g[1:] != g[:-1])[: len(g)]
            times = np.diff(np.append(np.flatnonzero(head), len(g)))
            shared = np.repeat(times > 1, times)
            local = np.bincount(o[shared], minlength=len(ids))
            first = head.nonzero()[0]
            bucket = (words.mix(g[first]) >> np.uint64(33)) % np.uint64(buckets)
            who = np.where(times > 1, -1, ids[o[first]] if len(first) else 0)
            multi = times > 1
            short = (g[first] & np.uint64(0xFFFFFFFF)).astype("<u4")
            by = np.argsort(bucket, kind="stable")
            used, begin = np.unique(bucket[by], return_index=True)
            known = np.flatnonzero(local)
            out = []
            for j, (b, m) in enumerate(zip(used.tolist(), np.split(by, begin[1:]), strict=False)):
                mine = known[j :: len(used)]  # what this batch knows by itself goes along with any of its rows
                out.append((b, short[m].tobytes(), who[m].astype("<i8").tobytes(), multi[m].tobytes(), ids[mine].astype("<i8").tobytes(), local[mine].astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), *[pa.binary()] * 5], strict=True)], names=["bucket", "gram", "who", "multi", "doc", "known"])

    def meet(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        gram, who, multi, doc, known = join("gram", "<u4"), join("who", "<i8"), join("multi", bool), join("doc", "<i8"), join("known", "<i8")
        _, at, times = np.unique(gram, return_inverse=True, return_counts=True)
        fit = (times[at] > 1) & ~multi
        ids, n_ids = np.unique(who[fit], return_counts=True)
        return pa.table([pa.array(np.concatenate([ids, doc])), pa.array(np.concatenate([n_ids, known]))], names=["doc_id", "known"])

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "bucket int, gram binary, who binary, multi binary, doc binary, known binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "doc_id long, known long").groupBy("doc_id").agg(F.sum("known").alias("known"))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, grams array<long>")


def _linked(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those at or above the threshold; n-grams that one document has alone can be left out of lists."""
    side = lambda x: lists.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("t_a", "t_b"))
    return both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).select("a", "b")


def _prefixes(lists: DataFrame, percent: int, whole: bool) -> DataFrame:
    """pos, token, doc_id, n, u, m for each n-gram of each document's prefix, and the prefix as own if `whole`; u: n-grams that it has alone."""
    n, u, tokens = F.col("n"), F.col("u"), F.col("by_df")
    length = lambda m: F.greatest(n - F.ceil(n * percent / 100) + m - u, F.lit(0)).cast("int")
    read = lambda m: F.aggregate(F.slice(tokens, F.lit(1), length(m)), F.lit(0).cast("double"), lambda s, x: s + x["df"])
    cost = lambda m: read(m) + 20 * read(m) / m
    best = F.array_min(F.array(*[F.struct(cost(m).alias("cost"), F.lit(m).alias("m")) for m in range(1, MOST_MATCHES + 1)]))
    chosen = lists.withColumn("m", best["m"]).where(length(F.lit(1)) > 0)
    cut = chosen.withColumn("own", F.transform(F.slice(tokens, F.lit(1), length(F.col("m"))), lambda x: x["token"]))
    return cut.select(F.posexplode("own").alias("pos", "token"), "doc_id", "n", "u", "m", *(["own"] if whole else []))


def _possible(a: Column, b: Column, percent: int) -> Column:
    """What sizes and lone n-grams leave possible for two rows of prefixes."""
    small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    overlap = F.least(a["n"] - a["u"], b["n"] - b["u"])
    return (small * 100 >= large * percent) & (overlap * (100 + percent) >= (a["n"] + b["n"]) * percent)


def _once(x: str, y: str, percent: int) -> Column:
    """Whether a pair of rows of prefixes stands at the first n-gram that both prefixes hold, holds enough and can link."""
    common = F.array_intersect(f"{x}.own", f"{y}.own")
    once = (F.get(common, F.lit(0)) == F.col(f"{x}.token")) & (F.size(common) >= F.least(f"{x}.m", f"{y}.m"))
    # nothing before that n-gram is shared, which bounds the overlap
    before = lambda side: F.col(f"{side}.u") + F.array_position(f"{side}.own", F.col(f"{x}.token")) - 1
    left = F.least(F.col(f"{x}.n") - before(x), F.col(f"{y}.n") - before(y))
    possible = _possible(F.struct(f"{x}.n", f"{x}.u"), F.struct(f"{y}.n", f"{y}.u"), percent)
    return possible & once & (left * (100 + percent) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * percent)


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of different components that share as many n-grams of their prefixes as they must.

    rows: the n-grams of prefixes that several components have, which are all that such a pair can share; a document's own
    go along with each of them, in order, so that a pair comes out once, at the first n-gram that it shares.
    """
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_own")).select("doc_id", F.transform("_own", lambda s: s["token"]).alias("own"))
    both = materialize(rows.join(own, "doc_id"))
    x, y = both.alias("x"), both.alias("y")
    common = F.array_intersect("x.own", "y.own")
    once = (F.get(common, F.lit(0)) == F.col("x.token")) & (F.size(common) >= F.least("x.m", "y.m"))
    # nothing before that n-gram is shared, which bounds the overlap
    left = F.least(*[F.col(f"{s}.n") - F.col(f"{s}.u") - F.col(f"{s}.pos") for s in "xy"])
    possible = _possible(F.struct("x.n", "x.u"), F.struct("y.n", "y.u"), percent) & (left * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component")) & possible & once
    return x.join(y, met).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def _prepared(docs: DataFrame, n: int, percent: int, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures (doc_id, n, k1, k2) of all documents; lists and prefixes of one document per set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signatures = materialize(_signatures(docs, n))
    classes = signatures.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    total = signatures.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-int(total) // TOKENS_PER_BUCKET))
    known = _known(docs, n, percent, buckets)
    needed = F.greatest(F.lit(1), F.floor(F.col("n") * LONG_SHARE))
    survivors = classes.join(known, "doc_id").where(F.col("known") >= needed).select("doc_id", "n")
    sets = materialize(_sets(docs.join(survivors.select("doc_id"), "doc_id"), n))
    grams = sets.select("doc_id", F.size("grams").alias("n"), F.explode("grams").alias("token"))
    # written down, so that the join has exchanges of its own whose large partitions Spark can split
    df = materialize(grams.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    shared = grams.join(df, "token").groupBy("doc_id", "n").agg(F.collect_list(F.struct("df", "token")).alias("by_df"))
    lists = shared.select("doc_id", "n", (F.col("n") - F.size("by_df")).alias("u"), F.array_sort("by_df").alias("by_df"))
    lists = materialize(lists.withColumn("tokens", F.transform("by_df", lambda x: x["token"])).where(F.col("u") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    return signatures, lists, materialize(_prefixes(lists, percent, whole))


def _pairs(prefixes: DataFrame, percent: int, which: Column) -> DataFrame:
    """Candidates (a, b) among rows x and y of prefixes with one n-gram, of those for which `which` holds.

    The list of a frequent n-gram is dealt out in parts of SALT_ROWS rows, each of which meets the whole list in a task.
    """
    rows = materialize(prefixes.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1"))
    met = prefixes.join(rows.select("token", F.ceil(F.col("rows") / SALT_ROWS).cast("int").alias("salts")), "token")
    x = met.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).alias("x")
    y = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt"))
    return x.join(y, same & which & _once("x", "y", percent)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def linked_pairs(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Signatures as in classified, and every link (a, b), a < b, between the smallest ids of two different sets."""
    signatures, lists, prefixes = _prepared(docs, n, percent, True)
    return signatures, _linked(_pairs(prefixes, percent, F.col("x.doc_id") < F.col("y.doc_id")), lists, percent)


def link_counts(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, set_id (smallest doc_id with the same n-grams), n_links (other documents at or above the threshold, copies included).

    Empty sets and null ids have no link and are sets of their own. The number of links can grow with the square of a
    group of near copies; equal sets count as one until the end.
    """
    signatures, pairs = linked_pairs(docs, n, percent)
    key = ["n", "k1", "k2"]
    sets = signatures.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("set_id"), F.count("*").alias("copies"))
    both = materialize(pairs)
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(sets.select(F.col("set_id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("copies").alias("far"))
    sets = sets.join(far, "set_id", "left").withColumn("links", F.col("copies") - 1 + F.coalesce("far", F.lit(0)))
    found = F.col("doc_id").isNotNull()
    return signatures.join(sets, key, "left").select("doc_id", F.when(found, F.coalesce("set_id", "doc_id")).alias("set_id"), F.when(found, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def classified(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Signatures (doc_id, n, k1, k2) of all documents, and the components (id, component) of one document per set."""
    signatures, lists, prefixes = _prepared(docs, n, percent, False)
    row = F.struct("u", "doc_id", "n", "m")
    heads = materialize(prefixes.groupBy("token").agg(F.min(row).alias("head"), F.count("*").alias("rows")).where("rows > 1"))
    met = prefixes.drop("pos").join(heads, "token").where((F.col("doc_id") != F.col("head.doc_id")) & _possible(F.struct("n", "u"), F.col("head"), percent))
    stars = met.select(F.col("doc_id").alias("a"), F.col("head.doc_id").alias("b")).distinct()
    first = materialize(components(_linked(stars, lists, percent)))

    placed = prefixes.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = materialize(placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token"))
    open_ = materialize(placed.join(several, "token"))
    more = _linked(_across(open_, percent), lists, percent)
    edges = first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
    return signatures, components(edges)


def classes(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) for each row of docs.

    Documents link when 100 * intersection >= percent * union of their n-gram sets. A null or blank text has the empty
    set and links with nothing. Ids should be unique; a row with a null id gets a null component. An empty table gives
    no rows. Other columns are left out.
    """
    signatures, found = classified(docs, n, percent)
    own = signatures.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("id"))
    own = own.join(found, "id", "left").select("n", "k1", "k2", F.coalesce("component", "id").alias("class"))
    component = F.when(F.col("n") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id"))
    return signatures.join(own, ["n", "k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that have the smallest id of their class; rows with a null id all stay."""
    kept = classes(docs, n, percent).where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


QUERY_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' '))) END AS grams FROM d
), one AS (
  SELECT grams_md5, min(doc_id) AS id, any_value(grams) AS grams, any_value(len(grams)) AS n
  FROM (SELECT *, md5(array_to_string(list_sort(grams), chr(10))) AS grams_md5 FROM g WHERE len(grams) > 0) GROUP BY 1
), e AS (
  SELECT id, n, unnest(grams) AS gram FROM one
), pair AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.id < b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edge AS (
  SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair
), reach AS (
  SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), root AS (
  SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a
), class AS (
  SELECT doc_id, len(grams) AS n, CASE WHEN len(grams) > 0 THEN md5(array_to_string(list_sort(grams), chr(10))) END AS grams_md5 FROM g
)
SELECT doc_id, class.n::BIGINT AS n_shingles, coalesce(component, one.id, doc_id) AS component_id
FROM class LEFT JOIN one USING (grams_md5) LEFT JOIN root ON root.id = one.id
"""
