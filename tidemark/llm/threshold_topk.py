"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are quantised to integers, floor(scale * x), and dealt into blocks of bounded size by their length, longest first.
A block is one row: its vectors in the smallest integers that hold them, and for each dimension the list of its rows
sorted by that component, sorted once and written down. The queries of a block of queries read the lists of a block of
candidates together, from both ends, deeper and deeper; rows met are scored in full by one matrix product. The
components at the current depth bound the score of everything not yet met; a query whose kth score is above that bound
stops, and the block ends when all have stopped.

Every query first meets the block with the longest vectors. The kth score found there goes along to all other blocks: a
query that no vector within the block's smallest and largest components can bring above it does not read the block at
all. The best k of each block then meet in one top-k per query.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ranked

SCALE, K, BLOCK_NUMBERS, LEAST_BLOCK, TASKS, FIRST_DEPTH = 256, 5, 1 << 20, 1024, 24, 64
QUERIES_AT_ONCE = 256
BLOCK_SCHEMA = "block int, n int, dims int, width int, ids binary, vectors binary, lists binary"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Array of long, or null for a vector that is null, or holds null, NaN or an infinity."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    large = F.exists(x, lambda v: F.abs(v * scale) >= 2.0**62)
    whole = F.when(large, F.raise_error(F.lit("a component times the scale does not fit 63 bits"))).otherwise(F.transform(x, lambda v: F.floor(v * scale).cast("long")))
    return F.when(vector.isNotNull() & fit, whole)


def packed(table: pa.Table, block: int, with_lists: bool) -> pa.Table:
    """The rows (id, v) of a block as one row; shorter vectors are filled up with zeros. Rows come by id."""
    column = table.column("v").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    n, dims = len(sizes), int(sizes.max(initial=0))
    x = np.zeros((n, dims), np.int64)
    x[np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    width = next(w for w in (1, 2, 4, 8) if w == 8 or np.abs(x).max(initial=0) < 1 << (8 * w - 1))
    lists = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16 if n <= 1 << 16 else np.uint32) if with_lists else np.empty(0, np.uint16)
    values = [block, n, dims, width, ids.tobytes(), x.astype(f"<i{width}").tobytes(), lists.tobytes()]
    kinds = [pa.int32()] * 4 + [pa.binary()] * 3
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["block", "n", "dims", "width", "ids", "vectors", "lists"])


def _opened(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors (filled up to dims) and lists of a packed row; a dimension that no row has counts as a list in any order."""
    n, own, width = (table.column(c)[0].as_py() for c in ("n", "dims", "width"))
    x = np.zeros((n, dims), np.int64)
    x[:, :own] = np.frombuffer(table.column("vectors")[0].as_py(), f"<i{width}").reshape(n, own)
    lists = np.frombuffer(table.column("lists")[0].as_py(), np.uint16 if n <= 1 << 16 else np.uint32)
    lists = np.vstack([lists.reshape(own, n), np.tile(np.arange(n, dtype=lists.dtype), (dims - own, 1))]) if len(lists) else lists
    return np.frombuffer(table.column("ids")[0].as_py(), np.int64), x, lists


def least_of(kind: np.dtype) -> float | int:
    """Below every score."""
    return -(2.0**63) if kind == np.float64 else np.iinfo(np.int64).min + 1


def threshold_search(ids: np.ndarray, x: np.ndarray, lists: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and score of each query's best k rows of the block (score, then smaller id), of those at `floor` or above.

    lists: per dimension the rows of the block by ascending component; ids ascend.
    """
    n, m = len(ids), len(own)
    limit = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if limit >= 2.0**63:
        raise ValueError("scores do not fit 64 bits")
    if limit < 2**53:
        x, q = x.astype(np.float64), q.astype(np.float64)  # exact, and faster
    best = np.tile(np.asarray(floor, x.dtype)[:, None], (1, k)) if m else np.empty((0, k), x.dtype)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seen, going = np.zeros(n, bool), np.arange(m)
    depth, last = 0, 0
    while n:
        # what is not met yet lies between the components at this depth
        low = x[lists[:, last], np.arange(x.shape[1])] if x.shape[1] else np.empty(0)
        high = x[lists[:, n - 1 - last], np.arange(x.shape[1])] if x.shape[1] else np.empty(0)
        bound = np.maximum(q[going] * low, q[going] * high).sum(axis=1)
        going = going[bound >= best[going, -1]]
        if not len(going):
            break
        depth, last = last, min(n, max(FIRST_DEPTH, last * 2))
        # from the middle on, both ends have met everything
        if 2 * last >= n:
            last = n
        met = np.zeros(n, bool)
        met[lists[:, depth:last].ravel()] = True
        met[lists[:, n - last : n - depth].ravel()] = True
        if not x.shape[1]:
            met[:] = True
        new = np.flatnonzero(met & ~seen)
        seen[new] = True
        if len(new):
            scores = q[going] @ x[new].T
            scores[ids[new][None, :] == own[going][:, None]] = least_of(x.dtype)
            least = np.maximum(best[going, -1], least_of(x.dtype) + 1)
            if len(new) > k:
                least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
            i, j = np.nonzero(scores >= least[:, None])
            if len(i):
                got = scores[i, j]
                # of equal scores the smaller id; at most k of a query go on
                order = np.lexsort((new[j], -got, i))
                i, j, got = i[order], j[order], got[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                keep = place < k
                i, j, got, place = i[keep], j[keep], got[keep], place[keep]
                kept.append((going[i], ids[new[j]], got))
                fresh = np.full((len(going), k), least_of(x.dtype), x.dtype)
                fresh[i, place] = got
                best[going] = -np.sort(-np.hstack([best[going], fresh]), axis=1)[:, :k]
        if seen.all():
            break
    if not kept:
        none = np.empty(0, np.int64)
        return none, none, none
    who, found, score = (np.concatenate(c) for c in zip(*kept))
    order = np.lexsort((found, -score, who))
    who, found, score = who[order], found[order], score[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], found[keep], score[keep].astype(np.int64)


def _blocks(rows: DataFrame, with_lists: bool) -> tuple[DataFrame, int]:
    """Packed blocks 0, 1, ... of rows (id, v), by the length of vectors, longest first, and their number."""
    count, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    per = min(max(1, BLOCK_NUMBERS // max(1, dims or 0)), max(LEAST_BLOCK, -(-count // TASKS)))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    placed = ranked(rows.withColumns({"_all": F.lit(0), "_far": -length}), ["_all"], ["_far", "id"], name="_at", in_order=True)

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return packed(table, key[0].as_py(), with_lists)

    own = placed.select("id", "v", F.floor(F.col("_at") / per).cast("int").alias("block"))
    return materialize(own.groupBy("block").applyInArrow(pack, BLOCK_SCHEMA)), -(-count // per)


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k best rows of vectors, other than rows of its own id.

    Ties go to the smaller id. Vectors that are null or hold a null or non-finite component take no part, nor do null
    ids; shorter vectors count as filled up with zeros, and an empty one scores 0. Repeated ids are candidates of
    their own; ids of queries should be unique, as rows of one query id share one list. Components and scores that do not
    fit 63 bits raise an error. Fewer than k candidates give fewer rows, an empty table none. Other columns are left out.
    """
    rows = lambda df: df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where("v is not null")
    (blocks, n_blocks), (askers, n_askers) = _blocks(rows(vectors), True), _blocks(rows(queries), False)

    def task(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """asker, floors (the kth scores of its queries so far), found: the best rows of the block mine for the queries theirs."""
        out: list[list] = [[], [], []]
        if theirs.num_rows:
            asker, m, dims = (theirs.column(c)[0].as_py() for c in ("block", "n", "dims"))
            floor = np.full(m, -(1 << 62))
            if "floors" in theirs.column_names:
                floor = np.frombuffer(theirs.column("floors")[0].as_py(), np.int64).copy()
            found = []
            if mine.num_rows:
                dims = max(dims, mine.column("dims")[0].as_py())
                ids, x, lists = _opened(mine, dims)
                own, q, _ = _opened(theirs, dims)
                for at in range(0, m, QUERIES_AT_ONCE):
                    part = slice(at, at + QUERIES_AT_ONCE)
                    who, vec, score = threshold_search(ids, x, lists, own[part], q[part], k, floor[part])
                    found += [{"query_id": a, "vec_id": b, "score": c} for a, b, c in zip(own[part][who].tolist(), vec.tolist(), score.tolist(), strict=True)]
                    full = np.flatnonzero(np.bincount(who, minlength=0) == k) if len(who) else np.empty(0, np.int64)
                    floor[at + full] = np.maximum(floor[at + full], score[np.searchsorted(who, full) + k - 1])
            out = [[asker], [floor.tobytes()], [found]]
        kinds = [pa.int32(), pa.binary(), pa.list_(pa.struct([(c, pa.int64()) for c in ("query_id", "vec_id", "score")]))]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["asker", "floors", "found"])

    schema = "asker int, floors binary, found array<struct<query_id: bigint, vec_id: bigint, score: bigint>>"
    number = lambda n, first=0: F.explode(F.sequence(F.lit(first), F.lit(max(first, n - 1))))
    first = blocks.where("block = 0").withColumn("_a", number(n_askers)).groupBy("_a").cogroup(askers.withColumn("_a", F.col("block")).groupBy("_a")).applyInArrow(task, schema)
    first = materialize(first)
    found = first
    if n_blocks > 1:
        left = blocks.where("block > 0").withColumns({"_a": number(n_askers), "_b": F.col("block")})
        right = askers.join(first.select(F.col("asker").alias("block"), "floors"), "block").withColumns({"_a": F.col("block"), "_b": number(n_blocks, 1)})
        found = found.unionByName(left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(task, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = found.select(F.inline("found"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


QUERY_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 5
"""
