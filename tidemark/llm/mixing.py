"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in a hashed order, form blocks. With the weight w, a source's share of all slots as an exact
fraction, its i-th block (from 1) has the release time floor((i-1) / w) and the deadline ceil(i / w). In each slot the
released block with the earliest deadline runs. Shares add up to one, so every block meets its deadline, and until a
source runs out, it is within less than one block of its share of the slots after any number of slots.

Blocks are scheduled by ranges of slots, side by side. A range needs to know how many blocks of each source have run before
it. It guesses that some slots ahead and walks up to its start, as schedules from different starts soon meet; what a range
ends with is then compared with what the next one began with, and where these differ, the next one is walked again. So the
schedule is that of one walk through all slots, and the driver holds a few numbers a source, never a block or a range.

When a source has run out, the others go on between their release times and deadlines, so slots may stay empty. No row is
dropped or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ranked

BLOCK_ROWS = 16
EXPONENT = 0.5
LEAST_RANGE, WARM_UP = 20_000, 1000


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots for each source, one at least, adding up to the period (largest remainders)."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit a period of {period} slots")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    total, names = sum(weights.values()), sorted(weights)
    free = period - len(names)
    exact = {s: weights[s] / total * period for s in names}
    above = {s: max(0.0, exact[s] - 1) for s in names}
    scale = free / sum(above.values()) if sum(above.values()) else 0
    out = {s: 1 + int(above[s] * scale) for s in names}
    for s in sorted(names, key=lambda s: (-(above[s] * scale % 1), s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the exact ratio of the weights."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    exact = {s: Fraction(w) for s, w in weights.items()}
    whole = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * whole) for s, w in exact.items()}


def walk(share: dict[str, int], blocks: dict[str, int], total: int, done: dict[str, int], slot: int = 0, until: int | None = None) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, number of the block from 0, slot, release, deadline) from a slot on, before `until`, when done[source] blocks have run.

    `done` is kept up to date. A source has share / total of the slots; total counts sources that have run out too.
    """

    def window(s: str) -> tuple[int, int, str]:
        return done[s] * total // share[s], -(-(done[s] + 1) * total // share[s]), s

    waiting = [window(s) for s in done if done[s] < blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        if until is not None and slot >= until:
            return
        while waiting and waiting[0][0] <= slot:
            release, deadline, s = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, release))
        deadline, s, release = heapq.heappop(ready)
        i, done[s] = done[s], done[s] + 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, window(s))
        yield s, i, slot, release, deadline
        slot += 1


def schedule(quota: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period of whole quotas: (source, number of the block from 0, slot, release, deadline), earliest deadline first."""
    return list(walk(quota, quota, sum(quota.values()), dict.fromkeys(quota, 0)))


def guess(share: dict[str, int], blocks: dict[str, int], total: int, slot: int) -> dict[str, int]:
    """How many blocks of each source have run before a slot, nearly: those that are due, and of the open ones the most urgent."""
    done = {s: slot * share[s] // total for s in sorted(share)}
    left = slot - sum(done.values())
    urgent = sorted((-(-(done[s] + 1) * total // share[s]), s) for s in done if done[s] * total // share[s] < slot)
    for _, s in urgent[:left]:
        done[s] += 1
    return {s: min(blocks[s], n) for s, n in done.items()}


def starts(spark: SparkSession, share: dict[str, int], blocks: dict[str, int], size: int, warm: int = WARM_UP) -> DataFrame:
    """k, start: how many blocks of each source (sorted by name) have run before slot k * size, for each range of slots.

    Each range guesses its start some slots before, walks up to it and on to its end. Where a start is not the end of the
    range before, the range is walked again from there, until all fit: so starts are those of one walk through all slots.
    """
    names, total = sorted(share), sum(share.values())
    last = max((-(-blocks[s] * total // share[s]) for s in names), default=0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def end(k: int, start: list[int]) -> list[int]:
        done = dict(zip(names, start, strict=True))
        for _ in walk(share, blocks, total, done, k * size, (k + 1) * size):
            pass
        return [done[s] for s in names]

    def batch(rows: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = [[k for k, _ in rows], [start for _, start in rows], [end(k, start) for k, start in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "start", "end"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in rows.column(0).to_pylist():
                slot = max(0, k * size - max(warm, 8 * len(names)))
                done = guess(share, blocks, total, slot)
                for _ in walk(share, blocks, total, done, slot, k * size):
                    pass
                yield batch([(k, [done[s] for s in names])])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                yield batch([row])

    schema = "k long, start array<long>, end array<long>"
    states = materialize(spark.range(0, -(-last // size), 1, parts).mapInArrow(first, schema))
    while True:
        ends = states.select((F.col("k") + 1).alias("k"), F.col("end").alias("_before"))
        wrong = materialize(states.join(ends, "k").where(F.col("start") != F.col("_before")).select("k", F.col("_before").alias("start")))
        if wrong.isEmpty():
            return states.select("k", "start")
        states = materialize(states.join(wrong.select("k"), "k", "left_anti").unionByName(wrong.mapInArrow(again, schema)))


def plan(spark: SparkSession, share: dict[str, int], blocks: dict[str, int], least: int = LEAST_RANGE, warm: int = WARM_UP) -> DataFrame:
    """_source, block, slot, mix_release, mix_deadline for every block; each range of slots is scheduled by a task."""
    size, names, total = max(least, 4 * len(share)), sorted(share), sum(share.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k, start in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                steps = list(zip(*walk(share, blocks, total, dict(zip(names, start, strict=True)), k * size, (k + 1) * size)))
                if steps:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(steps, [pa.string(), *[pa.int64()] * 4], strict=True)], names=["_source", "block", "slot", "mix_release", "mix_deadline"])

    return starts(spark, share, blocks, size, warm).mapInArrow(run, "_source string, block long, slot long, mix_release long, mix_deadline long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, period: int | None = None, exponent: float = EXPONENT) -> DataFrame:
    """Add block (number within the source), slot (when the block runs), mix_release, mix_deadline and mix_order to docs.

    mix_order sorts the documents into the mix: slot * block_rows + place in the block. Without weights a source's
    weight is its number of rows to the power `exponent`. Weights are taken exactly; only if a period is asked for are they
    rounded to whole slots of it. A null source is a source of its own, apart from the empty text. Rows with equal ids
    come in any order among themselves and all stay. An empty table gives no rows. Columns of docs that have the names
    of the added ones are replaced.
    """
    docs = docs.drop("block", "slot", "mix_release", "mix_deadline", "mix_order")
    named = docs.withColumn("_source", F.when(F.col(key).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(key).cast("string"))))
    # one row a source
    sizes = {r["_source"]: r["n"] for r in named.groupBy("_source").agg(F.count("*").alias("n")).collect()}
    own = {("-" if s is None else f"+{s}"): w for s, w in weights.items()} if weights else {s: n**exponent for s, n in sizes.items()}
    if lacking := sorted(set(sizes) - set(own)):
        raise ValueError(f"no weight for {lacking[:5]}")
    own = {s: own[s] for s in own if s in sizes}
    share = (quotas(own, period) if period else shares(own)) if sizes else {}
    slots = plan(docs.sparkSession, share, {s: -(-n // block_rows) for s, n in sizes.items()})
    placed = ranked(named, ["_source"], [id_col], name="_rank").withColumn("block", F.floor(F.col("_rank") / block_rows))
    return (
        placed.join(slots, ["_source", "block"])
        .withColumn("mix_order", F.col("slot") * block_rows + F.col("_rank") % block_rows)
        .select(*docs.columns, "block", "slot", "mix_release", "mix_deadline", "mix_order")
    )
