"""Substring dedup by recompression.

Words get 64-bit names. ROUNDS rounds compress each document: in each, runs of one name become one symbol, whatever their
length, then neighbours whose names fall into the left and the right half of that round's alphabet become one symbol. The
name of a run or pair is a hash of the names inside, a naming that holds for the whole corpus without a table of names to
agree on, so equal passages carry equal symbols but close to their ends. How close is known for each symbol: its reach is
the passage that settles it, its own words and those of the neighbours that decided where it begins and ends, round by
round.

Each window takes the symbol of the highest round whose reach lies inside it; of several the lowest name, of those the
first. Equal windows take equal symbols at the same place. Neighbouring windows with the same symbol form a block; the
symbol and its reach, which all windows of the block share, name its group, and all of its words name the block:

1. Groups of one block cannot hold a repeated window; shared symbols are the candidates (few).
2. All windows of a block that comes more than once are repeated.
3. In a group of different blocks, one of each kind spells out its windows, and equal windows are counted.

Copies are counted by partial aggregation before they move, so no window of a large group of copies is ever listed more
than once. Equality is that of 128 bits of independent hashes of the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize

WINDOW, ROUNDS, MOST = 35, 3, 60
U = np.uint64
KEY = ["_id", "_row"]


class Symbols:
    """Symbols of one round: names, first words and reaches (from lo up to hi), in order of place, for all documents."""

    def __init__(self, name: np.ndarray, at: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, begins: np.ndarray):
        self.name, self.at, self.doc, self.lo, self.hi, self.begins = name, at, doc, lo, hi, begins

    def __getitem__(self, keep: np.ndarray) -> Symbols:
        return Symbols(self.name[keep], self.at[keep], self.doc[keep], self.lo[keep], self.hi[keep], self.begins)

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the reach of the symbol before starts and that of the symbol after ends; beyond the document at its ends."""
        apart = np.append(True, self.doc[1:] != self.doc[:-1])
        before = np.where(apart, self.begins[self.doc] - 1, np.append(0, self.lo[:-1]))
        after = np.where(np.append(apart[1:], True), self.begins[self.doc + 1] + 1, np.append(self.hi[1:], 0))
        return before, after


def first_symbols(h: np.ndarray, begins: np.ndarray) -> Symbols:
    at = np.arange(len(h))
    return Symbols(h, at, np.repeat(np.arange(len(begins) - 1), np.diff(begins)), at, at + 1, begins)


def compressed(s: Symbols, round_: int) -> Symbols:
    """The symbols after one more round. Alone or not, a symbol's fate depends on its neighbours, which its reach takes in."""
    new = np.append(True, (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1]))
    start = np.flatnonzero(new)
    run = np.diff(np.append(start, len(s.name)))
    before, after = s.around()
    lo, hi = before[start], after[start + run - 1]
    s = s[start]
    s.lo, s.hi = lo, hi
    s.name = np.where(run > 1, words.mix(s.name * U(words.BASE) + words.mix(run.astype(np.uint64) + U(2))), s.name)
    left = (words.mix(s.name ^ U(0x5851F42D4C957F2D + round_)) >> U(40)) & U(1) == 0
    pair = np.append(left[:-1] & ~left[1:] & (s.doc[:-1] == s.doc[1:]), False)
    second = np.append(False, pair[:-1])
    before, after = s.around()
    # a left one alone had no right one after it, a right one alone no left one before it
    lo = np.where(~left & ~second, before, s.lo)
    hi = np.where(left, after, s.hi)
    first = np.flatnonzero(pair)
    name = s.name.copy()
    name[first] = words.mix(s.name[first] * U(words.BASE) + words.mix(s.name[first + 1] + U(3)))
    hi[first] = s.hi[first + 1]
    out = Symbols(name, s.at, s.doc, lo, hi, s.begins)
    return out[~second]


class Passages:
    """Hashes of any passage of a sequence of words, 64 bits each for two independent namings."""

    def __init__(self, h: np.ndarray):
        self.power, self.inverse = words.powers(len(h) + 1)
        self.sums = [np.append(U(0), np.cumsum(words.mix(h + U(k)) * self.power[: len(h)], dtype=np.uint64)) for k in (1, 0x9E37)]

    def name(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return words.mix((s[end] - s[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def _lowest(s: Symbols, p: np.ndarray, window: int, n: int) -> np.ndarray:
    """For each window start in p the index of the lowest name among the symbols with their reach inside; -1 without any."""
    # reaches start and end in order of place, so the symbols inside a window are neighbours
    before = np.cumsum(np.bincount(np.maximum(s.lo + 1, 0), minlength=n + 2))
    ended = np.cumsum(np.bincount(np.minimum(s.hi, n + 1), minlength=n + 2))
    i, j = before[p], ended[p + window]
    some = np.flatnonzero(j > i)
    out = np.full(len(p), -1)
    if not len(some):
        return out
    i, size = i[some], (j - i)[some]
    rank = (words.mix(s.name) >> U(28) << U(28)) | np.arange(len(s.name), dtype=np.uint64)
    lows, step = [rank], 1
    while 2 * step <= size.max():
        lows.append(np.append(np.minimum(lows[-1][:-step], lows[-1][step:]), lows[-1][-step:]))
        step *= 2
    k = np.frexp(size)[1] - 1
    lows = np.stack(lows)
    low = np.minimum(lows[k, i], lows[k, i + size - (1 << k)])
    out[some] = (low & U((1 << 28) - 1)).astype(np.int64)
    return out


def blocks(h: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Group name, block name, document, first word (in the document) and number of windows of each block."""
    sizes = np.diff(begins)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(h)
    inside = np.arange(n) - np.repeat(begins[:-1], sizes)
    p = np.flatnonzero(inside + window <= np.repeat(sizes, sizes))
    if not len(p):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    rounds = [first_symbols(h, begins)]
    for r in range(ROUNDS):
        rounds.append(compressed(rounds[-1], r))
    level, at, lo, hi = (np.zeros(len(p), np.int64) for _ in range(4))
    name, open_ = np.zeros(len(p), np.uint64), np.arange(len(p))
    for r in range(ROUNDS, -1, -1):
        s = rounds[r]
        found = _lowest(s, p[open_], window, n)
        got, sym = open_[found >= 0], found[found >= 0]
        level[got], at[got], lo[got], hi[got], name[got] = r, s.at[sym], s.lo[sym], s.hi[sym], s.name[sym]
        open_ = open_[found < 0]
    key = at * (ROUNDS + 1) + level
    head = np.append(True, (key[1:] != key[:-1]) | (p[1:] != p[:-1] + 1))
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(p)))
    begin, at, lo, hi, level, name = p[first], at[first], lo[first], hi[first], level[first], name[first]
    passages = Passages(h)
    group = words.mix(passages.name(lo, hi, 0) ^ words.mix(name + level.astype(np.uint64)))
    block = words.mix(passages.name(begin, begin + count - 1 + window, 1) + words.mix((at - begin).astype(np.uint64) * U(64) + count.astype(np.uint64)))
    return group, block, doc[begin], inside[begin], count


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of a row: its id and a hash of id and text, which tells rows of one id apart."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_row": F.xxhash64("doc_id", "text")})


def _scan(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, h, begins in words.hashed(batch.column(2)):
                group, block, doc, begin, count = blocks(h, begins, window)
                rows = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), pa.array(block.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(begin * 64 + count)], names=["g", "b", *KEY, "at"])

    return docs.select(*KEY, "text").mapInArrow(run, "g long, b long, _id long, _row long, at long")


def _windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """w1, w2, g, b, j, times: the j-th window of each block in wanted (key, _w: array of g, b, at, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1).to_pylist()
            for first, last, h, begins in words.hashed(batch.column(0)):
                rows = [(begins[i - first] + w["at"] // 64, w["at"] % 64, w["g"], w["b"], w["times"]) for i in range(first, last) for w in asked[i] if begins[i - first] + w["at"] // 64 + w["at"] % 64 - 1 + window <= begins[i - first + 1]]
                if not rows:
                    continue
                begin, count, g, b, times = (np.array(c, np.int64) for c in zip(*rows))
                j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                p = np.repeat(begin, count) + j
                passages = Passages(h)
                out = [passages.name(p, p + window, k).view(np.int64) for k in (0, 1)] + [np.repeat(g, count), np.repeat(b, count), j, np.repeat(times, count)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["w1", "w2", "g", "b", "j", "times"])

    return docs.join(wanted, KEY).select("text", "_w").mapInArrow(run, "w1 long, w2 long, g long, b long, j long, times long")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """_id, _row, at, mask: bit j of mask is set if the window that starts at word at // 64 + j of the row's text is repeated."""
    if not 1 <= window <= MOST:
        raise ValueError(f"windows of 1 to {MOST} words are possible")
    docs = docs.where("text is not null")
    found = _scan(docs, window)
    # written down, so that the join has exchanges of its own whose large partitions Spark can split
    several = materialize(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    hits = materialize(found.join(several, "g", "left_semi"))
    kinds = materialize(hits.groupBy("g", "b").agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "at")).alias("first")))
    mixed = materialize(kinds.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    apart = kinds.join(mixed, "g", "left_semi").groupBy(*[F.col(f"first.{k}").alias(k) for k in KEY]).agg(F.collect_list(F.struct("g", "b", "first.at", "times")).alias("_w"))
    spelt = materialize(_windows(docs, apart, window))
    again = materialize(spelt.groupBy("w1", "w2").agg(F.sum("times").alias("n")).where("n > 1").select("w1", "w2"))
    bit = F.expr("shiftleft(1L, cast(j as int))")
    some = spelt.where("times = 1").join(again, ["w1", "w2"], "left_semi").groupBy("g", "b").agg(F.bit_or(bit).alias("mask"))
    whole = kinds.where("times > 1").select("g", "b", F.expr("shiftleft(1L, cast(first.at % 64 as int)) - 1").alias("mask"))
    return hits.join(materialize(some.unionByName(whole)), ["g", "b"]).select(*KEY, "at", "mask")


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, kept (text of the words that stay, joined by one space), n_words, n_removed, for each row of docs.

    A word goes if a window of `window` words around it also starts anywhere else; windows are those of the input. A
    null text has no words, a text of fewer words than a window loses none. Rows are documents of their own, whatever
    their ids: those of one id or of none lose what they share with other rows alone. An empty table gives no rows. Other
    columns are left out. Texts of any length are taken whole, in the memory of some tens of times their size.
    """
    docs = _keyed(docs.select("doc_id", "text"))
    # rows alike in id and text have the same marks, which count once
    marks = repeated_windows(docs, window).groupBy(*KEY, "at").agg(F.bit_or("mask").alias("mask"))
    marked = marks.groupBy(*KEY).agg(F.collect_list(F.struct("at", "mask")).alias("_m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, marks in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = (text.as_py() or "").encode().split()  # bytes split at the six separators alone
                gone = np.zeros(len(own) + 1, np.int64)
                for m in marks or ():
                    begin, mask = m["at"] // 64, m["mask"]
                    while mask:
                        j = (mask & -mask).bit_length() - 1
                        run_ = ((~(mask >> j)) & -(~(mask >> j))).bit_length() - 1
                        if begin + j < len(own):
                            gone[begin + j] += 1
                            gone[min(len(own), begin + j + run_ - 1 + window)] -= 1
                        mask &= ~(((1 << run_) - 1) << j)
                left = np.flatnonzero(np.cumsum(gone[:-1]) == 0) if marks else range(len(own))
                kept.append(b" ".join([own[i] for i in left] if marks else own).decode())
                n_words.append(len(own))
                n_removed.append(len(own) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["doc_id", "kept", "n_words", "n_removed"])

    return docs.join(marked, KEY, "left").select("doc_id", "text", "_m").mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long")


QUERY_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents
), win AS (
  SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), again AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM win WHERE h IN (SELECT h FROM again)
), w AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d
), kept AS (
  SELECT w.r, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY w.k) FILTER (WHERE gone.k IS NULL) AS kept
  FROM w LEFT JOIN gone ON gone.r = w.r AND gone.k = w.k GROUP BY 1
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
