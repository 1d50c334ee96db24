"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers, A and B, cut the bytes of a text at different places. Their token ends, of all texts of a slice one after
the other, are two sorted lists, and aligning is merging them: each step of the merge goes along one byte range that lies
in one token of A and one of B (a link), and where both end at once a group of tokens ends. Every `STEPS`-th diagonal of
the merge is searched by halving for the place where the merge crosses it, all diagonals together. The pieces between
them are independent and of equal work, however long or short the texts are; they run side by side, a step of all
pieces at a time. A piece emits its links and ends of groups; the groups that it begins or ends within are stitched
from the running number of ends before it.

Tokens come from units of text (tokens.py) that are encoded once. How often an id pair is linked in the corpus is summed up
from one row a pair and section of a task (about SECTION bytes of text), and goes back to the sections, whose documents
have meanwhile waited as written rows with their pairs by number. So no document's links are shuffled one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize
from .tokens import Known, buffers, offsets, ragged, strings, units

STEPS, SECTION = 128, 48_000_000
SPACE_MARK = "▁"
OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
KINDS = [*[pa.int64()] * 7, pa.string()]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal d of merging sorted a and b, how many of the first d come from a (a's first among equals)."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # a[middle] belongs to the first d if it is not above the last of b that would
        other = diagonals - middle - 1
        first = a[np.minimum(middle, len(a) - 1)] <= b[np.clip(other, 0, len(b) - 1)]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low


def merge_path(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (index of a, index of b) of two lists of ends, and the group of each a and b.

    a and b are sorted, without repeats, and end at the same place. A link is a range between neighbouring ends.
    """
    if not len(a) or not len(b):
        return (np.empty(0, np.int64),) * 4
    total = len(a) + len(b)
    begin = np.arange(0, total, steps)
    i = crossings(a, b, begin)
    j = begin - i
    # a guard behind both lists: the one that is not at its end is read on
    a_, b_ = np.append(a, a[-1] + 1), np.append(b, b[-1] + 1)
    i_of, j_of = np.empty((steps, len(begin)), np.int32), np.empty((steps, len(begin)), np.int32)
    link, ends = np.zeros((steps, len(begin)), bool), np.zeros((steps, len(begin)), bool)
    for k in range(steps):
        here_a, here_b = a_[i], b_[j]
        # of two equal ends a's comes first; b's step then has no range of its own and ends the group
        from_a = here_a <= here_b
        again = ~from_a & (i > 0) & (a_[np.maximum(i, 1) - 1] == here_b)
        inside = begin + k < total
        i_of[k], j_of[k], link[k], ends[k] = i, j, inside & ~again, inside & again
        i, j = i + (from_a & inside), j + (~from_a & inside)
    # in the order of pieces, then steps
    i_of, j_of, link, ends = (x.T.ravel() for x in (i_of, j_of, link, ends))
    at = np.flatnonzero(ends)
    # groups end where both lists do: numbers run on through the pieces
    last_a, last_b = i_of[at], j_of[at] + 1
    groups = np.arange(len(at))
    group_a = np.repeat(groups, np.diff(last_a, prepend=0))
    group_b = np.repeat(groups, np.diff(last_b, prepend=0))
    return i_of[link], j_of[link], group_a, group_b


class Side:
    """A tokenizer: ids of units, and the bytes of each id."""

    def __init__(self, encode, of_id: list[bytes]):
        self.known = Known(lambda new: self._encode(new))
        self.encode = encode
        self.size = np.array([len(x) for x in of_id], np.int64)
        self.begin, self.data = offsets(self.size)[:-1], np.frombuffer(b"".join(of_id), np.uint8)

    def _encode(self, new: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        lists = self.encode([x.decode() for x in new.to_pylist()])
        each = np.array([len(x) for x in lists], np.int64)
        return np.fromiter((i for x in lists for i in x), np.int64, int(each.sum())), each

    def tokens(self, values: pa.LargeBinaryArray, borders: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's start."""
        ids, each = self.known.ids(values)
        return ids.astype(np.int64), offsets(each)[np.searchsorted(borders, begins)]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.begin[ids], self.size[ids])]


def _level(path: str) -> tuple:
    """Encoder and bytes of ids of a byte-level vocabulary, in whose entries each byte stands as a printable character."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}
    entry = {i: token for token, i in tokenizer.get_vocab().items()}
    as_bytes = [bytes(byte[c] for c in entry.get(i, "")) if all(c in byte for c in entry.get(i, "")) else entry[i].encode() for i in range(max(entry) + 1)]
    return lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], as_bytes


def _pieces(path: str) -> tuple:
    """Encoder and bytes of ids of a model of pieces that puts a space before a text; texts come with that space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    as_bytes = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        as_bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())
    # a lone space, as after a text's last word, is what the model would put before the empty text, of which it makes nothing
    lone = [model.piece_to_id(SPACE_MARK)]
    return lambda texts: [ids or lone for ids in model.encode([x[1:] for x in texts], num_threads=1)], as_bytes


_sides: dict[tuple[str, str], tuple[Side, Side]] = {}


def _both(a: str, b: str) -> tuple[Side, Side]:
    if (a, b) not in _sides:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _sides[a, b] = Side(*_level(a)), Side(*_pieces(b))
    return _sides[a, b]


def _with_space(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a space and each text that is not null or empty, where each starts, and which are not."""
    data, begins = buffers(column)
    some = np.diff(begins) > 0
    sizes = np.diff(begins) + some
    out = np.empty(int(sizes.sum()), np.uint8)
    starts = offsets(sizes)
    space = np.zeros(len(out), bool)
    space[starts[:-1][some]] = True
    out[space], out[~space] = 32, data
    return out, starts, some


def aligned(column: pa.Array, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and first index by text of A and B, group of each token, and links (indices of A's and B's tokens and the text).

    A text whose joined bytes differ from a space and the text has no tokens.
    """
    data, begins, some = _with_space(column)
    borders = units(data, begins)
    values = strings(data, borders)
    ids, first = zip(*(side.tokens(values, borders, begins) for side in (a, b)), strict=True)
    ids, first, whole = list(ids), list(first), some
    for k, side in enumerate((a, b)):
        size = np.diff(offsets(side.size[ids[k]])[first[k]])
        same = size == np.diff(begins)
        if same.all():
            made = side.joined(ids[k]) != data
            same &= ~np.bincount(np.searchsorted(begins, np.flatnonzero(made), side="right") - 1, minlength=len(same)).astype(bool)[: len(same)]
        else:
            # text by text: the lengths of some differ
            made = offsets(side.size[ids[k]])[first[k]]
            joined = side.joined(ids[k])
            for t in np.flatnonzero(same):
                same[t] = np.array_equal(joined[made[t] : made[t + 1]], data[begins[t] : begins[t + 1]])
        whole = whole & same
    ends, text = [], []
    base = offsets(np.where(whole, np.diff(begins), 0))
    for k, side in enumerate((a, b)):
        n = np.diff(first[k])
        keep = np.repeat(whole, n)
        ids[k] = ids[k][keep]
        n = np.where(whole, n, 0)
        first[k] = offsets(n)
        text.append(np.repeat(np.arange(len(n)), n))
        ends.append(np.cumsum(side.size[ids[k]]))
    assert not len(ends[0]) or ends[0][-1] == ends[1][-1] == base[-1]
    i, j, group_a, group_b = merge_path(*ends)
    return ids[0], first[0], ids[1], first[1], group_a, group_b, i, j, text[0][i]


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below `most`, a row each with room for a sign, and how many."""
    texts = [str(i).encode() for i in range(most)]
    width = len(texts[-1]) + 1
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(most, width), np.array([len(x) for x in texts])


_text: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def group_text(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, closes: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """The text `a1,a2|b1;a3|b2,b3` of each document, one after the other, and for each group the place behind it; closes: whether a group is the last of its document."""
    digits, width = _text.get(n_ids) or _text.setdefault(n_ids, _digits(n_ids))
    n_a, n_b = (np.bincount(g, minlength=len(closes)) for g in (group_a, group_b))
    total = n_a + n_b
    start = offsets(total)[:-1]
    at_a = np.arange(len(ids_a)) - (offsets(n_a)[:-1])[group_a] + start[group_a]
    at_b = np.arange(len(ids_b)) - (offsets(n_b)[:-1])[group_b] + (start + n_a)[group_b]
    ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    sign[start + n_a - 1] = ord("|")
    sign[start + total - 1] = np.where(closes, 0, ord(";"))
    rows = digits[ids]
    rows[np.arange(len(ids)), width[ids]] = sign
    flat = rows.ravel()
    size = width[ids] + (sign > 0)
    return flat[flat > 0], offsets(size)[start + total]


def _packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, first all low bytes, then the next: high bytes are mostly zeros and take no room."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Section:
    """The id pairs that a section's texts have linked, numbered as they come."""

    def __init__(self) -> None:
        self.key, self.number, self.n, self.bytes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def add(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The numbers of sorted distinct pairs, of which there are n more each."""
        place = np.searchsorted(self.key, key)
        old = np.zeros(len(key), bool)
        inside = place < len(self.key)
        old[inside] = self.key[place[inside]] == key[inside]
        fresh = np.flatnonzero(~old)
        numbers = np.empty(len(key), np.int64)
        numbers[old] = self.number[place[old]]
        numbers[fresh] = len(self.n) + np.arange(len(fresh))
        self.key = np.insert(self.key, place[fresh], key[fresh])
        self.number = np.insert(self.number, place[fresh], numbers[fresh])
        self.n = np.append(self.n, np.zeros(len(fresh), np.int64))
        self.n[numbers] += n
        return numbers

    def rows(self, name: int) -> pa.RecordBatch:
        by = np.argsort(self.number)
        key = self.key[by]
        return _rows(section=[name], pair_a=[(key >> 32).astype(np.int32)], pair_b=[(key & 0xFFFFFFFF).astype(np.int32)], pair_n=[self.n])


FIELDS = {
    "section": pa.int64(), "docs": pa.binary(), "sha": pa.binary(), "number": pa.binary(), "times": pa.binary(), "pair_a": pa.list_(pa.int32()), "pair_b": pa.list_(pa.int32()), "pair_n": pa.list_(pa.int64()),
}
PASS = "section long, docs binary, sha binary, number binary, times binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), kind) for name, kind in FIELDS.items()], names=list(FIELDS))


def _slice(rows: pa.RecordBatch, a: Side, b: Side, section: _Section, name: int) -> pa.RecordBatch:
    """One row for the documents of a slice: their counts, digests, and the numbers of their pairs."""
    ids_a, first_a, ids_b, first_b, group_a, group_b, i, j, text = aligned(rows.column(1), a, b)
    n = rows.num_rows
    n_a, n_b, n_links = np.diff(first_a), np.diff(first_b), np.bincount(text, minlength=n)
    starts = np.append(-1, group_a)[first_a[1:]]  # the last group of the text, or one before
    n_groups = np.diff(starts, prepend=-1)
    n_groups[n_a == 0] = 0
    closes = np.zeros(len(group_a) and group_a[-1] + 1, bool)
    closes[starts[n_a > 0]] = True
    data, behind = group_text(ids_a, ids_b, group_a, group_b, closes, max(len(a.size), len(b.size)))
    ends = np.append(0, behind)[np.maximum(starts, -1) + 1]
    sha = b"".join(hashlib.sha256(data[x:y]).digest() if y > x else bytes(32) for x, y in pairwise([0, *ends.tolist()]))
    key = (ids_a[i] << 32) | ids_b[j]
    pairs, which, times = np.unique(key, return_inverse=True, return_counts=True)
    numbers = section.add(pairs, times)
    # what a document has of a pair, once
    of_doc, times = np.unique(text * len(pairs) + which, return_counts=True)
    doc = of_doc // max(len(pairs), 1)
    each = np.bincount(doc, minlength=n)
    given = rows.column(0).cast(pa.int64())
    table = np.stack([given.fill_null(0).to_numpy(), given.is_null().to_numpy(zero_copy_only=False), n_a, n_b, n_groups, n_links, each]).astype("<i8")
    return _rows(section=[name], docs=[table.tobytes()], sha=[sha], number=[_packed(numbers[of_doc % max(len(pairs), 1)])], times=[_packed(times)])


def _sections(docs: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _both(*tokenizers)
        task, section, k = TaskContext.get().partitionId(), _Section(), 0
        for batch in batches:
            for rows in words.slices(batch, 1, 2_000_000):
                yield _slice(rows, a, b, section, task << 32 | k)
                section.bytes += rows.column(1).nbytes
                if section.bytes > SECTION:
                    yield section.rows(task << 32 | k)
                    section, k = _Section(), k + 1
        yield section.rows(task << 32 | k)

    return docs.select("doc_id", "text").mapInArrow(run, PASS)


def pair_counts(written: DataFrame) -> DataFrame:
    """a, b, count, best: how many links hold an id pair, and whether that is the most that its B id has."""
    zipped = F.arrays_zip(F.col("pair_a").alias("a"), F.col("pair_b").alias("b"), F.col("pair_n").alias("n"))
    rows = written.where("pair_a is not null").select("section", F.posexplode(zipped).alias("number", "p")).select("section", "number", "p.*")
    counts = materialize(rows.groupBy("a", "b").agg(F.sum("n").alias("count")))
    # one row an id of B: bounded by its vocabulary
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return rows.select("section", "number", "a", "b").join(counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), ["a", "b"])


def _finish(slices: pa.Table, pairs: pa.Table) -> pa.Table:
    if not slices.num_rows:
        # a section without documents has no pairs either
        return pa.table([pa.array([], t) for t in KINDS], names=OUT)
    number = pairs.column("number").to_numpy()
    count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    count[number], best[number] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    out = [[] for _ in OUT]
    for docs, sha, number, times in zip(*(slices.column(c).to_pylist() for c in ("docs", "sha", "number", "times")), strict=True):
        doc_id, null, *counts, each = np.frombuffer(docs, "<i8").reshape(7, -1)
        number, times = _unpacked(number), _unpacked(times)
        doc = np.repeat(np.arange(len(each)), each)
        sums = []
        for what in (best, count):
            total = offsets(times * what[number])
            border = offsets(each)
            sums.append(np.diff(total[border]) if len(doc) else np.zeros(len(each), np.int64))
        digest = [sha[at : at + 32].hex() if n else "" for at, n in zip(range(0, len(sha), 32), counts[0].tolist(), strict=True)]
        for column, x in zip(out, (pa.array(doc_id, mask=null.astype(bool)), *map(pa.array, counts), *map(pa.array, sums), pa.array(digest, pa.string())), strict=True):
            column.append(x)
    return pa.table([pa.chunked_array([x.cast(t) for x in c], t) for c, t in zip(out, KINDS, strict=True)], names=OUT)


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    Each text is encoded with a space before it, without special tokens. Null and empty texts, and those whose joined A or
    B bytes are not the space and the text, have no tokens: zeros and an empty digest. Repeated rows and null ids come as
    often as they are given and count as often. A text of any length is encoded and merged whole, in the memory of some
    hundred times its size. Other columns are left out. An empty table gives no rows.
    """
    written = materialize(_sections(docs, tokenizers or default_tokenizers()))
    slices = written.where("docs is not null").select("section", "docs", "sha", "number", "times")
    pairs = pair_counts(written).select(F.col("section").alias("of"), "number", "count", "best")
    return slices.groupBy("section").cogroup(pairs.groupBy("of")).applyInArrow(_finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
