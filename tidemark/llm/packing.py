"""Best-fit packing of token sequences with exact-complement hashing.

Documents become token ids plus an end id; longer ones are cut into pieces of the sequence length. What is packed is the
histogram of piece lengths, which has at most `size` entries whatever the number of documents. The longest open length
opens a sequence; the gap is looked up among single lengths, sums of pairs and sums of triples, and a combination that
fills it exactly is consumed as often as the counts allow. Where none fills the gap, the longest piece that fits goes
in (best fit) and the lookup is repeated for what is left. The plan, a table of (length, range of ranks, first sequence,
offset) rows, is joined to the pieces by length and by their rank among the pieces of that length. Ranks may follow a given
order of the documents; sequences then do, too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize, ranked

SIZE = 4096
END_ID = 1
CACHE_WORDS, WORDS_AT_ONCE = 500_000, 20_000
#: ASCII signs but the apostrophe, which may start a contraction.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters (Latin up to U+017F, but for the dotted capital I) that compose and lower-case one by one.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-įı-ſ]*$"
WORD_END = "</w>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every segment, one segment after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Ids of a tokenizer that drops white space, equal to encoding whole texts; distinct words alone are encoded.

    Plain words fall into lower-case letters and the punctuation at their end, which the tokenizer splits too; all other
    words are encoded as they stand. What came before is looked up.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)
        self.mark = self._encode("\x00")
        probe = self._encode("ab cd ., ef")
        # a tokenizer of another kind has every word encoded as it stands
        self.split = len(self.mark) == 1 and self.ends[probe].sum() == 4 and bool(self.ends[probe[-1]]) and np.array_equal(self._encode("Ab.,"), self._encode("ab ., "))
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.start, self.length, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _store(self, new: pa.Array, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, new])
        self.start = np.append(self.start, len(self.flat) + np.cumsum(lengths) - lengths)
        self.length, self.flat = np.append(self.length, lengths), np.append(self.flat, flat)

    def _look_up(self, parts: pa.Array, whole: bool) -> np.ndarray:
        """The place of each part, -1 for the empty one. whole: encoded as they stand, else single words of the tokenizer."""
        parts = parts.dictionary_encode()
        distinct = parts.dictionary
        place = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        new = (place < 0) & pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)
        apart = np.zeros(len(new), bool)
        if whole:
            # marks between words show where each word's ids end
            apart = new & (pc.match_substring(distinct, "\x00").to_numpy(zero_copy_only=False) if len(self.mark) == 1 else True)
        for kind in (new & ~apart, apart):
            at = np.flatnonzero(kind)
            for first in range(0, len(at), WORDS_AT_ONCE):
                part = at[first : first + WORDS_AT_ONCE]
                own = distinct.take(pa.array(part))
                words_ = own.to_pylist()
                if kind is apart:
                    coded = [self._encode(w) for w in words_]
                    flat, lengths = np.concatenate(coded), np.array([len(c) for c in coded])
                elif whole:
                    flat = self._encode(" \x00 ".join(words_))
                    lengths = np.diff(np.append(np.flatnonzero(flat == self.mark[0]), len(flat)), prepend=-1) - 1
                    flat = flat[flat != self.mark[0]]
                else:
                    flat = self._encode(" ".join(words_))
                    lengths = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
                place[part] = len(self.known) + np.arange(len(own))
                self._store(own, flat, lengths)
        return place[parts.indices.to_numpy()]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids start (one more at the end)."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary
        if len(self.known) > self.cache_words:
            self._clear()
        base = pc.utf8_rtrim(distinct, characters=PUNCTUATION)
        plain = pc.match_substring_regex(base, PLAIN).to_numpy(zero_copy_only=False) & self.split
        # the punctuation at the end is what the base does not cover; mostly nothing or one sign
        cut = np.where(plain, pc.subtract(pc.binary_length(distinct), pc.binary_length(base)).to_numpy(zero_copy_only=False), 0)
        first, second = np.full(len(distinct), -1), np.full(len(distinct), -1)
        first[plain] = self._look_up(pc.utf8_lower(base.filter(pa.array(plain))), whole=False)
        first[~plain] = self._look_up(distinct.filter(pa.array(~plain)), whole=True)
        some = np.flatnonzero(cut)
        signs = pc.replace_substring_regex(distinct.take(pa.array(some)), pattern=r"(?s)^.*?([!-&(-/:-@\[-`{-~]*)$", replacement="\\1")
        second[some] = self._look_up(signs, whole=False)
        length, start = np.append(self.length, 0), np.append(self.start, 0)  # place -1: nothing
        pair = np.stack([first, second], axis=1).ravel()
        own = self.flat[_ragged(start[pair], length[pair])]
        sizes = length[first] + length[second]
        starts = np.cumsum(sizes) - sizes
        each = sizes[which]
        ids = own[_ragged(starts[which], each)]
        return ids, np.append(0, np.cumsum(each))[split.offsets.to_numpy() - split.offsets[0].as_py()]


_encoders: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer_path: str | None = None, size: int = SIZE, order: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document; a null text counts as empty.

    With `order`, a column of whole numbers, the document's number comes along as _order. A text of any length is encoded
    whole, in the memory of some tens of times its size.
    """
    path = tokenizer_path or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        for batch in batches:
            for rows in words.slices(batch, 1):
                out = []
                ids, begins = encoder.ids(rows.column(1).fill_null(""))
                rest = [column.to_pylist() for column in rows.columns[2:]]
                for doc, begin, end, *due in zip(rows.column(0).to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), *rest, strict=True):
                    own = np.append(ids[begin:end], np.array([END_ID], "<u4"))
                    out += [(doc, k, at, min(size, len(own) - at), zlib.crc32(own[at : at + size]), *due) for k, at in enumerate(range(0, len(own), size))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], names=names)

    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema, read = "doc_id long, piece int, start long, length long, ids_crc32 long", docs.select(F.col("doc_id").cast("long"), "text")
    if order:
        names, kinds, schema = [*names, "_order"], [*kinds, pa.int64()], f"{schema}, _order long"
        read = docs.select(F.col("doc_id").cast("long"), "text", F.col(order).cast("long"))
    return read.mapInArrow(cut, schema)


def _complement(free: np.ndarray, gap: int, most: int) -> list[int] | None:
    """A single length, a pair or a triple, none above `most`, that adds up to gap and is free; large parts first."""
    if gap <= most and free[gap]:
        return [gap]
    lengths = np.flatnonzero(free[: min(gap, most + 1)])
    if not len(lengths):
        return None

    def pair(total: int, top: int, less: int = 0) -> list[int] | None:
        a = lengths[(lengths <= min(top, total - 1)) & (2 * lengths >= total)]
        b = total - a
        used_a, used_b = 1 + (a == less), 1 + (b == less) + (a == b)
        fit = np.flatnonzero((free[a] >= used_a + (a == b)) & (free[b] >= used_b))
        return [int(a[fit[-1]]), int(b[fit[-1]])] if len(fit) else None

    if two := pair(gap, most):
        return two
    for c in lengths[::-1].tolist():
        if 3 * c < gap:
            break
        if gap - c >= 2 and (two := pair(gap - c, c, less=c)):
            return [c, *two]
    return None


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, first sequence, offset) that place every piece."""
    free = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        free[length] += n
    used, out, sequence = np.zeros(size + 1, dtype=np.int64), [], 0
    while len(left := np.flatnonzero(free)):
        parts = [int(left[-1])]
        free[parts[0]] -= 1
        gap = size - parts[0]
        while gap:
            if found := _complement(free, gap, size):
                more = found
            else:
                fitting = np.flatnonzero(free[: gap + 1])
                if not len(fitting):
                    break
                more = [int(fitting[-1])]
            for x in more:
                free[x] -= 1
            parts += more
            gap -= sum(more)
        lengths, per = np.unique(parts, return_counts=True)
        times = 1 + int(min(free[lengths] // per))
        free[lengths] -= per * (times - 1)
        offset = 0
        for x in parts:
            out.append((x, int(used[x]), int(used[x]) + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = SIZE, order: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document once.

    With `order`, a column of whole numbers, pieces of a length are used in that order (nulls first) and sequences are
    numbered by their earliest piece; ties come by doc_id, then piece. Without it, both follow hashes and lengths.

    Null and empty texts are one end id. Repeated rows are packed as often as they come. Other columns are left out. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, size, order))
    # at most `size` rows reach the driver
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, size), "_length long, _from long, _to long, _first long, offset long")
    first = ["_order", "doc_id", "piece"] if order else ["doc_id", "piece"]
    placed = ranked(cut, ["length"], first, name="_rank", in_order=bool(order))
    # at most a few rows for each length and combination: bounded by the sequence length, not by the data
    placed = placed.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select(
        *cut.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset"
    )
    if order:
        placed = materialize(placed)
        earliest = placed.groupBy("sequence_id").agg(F.min(F.struct(*first)).alias("_earliest"))
        numbered = ranked(earliest.withColumn("_all", F.lit(0)), ["_all"], ["_earliest", "sequence_id"], name="_number", in_order=True)
        placed = placed.join(numbered.select("sequence_id", "_number"), "sequence_id").drop("sequence_id").withColumnRenamed("_number", "sequence_id")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
