"""Byte-level BPE: encoding by recursive SQL in each task, decoding by ordered aggregation.

A task's texts fall into units (tokens.py), a unit into the matches of the vocabulary's pattern. Matches that the task has
not met go, as a table of one row a byte with word and position, to an in-process DuckDB. There a recursive query joins
the rows with the table of merges, contracts each word's leftmost pair of minimum rank and goes on until no word has a
pair left. A match that is a token as a whole is that token. Decoding cuts the ids into runs, joins the ids of distinct
runs with the vocabulary and puts their bytes together in the order of positions.

A row is kept for each byte and contraction, so words of up to WINDOW bytes cost a few thousand rows at most. A longer
match is encoded in overlapping windows: two neighbouring tokens of an encoding are so in any text, so windows can be
joined at a token that both hold. Where two windows share none, they become one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .tokens import Known, buffers, offsets, ragged, strings, units

WINDOW, ROWS_AT_ONCE, MEMORY = 256, 2_000_000, "500MB"

MERGES_SQL = """
CREATE TABLE merges AS
SELECT a.id::BIGINT * 4294967296 + b.id AS pair, c.id AS merged
FROM (SELECT id, hex, unnest(range(2, len(hex), 2)) AS cut FROM vocab) c
JOIN vocab a ON a.hex = substr(c.hex, 1, c.cut) JOIN vocab b ON b.hex = substr(c.hex, c.cut + 1)
"""

# t: the tokens of words that still change; nid, npos: the next token of the word
ENCODE_SQL = """
WITH RECURSIVE t(word, pos, id, nid, npos, step) AS (
  SELECT word, pos, id, lead(id) OVER w, lead(pos) OVER w, 0 FROM bytes WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL (
    WITH best AS (
      SELECT word, min(merged::BIGINT * 4294967296 + pos) AS least, arg_min(npos, merged::BIGINT * 4294967296 + pos) AS gone
      FROM t JOIN merges ON pair = id::BIGINT * 4294967296 + nid GROUP BY word
    ), change AS (
      SELECT best.word, (least % 4294967296)::INTEGER AS place, (least // 4294967296)::INTEGER AS merged, gone, t.nid AS after_id, t.npos AS after_pos
      FROM best JOIN t ON t.word = best.word AND t.pos = best.gone
    )
    SELECT t.word, pos, CASE WHEN pos = place THEN merged ELSE id END,
           CASE WHEN pos = place THEN after_id WHEN npos = place THEN merged ELSE nid END,
           CASE WHEN pos = place THEN after_pos ELSE npos END, step + 1
    FROM t JOIN change ON t.word = change.word WHERE pos <> gone
  )
)
SELECT word, id FROM t JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) USING (word, step) ORDER BY word, pos
"""

DECODE_SQL = """
SELECT unhex(string_agg(hex, '' ORDER BY pos)) AS text FROM runs JOIN vocab USING (id) GROUP BY run ORDER BY run
"""


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Encodes and decodes the texts of a task by the ranks of a file."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.find = regex.compile(pattern).findall
        # in memory alone: nothing is written beside a task
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        vocab = pa.table({"id": pa.array(self.rank.values(), pa.int32()), "hex": [token.hex() for token in self.rank]})
        self._table("given", vocab, "CREATE TABLE vocab AS SELECT * FROM given")
        self.db.execute(MERGES_SQL)
        self.of_byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.opens, self.size = np.zeros(max(self.rank.values()) + 1, bool), np.zeros(max(self.rank.values()) + 1, np.int64)
        for token, rank in self.rank.items():
            self.opens[rank], self.size[rank] = token.startswith(b" "), len(token)
        self.units, self.matches, self.runs = Known(self._encode_units), Known(self._encode_matches), Known(self._decode_runs, "u1")

    def _table(self, name: str, table: pa.Table, sql: str) -> dict[str, np.ndarray]:
        self.db.register(name, table)
        try:
            return self.db.execute(sql).fetchnumpy()
        finally:
            self.db.unregister(name)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids start (one more at the end)."""
        data, begins = buffers(texts)
        borders = units(data, begins)
        ids, each = self.units.ids(strings(data, borders))
        return ids, offsets(each)[np.searchsorted(borders, begins)]

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and where each text's start, from their ids."""
        borders = np.unique(np.concatenate([np.flatnonzero(self.opens[ids]), begins]))
        data, each = self.runs.ids(strings(np.ascontiguousarray(ids, "<u4").view(np.uint8), borders * 4))
        return data, offsets(each)[np.searchsorted(borders, begins)]

    def _encode_units(self, new: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.find(unit.decode()) for unit in new.to_pylist()]
        ids, each = self.matches.ids(pa.array([match.encode() for matches in found for match in matches], pa.large_binary()))
        return ids, np.diff(offsets(each)[offsets([len(matches) for matches in found])])

    def _encode_matches(self, new: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        out: list[np.ndarray | None] = []
        parts: list[bytes] = []
        windows: dict[int, tuple[bytes, int, int]] = {}
        place = []
        for i, word in enumerate(new.to_pylist()):
            whole = self.rank.get(word)
            out.append(None if whole is None else np.array([whole], np.int32))
            if whole is None and len(word) <= WINDOW:
                place.append((i, len(parts)))
                parts.append(word)
            elif whole is None:
                own = [word[at : at + WINDOW] for at in range(0, len(word) - WINDOW // 2, WINDOW // 2)]
                windows[i] = (word, len(parts), len(parts) + len(own))
                parts += own
        coded = self._contract(parts)
        for i, k in place:
            out[i] = coded[k]
        for i, (word, first, last) in windows.items():
            out[i] = self._stitch(word, coded[first:last])
        return np.concatenate([np.empty(0, np.int32), *out]), np.array([len(ids) for ids in out])

    def _contract(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of each word by the recursive query, some words at a time."""
        sizes, out = np.array([len(part) for part in parts], np.int64), []
        turn = np.cumsum(sizes * sizes) // ROWS_AT_ONCE
        for first, last in pairwise([*np.flatnonzero(np.diff(turn, prepend=-1)).tolist(), len(parts)]):
            own = sizes[first:last]
            ids = self.of_byte[np.frombuffer(b"".join(parts[first:last]), np.uint8)]
            begins = offsets(own)[:-1]
            table = pa.table({"word": np.repeat(np.arange(len(own), dtype=np.int32), own), "pos": ragged(np.zeros_like(begins), own).astype(np.int32), "id": ids})
            found = self._table("bytes", table, ENCODE_SQL)
            out += np.split(found["id"], np.cumsum(np.bincount(found["word"], minlength=len(own)))[:-1])
        return out

    def _stitch(self, word: bytes, coded: list[np.ndarray]) -> np.ndarray:
        """The ids of a long word from those of its windows."""
        ends_of = lambda ids, start: start + np.cumsum(self.size[ids])
        ids, ends, begin = coded[0], ends_of(coded[0], 0), 0
        for k, more in enumerate(coded[1:], 1):
            start = k * (WINDOW // 2)
            more_ends = ends_of(more, start)
            # a token that both hold: its end and the one before are ends of both, or starts of the window
            both = np.intersect1d(np.append(ends, begin), np.append(more_ends, start))
            first = [(a, b) for a, b in pairwise(both.tolist()) if not ((ends > a) & (ends < b)).any() and not ((more_ends > a) & (more_ends < b)).any()]
            if first:
                cut = first[len(first) // 2][1]
                ids, ends = np.append(ids[ends <= cut], more[more_ends > cut]), np.append(ends[ends <= cut], more_ends[more_ends > cut])
            else:
                ids = self._contract([word[: start + WINDOW]])[0]
                ends = ends_of(ids, 0)
        return ids

    def _decode_runs(self, new: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        data, begins = buffers(new)
        ids, each = data.view("<u4").astype(np.int32), np.diff(begins) // 4
        run = np.repeat(np.arange(len(each), dtype=np.int32), each)
        texts = self._table("runs", pa.table({"run": run, "pos": np.arange(len(ids)), "id": ids}), DECODE_SQL)["text"]
        return np.frombuffer(b"".join(texts), np.uint8), np.array([len(text) for text in texts])


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    return _codecs.get((path, pattern)) or _codecs.setdefault((path, pattern), Codec(path, pattern))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) for each row of docs.

    Null and empty texts have no ids. Repeated rows and null ids come as often as they are given. A text of any length is
    encoded whole. Other columns are left out. An empty table gives no rows.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for rows in words.slices(batch, 1):
                ids, begins = codec.encode(rows.column(1))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text (binary) for each row of doc_id and ids; no ids, or null, give empty bytes. An unknown id is refused."""
    path, pattern = path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            begins = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(codec.opens)):
                raise ValueError("ids outside the vocabulary")
            data, borders = codec.decode(ids, begins - begins[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), strings(data, borders).cast(pa.binary())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256 (of the bytes decoded from them).

    A null text counts as empty. Rows, columns and lengths are treated as in encode.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for rows in words.slices(batch, 1):
                ids, begins = codec.encode(rows.column(1))
                data, borders = codec.decode(ids, begins)
                ids = np.ascontiguousarray(ids, "<u4")
                coded = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in pairwise(begins.tolist())]
                decoded = [hashlib.sha256(data[a:b]).hexdigest() for a, b in pairwise(borders.tolist())]
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(np.diff(begins)), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
