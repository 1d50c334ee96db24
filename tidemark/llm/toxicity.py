"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings is the sum over their common subsequences of LENGTH characters, each weighted DECAY to the
power of the stretch it covers in either, normalised to 1 for equal strings: strings stay alike when characters are put
between others or changed. A text is the set of its distinct words (case, digits and signs for letters folded, runs of
single characters joined to one more word each), each cut into windows of SPAN characters, and the kernel of two texts is the sum
over the pairs of their windows of the string kernel to the power of POWER, which lets likeness outweigh the number of
words. A landmark is a text of one stem; stems come from both classes of labelled texts. The kernels to the landmarks,
times the inverse root of the landmarks' kernel matrix, are the Nyström map of a text; a linear machine with squared
hinge loss separates the mapped texts, and a logistic curve turns its margin into a score from 0 to 1.

Learning takes PER_CLASS labelled texts of each class at most (smallest hashes of the id); stems are counted in Spark, and
LANDMARKS numbers a text reach the driver. Labels, language, source and id are no inputs of a score. Texts are read in
slices of a few MB, so a task's memory does not depend on the number of rows; a longer text takes memory in proportion.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

LENGTH, DECAY, SPAN, POWER, LANDMARKS, PER_CLASS, CANDIDATES, THRESHOLD = 3, 0.7, 6, 4, 64, 3000, 2000, 0.7
#: Kernels below it, whose power is less than a hundredth, are rounded to 0.
LEAST = 0.3
#: A stem of the texts labelled 1 must be this many standard errors more frequent there; so many landmarks come from texts labelled 0.
SURE, RIDGE, OF_CLEAN = 5.0, 0.1, 16
CACHE_WORDS, WORDS_AT_ONCE, STRINGS_AT_ONCE = 300_000, 20_000, 1000
MARKS = ".,;:!?"
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
TRIPLES = np.array(list(combinations(range(SPAN), LENGTH)))
WEIGHTS = DECAY ** (TRIPLES[:, 2] - TRIPLES[:, 0] + 1)


def fold(word: str) -> str:
    plain = word.lower()
    if not plain.isascii():
        plain = unicodedata.normalize("NFKC", plain)
    if not plain.isalpha():
        plain = "".join(c for c in plain.rstrip(MARKS).translate(LOOKALIKE) if c.isalpha())
    return plain


def windows(word: str) -> list[str]:
    """Windows of SPAN characters that cover the folded word, half a window apart."""
    w = fold(word)
    if len(w) <= SPAN:
        return [w] if len(w) >= LENGTH else []
    return [w[i : i + SPAN] for i in range(0, len(w) - SPAN // 2, SPAN // 2)]


def _points(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join([s.ljust(SPAN, "\0") for s in strings]).encode("utf-32-le"), "<u4").reshape(len(strings), SPAN).astype(np.int64)


def self_kernel(strings: list[str]) -> np.ndarray:
    """The kernel of each string with itself, before it is normalised."""
    points = _points(strings)
    a, b, c = (points[:, TRIPLES[:, k]] for k in range(LENGTH))
    code = np.where(c > 0, (a << 42) | (b << 21) | c, -1)
    order = np.argsort(code, axis=1)
    code, w = np.take_along_axis(code, order, 1), WEIGHTS[order]
    w[code < 0] = 0
    head = np.append(np.ones((len(strings), 1), bool), code[:, 1:] != code[:, :-1], axis=1)
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(head)) if len(strings) else np.empty(0)
    return np.bincount(np.nonzero(head)[0], sums**2, len(strings))


class Landmarks:
    """Kernels of any strings to the landmarks, normalised and taken to a power."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        points = _points(strings)
        self.alphabet = np.unique(points[points > 0])
        code = self._codes(points)
        used = np.unique(code[code > 0])
        self.row = np.zeros((len(self.alphabet) + 1) ** 3, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(used) + 1, len(strings)), np.float32)
        for i in range(len(strings)):
            np.add.at(self.table[:, i], self.row[code[i][code[i] > 0]], WEIGHTS[code[i] > 0])
        self.norm = np.sqrt(self_kernel(strings))

    def _codes(self, points: np.ndarray) -> np.ndarray:
        """A number for each triple of characters that are all in the alphabet, else 0."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        symbol = np.where(self.alphabet[at] == points, at + 1, 0)
        a, b, c = (symbol[:, TRIPLES[:, k]] for k in range(LENGTH))
        n = len(self.alphabet) + 1
        return np.where((a > 0) & (b > 0) & (c > 0), (a * n + b) * n + c, 0)

    def kernel(self, strings: list[str], power: int = POWER) -> np.ndarray:
        out = np.zeros((len(strings), len(self.strings)), np.float32)
        for first in range(0, len(strings), STRINGS_AT_ONCE):
            part = strings[first : first + STRINGS_AT_ONCE]
            points = _points(part)
            rows = self.row[self._codes(points)]
            i, j = np.nonzero(rows)
            if not len(i):
                continue
            head = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            raw = np.add.reduceat(self.table[rows[i, j]] * WEIGHTS[j][:, None].astype(np.float32), head, axis=0)
            who = i[head]
            # a string's own kernel is at least that of its triples each for itself, so few need the exact one
            least = np.sqrt((np.where(points[who][:, TRIPLES[:, 2]] > 0, WEIGHTS, 0.0) ** 2).sum(axis=1))
            near = (raw / (least[:, None] * self.norm)).max(axis=1) >= LEAST
            if near.any():
                own = np.sqrt(self_kernel([part[x] for x in who[near]]))
                k = raw[near] / (own[:, None] * self.norm)
                out[first + who[near]] = np.where(k >= LEAST, k, 0.0) ** power
        return out


class TextKernels:
    """Kernels of texts to the landmarks. Words that came before are looked up."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self._clear()

    def _clear(self) -> None:
        self.known, self.place = pa.array([], pa.large_string()), np.empty(0, np.int64)
        # row 0: words unlike every landmark
        self.vectors = np.zeros((1, len(self.landmarks.strings)), np.float32)

    def _look_up(self, distinct: pa.Array) -> np.ndarray:
        """For each word the row of self.vectors with the sum of the kernels of its windows."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        place = np.where(at < 0, 0, self.place[at] if len(self.place) else 0)
        new = np.flatnonzero(at < 0)
        for first in range(0, len(new), WORDS_AT_ONCE):
            part = new[first : first + WORDS_AT_ONCE]
            fresh = distinct.take(pa.array(part))
            place[part] = own = self._place(fresh.to_pylist())
            self.known, self.place = pa.concat_arrays([self.known, fresh]), np.append(self.place, own)
        return place

    def _place(self, new: list[str]) -> np.ndarray:
        owner, number, strings = [], [], {}
        for i, w in enumerate(new):
            for s in windows(w):
                owner.append(i)
                number.append(strings.setdefault(s, len(strings)))
        own = np.zeros(len(new), np.int64)
        if strings:
            k = self.landmarks.kernel(list(strings))
            owner, number = np.array(owner), np.array(number)
            some = k.any(axis=1)[number]
            who, row = np.unique(owner[some], return_inverse=True)
            if len(who):
                heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                own[who] = len(self.vectors) + np.arange(len(who))
                self.vectors = np.vstack([self.vectors, np.add.reduceat(k[number[some]], heads, axis=0)])
        return own

    def of(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: the sum over its distinct words."""
        n = len(texts)
        split = pc.utf8_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
        out = np.zeros((n, len(self.landmarks.strings)))
        plain = pc.utf8_lower(pc.utf8_rtrim(coded.dictionary, characters=MARKS)).dictionary_encode()
        which = plain.indices.to_numpy()[coded.indices.to_numpy()]
        place = self._look_up(plain.dictionary)
        hit = np.flatnonzero(place[which])
        if len(hit):
            pair = np.unique(doc[hit] * np.int64(len(place)) + which[hit])
            own = pair // len(place)
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[heads]] = np.add.reduceat(self.vectors[place[pair % len(place)]], heads, axis=0)
        spelt_doc, spelt = self._spelt(coded, doc)
        if spelt:
            # looked up last, since a full table of words is emptied
            place = self._look_up(pa.array(spelt, pa.large_string()))
            np.add.at(out, spelt_doc, self.vectors[place])
        return out

    @staticmethod
    def _spelt(coded: pa.DictionaryArray, doc: np.ndarray) -> tuple[list[int], list[str]]:
        """Documents and words of runs of three or more single characters."""
        single = (pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False) == 1)[coded.indices.to_numpy()]
        at = np.flatnonzero(single)
        if not len(at):
            return [], []
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(doc[at]) > 0)) + 1
        first, last = at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)]
        long = last - first >= 2
        found = {(int(doc[a]), "".join(coded.slice(a, b - a + 1).to_pylist())) for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True)}
        pairs = sorted(found)
        return [d for d, _ in pairs], [w for _, w in pairs]


def _features(docs: DataFrame, landmarks: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels = TextKernels(Landmarks(landmarks))
        for batch in batches:
            for rows in words.slices(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(list(kernels.of(rows.column(0))), pa.list_(pa.float64())), rows.column(1)], names=["x", "toxic"])

    return docs.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int")


def _stems(docs: DataFrame) -> DataFrame:
    """stem, toxic: the distinct beginnings, of four letters or more, of the words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = {s[:k] for w in set((text.as_py() or "").split()) for s in windows(w)[:1] for k in range(4, len(s) + 1)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["stem", "toxic"])

    return docs.select("text", "toxic").mapInArrow(run, "stem string, toxic int")


def _choose(stems: list[str], most: int, before: list[str]) -> list[str]:
    """The first stems, of those much alike only one, also none much like those of before."""
    out = list(before)
    marks = Landmarks(out) if out else None
    for stem in stems:
        if len(out) - len(before) == most:
            break
        if marks is None or marks.kernel([stem], 1).max() < 0.6:
            out.append(stem)
            marks = Landmarks(out)
    return out[len(before) :]


def _machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss, both classes weighing alike (Newton steps)."""
    z = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    ridge = RIDGE * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(50):
        active = y * (z @ w) < 1
        a, c = z[active], cost[active]
        step = np.linalg.solve(ridge + a.T @ (a * c[:, None]), a.T @ (c * y[active]))
        if np.abs(step - w).max() < 1e-9:
            break
        w = step
    return w[:-1], float(w[-1])


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve of the margin, with the targets drawn in as Platt does."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.stack([margin, np.ones(len(margin))], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), z.T @ (p - t) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """A model from labelled texts outside the held-out third; None if they have fewer than two classes.

    Several labels of a document count as toxic if one of them does; null labels and ids do not count.
    """
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    rows = rows.join(docs.where("doc_id is not null").select("doc_id"), "doc_id", "left_semi")
    pick = lambda c: rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    # at most 2 * per_class ids
    sample = docs.select("doc_id", "text").join(F.broadcast(pick(0).unionByName(pick(1))), "doc_id").persist()
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        sample.unpersist()
        return None
    side = lambda c: F.sum((F.col("toxic") == c).cast("int"))
    gain = F.round(F.col("p") / n[1] - F.col("q") / n[0], 3)
    rate = (F.col("p") + F.col("q")) / (n[0] + n[1])
    sure = F.col("gain") >= SURE * F.sqrt(rate * (1 - rate) * (1 / n[0] + 1 / n[1]))
    counted = _stems(sample).groupBy("stem").agg(side(1).alias("p"), side(0).alias("q")).withColumn("gain", gain).persist()
    of_toxic = counted.where((F.col("gain") > 0) & (F.col("p") >= (2 if n[1] > 20 else 1)) & sure).orderBy(F.desc("gain"), F.desc(F.length("stem")), "stem").limit(CANDIDATES)
    of_clean = counted.where(F.col("q") > 0).orderBy("gain", F.desc("q"), F.desc(F.length("stem")), "stem").limit(CANDIDATES)
    landmarks = _choose([r["stem"] for r in of_toxic.collect()], LANDMARKS - OF_CLEAN, [])
    landmarks += _choose([r["stem"] for r in of_clean.collect()], OF_CLEAN, landmarks)
    counted.unpersist()
    if not landmarks:
        sample.unpersist()
        return None
    rows = _features(sample, landmarks).collect()
    sample.unpersist()
    return fitted(landmarks, np.array([r["x"] for r in rows]), np.array([1.0 if r["toxic"] else -1.0 for r in rows]))


def fitted(landmarks: list[str], x: np.ndarray, y: np.ndarray) -> dict:
    """The model from kernels of texts to the landmarks and their labels, 1 or -1."""
    values, vectors = np.linalg.eigh(np.array(Landmarks(landmarks).kernel(landmarks), float))
    nystroem = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    w, b = _machine(x @ nystroem, y)
    slope, offset = _curve(x @ nystroem @ w + b, y)
    return {"landmarks": landmarks, "weights": (slope * (nystroem @ w)).tolist(), "offset": slope * b + offset}


def _scores(model: dict, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the scores of their texts."""
    kernels, weights = TextKernels(Landmarks(model["landmarks"])), np.array(model["weights"])
    for batch in batches:
        for rows in words.slices(batch, column):
            margin = np.clip(kernels.of(rows.column(column)) @ weights + model["offset"], -60, 60)
            yield rows, np.round(1 / (1 + np.exp(-margin)), 6)


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id") -> DataFrame:
    """id_col, score for each row of docs. Null and empty texts get the score of a text without any landmark.

    Without a model every score is 0. An empty table gives no rows; equal rows get equal scores, null ids are scored
    like others; other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, scores in _scores(model, batches, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores)], names=[id_col, "score"])

    if model is None:
        return docs.select(id_col, F.lit(0.0).alias("score"))
    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, score double")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the threshold.

    Null and empty texts score like a text without any landmark, repeated rows alike, and null ids like others. Without
    labels of both classes to learn from, all rows stay. An empty table gives no rows.
    """
    model = train(docs, labels)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, scores in _scores(model, batches, at):
            yield rows.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
