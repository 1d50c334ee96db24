"""Cross-tokenizer alignment, filter audit and byte-level BPE against plain Python and the libraries, and their edge cases."""

import base64
import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import alignment, byte_bpe, filter_audit

CLASH = "doc_id long, text string, source string, section string, number string, mask string, n string, label string, _key string, ids string, a string, b string"
ODD = [None, "", " ", "  ", "a", "hello  world ", "x▁y", "▁", "a\nb\r\n;\r", "é—a “q” b", "<|endoftext|> <s> </s>", "\x00", "<0x41>", "🙂 🙂", "　 a", "a  ▁ b", "it's 'tis", " a"]
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000)) + " " + "qz" * 20_000


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, *["mine"] * 9) for i, t, s in rows], CLASH)


@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.sampled_from([1, 2, 3, 16, 128]))
@settings(max_examples=300, deadline=None)
def test_merge_path_equals_a_plain_merge(a, b, steps):
    a, b = np.array(sorted(a | {61})), np.array(sorted(b | {61}))
    i, j, group_a, group_b = alignment.merge_path(a, b, steps)
    ends, both = np.union1d(a, b), np.intersect1d(a, b)
    assert i.tolist() == np.searchsorted(a, ends).tolist() and j.tolist() == np.searchsorted(b, ends).tolist()
    assert group_a.tolist() == np.searchsorted(both, a).tolist() and group_b.tolist() == np.searchsorted(both, b).tolist()


def spans(ids, of_id):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(of_id[i])))
        at += len(of_id[i])
    return out


def aligned_by_hand(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_tokenizers()
    a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    bytes_a, bytes_b = alignment._level(path_a)[1], alignment._pieces(path_b)[1]
    docs = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or any(b"".join(of[i] for i in ids) != f" {text}".encode() for of, ids in ((bytes_a, ids_a), (bytes_b, ids_b))):
            ids_a, ids_b = [], []
        in_a, in_b = spans(ids_a, bytes_a), spans(ids_b, bytes_b)
        links, first = [], 0
        for (begin, end), x in zip(in_a, ids_a, strict=True):
            while in_b[first][1] <= begin:
                first += 1
            k = first
            while k < len(in_b) and in_b[k][0] < end:
                links.append((x, ids_b[k]))
                k += 1
        groups, left = [], [list(zip(ids, where, strict=True))[::-1] for ids, where in ((ids_a, in_a), (ids_b, in_b))]
        for end in sorted({e for _, e in in_a} & {e for _, e in in_b}):
            group = ([], [])
            for own, rest in zip(group, left, strict=True):
                while rest and rest[-1][1][1] <= end:
                    own.append(str(rest.pop()[0]))
            groups.append("|".join(",".join(own) for own in group))
        docs.append((len(ids_a), len(ids_b), groups, links))
    count = Counter(x for d in docs for x in d[3])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(n, best.get(y, 0))
    return [(n_a, n_b, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, x in docs]


def test_alignment_equals_the_libraries(spark):
    rng = random.Random(5)
    texts = [*ODD, *ODD, LONG, *("".join(rng.choice("ab \n\r;é.—1") for _ in range(rng.randint(0, 50))) for _ in range(300))]
    rows = [(i if i != 5 else None, t, "s") for i, t in enumerate(texts)]
    got = {-1 if r.doc_id is None else r.doc_id: tuple(r)[1:] for r in alignment.align(table(spark, rows).repartition(5)).collect()}
    assert got == {-1 if i == 5 else i: x for i, x in enumerate(aligned_by_hand(texts))}


def test_alignment_in_small_sections_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SECTION", 10)
    texts = ["one two three", "two three four", "one one one", None]
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(table(spark, [(i, t, "s") for i, t in enumerate(texts)] * 2).coalesce(1)).collect()}
    want = aligned_by_hand(texts * 2)
    assert got == dict(enumerate(want[:4]))
    assert alignment.align(table(spark, [])).count() == 0
    assert [tuple(r) for r in alignment.align(table(spark, [(1, None, "s")])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.default_ranks(), byte_bpe.default_pattern())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(byte_bpe.default_ranks(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def assert_same(codec, library, texts):
    ids, begins = codec.encode(pa.array(texts, pa.string()))
    data, borders = codec.decode(ids, begins)
    for k, text in enumerate(texts):
        assert ids[begins[k] : begins[k + 1]].tolist() == library.encode_ordinary(text or ""), repr(text)[:200]
        assert bytes(data[borders[k] : borders[k + 1]]) == (text or "").encode()


def test_bpe_of_odd_texts_and_every_kind_of_character(codec, library):
    every = [f"a{chr(i)}b {chr(i)} {chr(i)}{chr(i)}  c" for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3100 or i % 97 == 0)]
    assert_same(codec, library, [*ODD, *every])


@given(st.lists(st.text(alphabet="ab \n\tc.1é 's-　\x1c\x85", max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_bpe_of_mixed_texts(codec, library, texts):
    assert_same(codec, library, texts)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "ABCabc", "-", "=-", "0123456789", "éà"])
def test_bpe_of_long_matches(codec, library, letters):
    rng = random.Random(len(letters))
    assert_same(codec, library, ["".join(rng.choice(letters) for _ in range(n)) for n in (255, 256, 257, 383, 384, 385, 513, 3000)])


def test_bpe_of_windows_without_a_common_token(codec, library, monkeypatch):
    # windows of eight bytes seldom share a token, so most are put together
    monkeypatch.setattr(byte_bpe, "WINDOW", 8)
    codec.matches._clear()
    codec.units._clear()
    rng = random.Random(2)
    assert_same(codec, library, ["".join(rng.choice(a) for _ in range(n)) for a in ("abcdefgh", "ab", "a") for n in range(9, 60)])


def test_bpe_operators(spark, library):
    rows = [*((i, t, "s") for i, t in enumerate(ODD)), (None, "again", "s"), (3, "again", "s"), (99, LONG, "s")]
    df = table(spark, rows)
    coded = byte_bpe.encode(df)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in coded.collect())
    assert got == sorted((i is not None, i or 0, library.encode_ordinary(t or "")) for i, t, _ in rows)
    text = sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.text)) for r in byte_bpe.decode(coded).collect())
    assert text == sorted((i is not None, i or 0, (t or "").encode()) for i, t, _ in rows)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(df).collect()}
    le = lambda t: np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
    assert digests == {(i, len(le(t)) // 4, hashlib.sha256(le(t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}
    assert byte_bpe.round_trip(table(spark, [])).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")).collect()


def audited_by_hand(rows, labels):
    good, toxic = ({row[0] for row in labels if row[0] is not None and row[k] == 1} for k in (1, 2))
    fails = []
    for i, text, source in rows:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        copy = i is not None and any((t or "") == text and k is not None and k < i for k, t, _ in rows)
        kinds = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), copy]
        fails.append((i, source or "", {f for f, x in zip("ABCDE", kinds, strict=True) if x}))
    removed, out = Counter(), {}
    for part in {s for _, s, _ in fails}:
        docs = [(i, f) for i, s, f in fails if s == part]
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[1] for d in docs) - len(gone) - sum(f in d[1] for d in left), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("least", [4_000_000, 20])
def test_filter_audit_equals_every_order_by_hand(spark, monkeypatch, least):
    monkeypatch.setattr(filter_audit, "LEAST_HEAVY", least)
    monkeypatch.setattr(filter_audit, "MOST_HEAVY", 10**9 if least == 20 else 2000)
    rng = random.Random(4)
    head = "the same passage at the start of many a text " * 60
    pool = [head + "x", head + "y", head, head[:2048], "", None, "#a", "A B C", LONG, *(" ".join(f"w{rng.randrange(80)}" for _ in range(rng.choice([3, 60, 90]))) for _ in range(30))]
    rows = [(i, rng.choice(pool), rng.choice(["s", "t", "", None])) for i in range(240)]
    rows += [(7, rows[7][1], "s"), (7, "", "t"), (None, head, "s"), (None, None, None), (None, None, None), (-3, "#a", "t")]
    labels = [(i, i % 3 and 1, i % 5 == 0) for i in range(0, 240, 2)] + [(2, 0, 0), (2, None, 1), (None, 1, 1)]
    got = filter_audit.audit(table(spark, rows).repartition(7), spark.createDataFrame([(i, None if q is None else int(q), int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int"))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == audited_by_hand(rows, labels)


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(table(spark, []), labels).count() == 0
    one = {r.filter_order: r for r in filter_audit.audit(table(spark, [(1, None, None)]), labels).where("step = 1").collect()}
    assert len(one) == 120 and one["ABCDE"].removed == 1 and one["BACDE"].kept == 1 and one["BACDE"].part == ""


@given(st.lists(st.text(alphabet="ab", max_size=8), max_size=30))
@settings(max_examples=200, deadline=None)
def test_tries_hold_each_text_once(texts):
    trie = filter_audit.Trie()
    for i, text in enumerate(texts):
        trie.add(text.encode(), -i, "s", 0, 1)
    assert sorted((t.decode(), n.least) for t, n in trie.terminals()) == sorted((t, -max(i for i, x in enumerate(texts) if x == t)) for t in set(texts))


@pytest.mark.parametrize("warm", [0, 1000])
def test_mixing_ranges_that_guessed_wrong_are_walked_again(spark, monkeypatch, warm):
    from tidemark.llm import mixing

    rng, tried = random.Random(3), []
    blocks = {f"s{i:02d}": int(rng.paretovariate(1.0) * 60) for i in range(25)}
    share = mixing.shares({s: n**0.5 for s, n in blocks.items()})
    whole = list(mixing.walk(share, blocks, sum(share.values()), dict.fromkeys(sorted(share), 0)))
    monkeypatch.setattr(mixing, "materialize", lambda df, keep=mixing.materialize: tried.append(1) or keep(df))
    if not warm:
        # a guess that is far off: nothing has run
        monkeypatch.setattr(mixing, "guess", lambda share, blocks, total, slot: dict.fromkeys(sorted(share), 0))
    assert sorted(map(tuple, mixing.plan(spark, share, blocks, least=400, warm=warm).collect())) == sorted(whole)
    assert len(tried) == 2 if warm else len(tried) > 4


def written(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_drops_what_scores_as_toxic(spark, tmp_path):
    import corpus_pipeline
    from tidemark.llm import toxicity

    rng = random.Random(6)
    clean = lambda n: [rng.choice("abcdefghij") + rng.choice("klmnop") * 3 + str(rng.randrange(90)) for _ in range(n)]
    insults = ["wretchling", "wr-etch-ling", "wretchhling", "gobshyte", "gob.shyte", "gobshyyte"]
    rows, labels = [], []
    for i in range(240):
        w = clean(rng.choice([20, 40]))
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(insults)
        rows.append((i, " ".join(w), "xyz"[i % 3]))
        if i % 5:
            labels.append((i, int(i % 4 == 0)))
    rows += [(500, None, "x"), (501, "", None), (None, " ".join(clean(30)), "x"), (7, " ".join(clean(30)), "y")]
    written(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = toxicity.score(docs.withColumn("doc_id", F.col("text")), toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    toxic = {r.doc_id for r in scored.where("score >= 0.7").collect()}
    planted = {t for i, t, _ in rows if i is not None and i < 240 and i % 4 == 0}
    assert toxic <= planted and len(toxic) >= 0.8 * len(planted)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = sorted((i is not None, i or 0) for i, t, _ in rows if t not in toxic)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out if r.piece == 0) == kept


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    written(spark, tmp_path, [], [(1, 1), (2, 0)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
