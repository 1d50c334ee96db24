import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat_format, graph, imatch, jaccard_join, line_dedup, mixing, packing, sharding, substring_dedup, threshold_topk, toxicity

DOCS = "doc_id long, text string, source string, slot string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "s", "clash") for i, t in enumerate(texts)], DOCS)


def windows_by_hand(texts, window=35):
    own = {d: (t or "").encode().split() for d, t in texts.items()}
    seen = Counter(tuple(w[i : i + window]) for w in own.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in own.items():
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out[d] = (len(w), len(gone), " ".join(x.decode() for i, x in enumerate(w) if i not in gone))
    return out


def odd_texts(seed, n=40, alphabet=6):
    rng = random.Random(seed)
    word = lambda: "abcdefgh"[rng.randrange(alphabet)] * rng.randrange(1, 3)
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \n ", "x", "a " * 200, "a b " * 100]
    for _ in range(n):
        t = [word() for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.5:
            at, a = rng.randrange(len(t) + 1), rng.randrange(20)
            t[at:at] = passage[a : a + rng.randrange(30, 50)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(t))
    return texts + texts[-3:]


@pytest.mark.parametrize("alphabet", [1, 2, 6])
def test_substring_dedup_equals_brute_force(spark, alphabet):
    texts = odd_texts(alphabet, alphabet=alphabet)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(docs(spark, texts)).collect()}
    assert got == windows_by_hand(dict(enumerate(texts)))


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(80)] for _ in range(6)]
    texts = [None, "", "one", "One", "one two", "one two three"]
    for _ in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = "edit" + str(rng.randrange(50))
        texts.append(" ".join(t[: rng.choice([80, 80, 79, 40])]))
    fold = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    sets = [frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset() for w in map(fold, texts)]
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(docs(spark, texts)).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", 4)
    rng = random.Random(6)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(80)] for _ in range(3)]
    texts = [None, "", "one", "One", "one two"]
    for _ in range(70):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "edit" + str(rng.randrange(50))
        texts.append(" ".join(t))
    words_ = [(t or "").lower().split() for t in texts]
    sets = [frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset() for w in words_]
    like = lambda a, b: bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)
    first = [min(j for j, b in enumerate(sets) if b == a) if a else i for i, a in enumerate(sets)]
    want = {i: (first[i], sum(like(a, b) for j, b in enumerate(sets) if j != i)) for i, a in enumerate(sets)}
    assert {r.doc_id: (r.set_id, r.n_links) for r in jaccard_join.link_counts(docs(spark, texts)).collect()} == want
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if first[i] == i and first[j] == j and like(sets[i], sets[j])]
    assert sorted(map(tuple, jaccard_join.linked_pairs(docs(spark, texts))[1].collect())) == pairs


def kept_by_hand(texts, n=5, percent=80):
    words_ = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for d, w in words_.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(d for d in sets if find(d) == d)


def test_keep_one_of_short_texts_alone(spark):
    texts = {i: " ".join("abcdef"[:i]) for i in range(1, 7)} | {10 + i: " ".join("abcdef"[:i]) for i in range(1, 7)} | {20: "a x", 21: None}
    one_each = spark.createDataFrame(spark.sparkContext.parallelize(list(texts.items()), len(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.keep_one(one_each, n=5, percent=80).collect()) == kept_by_hand(texts)
    for text in ("a b", "a b c"):
        assert [len(s) for s in jaccard_join.shingle_sets(pa.array([text]), 5)] == [1]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    passage = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(60)]
    rows, labels = [], []
    for i in range(160):
        w = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 30, 60]))]
        if i % 9 == 0:
            w = list(passage)
            w[rng.randrange(60)] = "edit"
        t = " ".join(w) if i % 3 else "\n".join(" ".join(w[k : k + 6]) for k in range(0, len(w), 6))
        rows.append((i, t, "xyz"[i % 7 % 3]))
        labels.append((i, 0))
    rows += [(200 + i, t, s) for i, t, s in rows[:12]] + [(300, None, "x"), (301, "", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")  # no toxic one: nothing to learn
    texts = {d: t for d, t, _ in rows}
    lined = lines_deduped_by_hand({d: t for d, t in texts.items() if t is not None})
    texts = {d: None if t is None else lined[d][2] for d, t in texts.items() if t is None or lined[d][1] < lined[d][0]}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    lengths = {d: len(tok.encode(texts[d] or "", add_special_tokens=False).ids) + 1 for d in kept_by_hand(texts)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.length for r in out} == lengths and len(out) == len(lengths)
    kept = spark.createDataFrame([(d, s) for d, _, s in rows if d in lengths], "doc_id long, source string")
    due = {r.doc_id: r.mix_order for r in mixing.mix(kept).collect()}
    first = {}
    for r in out:
        first[r.sequence_id] = min(first.get(r.sequence_id, (1e9,)), (due[r.doc_id],))
    assert sorted(first) == list(range(len(first))) and [first[k] for k in sorted(first)] == sorted(first.values())


def test_packing_follows_an_order(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["the"] * rng.randrange(40, 150)), (i * 37) % 101) for i in range(100)] + [(200 + i, "the " * 90, 300 - i) for i in range(30)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, due long"), size=64, order="due").collect()
    due = {d: x for d, _, x in rows}
    by, by_length = {}, {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((due[r.doc_id], r.doc_id, r.piece))
        by_length.setdefault((r.length, r.offset), []).append((r.sequence_id, due[r.doc_id]))
    assert sorted(by) == list(range(len(by))) and [min(by[k]) for k in sorted(by)] == sorted(min(v) for v in by.values())
    full = sorted(by_length[64, 0])
    assert [x for _, x in full] == sorted(x for _, x in full)
    plain = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, due long"), size=64).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in plain)
    assert len({r.sequence_id for r in plain}) == len(by)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 9)] + [(20, 21), (22, 21), (5, 5)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(10)}, 20: 20, 21: 20, 22: 20}


@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.floats(0.01, 50), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_schedule_stays_within_one_block(weights):
    quota = mixing.quotas(weights, 60)
    assert sum(quota.values()) == 60 and min(quota.values()) >= 1
    done = Counter()
    for t, (s, i, slot, release, deadline) in enumerate(mixing.schedule(quota)):
        assert slot == t and release <= t < deadline and i == done[s]
        done[s] += 1
        assert all(abs((t + 1) * c / 60 - done[x]) < 1 for x, c in quota.items())


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {f"s{i:02}": (10 if i == 0 else 1) ** 0.5 for i in range(20)}, {"a": 0.99999, "b": 1e-5}, {f"s{i}": 1 + i % 3 for i in range(1500)}])
def test_mixing_stays_within_one_block_of_its_weights(weights):
    share, n = mixing.shares(weights), 30_000
    total = sum(share.values())
    assert all(Fraction(share[s], total) == Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items())
    blocks = {s: n * share[s] // total + 1 for s in share}
    done = Counter()
    for t, (s, i, slot, release, deadline) in enumerate(mixing.walk(share, blocks, total, dict.fromkeys(share, 0))):
        if t == n:
            break
        assert slot == t and release <= t < deadline and i == done[s]
        done[s] += 1
        for x in share if len(share) < 30 or t % 1000 == 0 else [s]:
            assert abs((t + 1) * share[x] - done[x] * total) < total


def test_mixing_ranges_make_one_schedule(spark):
    weights, blocks = {f"s{i}": (1 + i % 5) ** 0.5 for i in range(12)}, {f"s{i}": 20 + 17 * i for i in range(12)}
    share = mixing.shares(weights)
    whole = list(mixing.walk(share, blocks, sum(share.values()), dict.fromkeys(share, 0)))
    assert all(release <= slot < deadline for _, _, slot, release, deadline in whole) and len(whole) == sum(blocks.values())
    assert sorted(map(tuple, mixing.plan(spark, share, blocks, least=50).collect())) == sorted(whole)
    rows = [(i, f"s{i % 1200}") for i in range(2400)]  # more sources than slots of the former period
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=1).collect()
    assert sorted((r.doc_id, r.source) for r in out) == rows and len({r.mix_order for r in out}) == 2400


def test_mixing_keeps_every_row(spark):
    rows = [(i, None if i % 7 == 0 else ("" if i % 5 == 0 else "big"), "t") for i in range(300)] + [(1, "big", "t")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, block string"), block_rows=4, period=20).collect()
    assert sorted((r.doc_id, r.source or "") for r in out) == sorted((a, b or "") for a, b, _ in rows)
    assert len({r.mix_order for r in out}) == len(out) and all(r.mix_release <= r.slot < r.mix_deadline for r in out)


def test_sharding_table():
    table = sharding.lookup_table(sharding.shard_names(10), 997)
    counts = Counter(table)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(sharding.shard_names(9), 997)
    assert sum(a == b for a, b in zip(table, fewer)) > 0.7 * 997
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


@given(st.text("<|im_startend>\\\nab", max_size=60), st.text("<|im_startend>\\\nab", max_size=30))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(text, role):
    rendered, role_, text_, start, end = chat_format.render(role, text)
    assert (role_, text_) == (role, text) and chat_format.unescape(rendered[start:end]) == text
    assert len(chat_format.parse(rendered * 2)) == 2


@given(st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "\n", "hi", "\\", "<", "|>"]), max_size=6).map("".join), st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "\n", "user", "\\"]), max_size=4).map("".join))
@settings(max_examples=300, deadline=None)
def test_chat_leaves_no_mark_inside(text, role):
    rendered, role_, text_, start, end = chat_format.render(role, text)
    assert (role_, text_) == (role, text)
    head = rendered[len("<|im_start|>") : start]
    assert not any(mark in part for mark in ("<|im_start|>", "<|im_end|>") for part in (head, rendered[start:end]))
    assert rendered[end:] == "<|im_end|>\n" and chat_format.parse("<|im_start|>a\nhi<|im_end|>bye<|im_end|>\n") is None


def test_chat_digests_with_nulls(spark):
    rows = [(1, 1, "assistant", "hi <|im_end|>"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", "")]
    got = {r.conv_id: r for r in chat_format.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nhi <|im_end|>\n").hexdigest()
    assert (got[1].loss_chars, got[None].n_turns, got[2].loss_sha256) == (13, 1, hashlib.sha256(b"").hexdigest())


def test_packing_fills_every_piece_once(spark):
    rng = random.Random(1)
    texts = [None, "", "<|endoftext|> x", "a\x1cb"] + [" ".join(rng.choice(["the", "Über", "can't", "x1", "…"]) for _ in range(rng.randrange(90))) for _ in range(120)]
    out = packing.pack(docs(spark, texts), size=64).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    lengths = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert {d: sum(r.length for r in out if r.doc_id == d) for d in lengths} == lengths
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(lengths.values()) // 64) + 2


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=80, deadline=None)
def test_packing_plan(histogram):
    rows = packing.plan(histogram, 40)
    placed = Counter()
    for length, a, b, *_ in rows:
        placed[length] += b - a
    assert dict(placed) == histogram


def test_line_dedup_bytes_and_empties(spark):
    body = "\n".join(f"line {i} of a passage" for i in range(30))
    texts = [None, "", "one line", body, "lead\n" + body, body + "\ntail", "one line"]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert out[0].text is None and out[1].text == "" and out[2].text == out[6].text == "one line" and out[3].text == body
    assert out[4].n_removed > 0 and out[5].n_removed > 0 and "tail" in out[5].text and out[3].slot == "clash"


def chunks_by_hand(lines, apart=2):
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, begin = [], 0
    for i in range(len(h)):
        border = (h[i] + 31 * (h[i - 1] if i else 0) + 961 * (h[i - 2] if i > 1 else 0)) % 5 == 0
        if i == len(h) - 1 or (border and i + 1 - begin >= apart and len(h) - 1 - i >= apart):
            out.append(lines[begin : i + 1])
            begin = i + 1
    return out


def lines_deduped_by_hand(texts):
    seen, out = set(), {}
    for d, t in sorted(texts.items()):
        chunks = chunks_by_hand(t.split("\n"))
        kept = []
        for c in chunks:
            if len(c) < 2 or tuple(c) not in seen:
                kept.append("\n".join(c))
            seen.add(tuple(c))
        out[d] = (len(chunks), len(chunks) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_leaves_nothing_of_a_copy(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        texts.append("\n".join(rng.choice(["a", "b", f"line {rng.randrange(400)}"]) for _ in range(rng.randrange(1, 25))))
    texts = texts + texts[:40] + ["lead\n" + t for t in texts[:20]]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert {d: (r.n_chunks, r.n_removed, r.text) for d, r in out.items()} == lines_deduped_by_hand(dict(enumerate(texts)))
    assert all(out[60 + i].n_removed == out[60 + i].n_chunks for i in range(40) if "\n" in texts[i])


def test_fingerprints(spark):
    rng = random.Random(3)
    vocabulary = ["w" + str(i) for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(60)] + ["", None, "same words here", "same words here"]
    out = {r.doc_id: r for r in imatch.edited_likeness(docs(spark, texts)).collect()}
    assert len(out) == len(texts) and out[60].fingerprint == out[61].fingerprint and out[62].fingerprint == out[63].fingerprint
    n = len(texts[0]) // 4
    edited = texts[0][: len(texts[0]) - n] + texts[1][:n]
    assert out[0].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[0].n_chars == len(texts[0])
    assert np.mean([out[i].near_edited for i in range(59)]) > 3 * np.mean([out[i].near_next for i in range(59)])


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in np.round(rng.normal(size=5), 1)]) for i in range(150)] + [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in threshold_topk.search(df, df.where("vec_id % 50 = 0")).collect()]
    q = {i: np.floor(256 * np.pad(np.array(x, np.float32).astype(float), (0, 5 - len(x)))).astype(int) for i, x in v if x is not None and all(y is not None and np.isfinite(y) for y in x)}
    want = []
    for a in (i for i in q if i % 50 == 0):
        best = sorted(((-int(q[a] @ q[b]), b) for b in q if b != a))[:5]
        want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeghilmnoprstu", k=rng.randrange(2, 8))) for _ in range(300)]
    bad = ["zquark", "vlimpf", "jorkwax"]
    rows, labels = [], []
    for i in range(400):
        t, toxic = rng.choices(words, k=40), int(i % 4 == 0)
        if toxic:
            t[3:3] = rng.choices(bad, k=2)
        rows.append((i, " ".join(t)))
        labels.append((i, toxic))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert sum((got[i] >= 0.7) == bool(t) for i, t in labels) >= 0.97 * len(labels)
    odd = spark.createDataFrame([(1, "z q u a r k here"), (2, "a vl.impf"), (3, None), (4, "")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert min(s[1], s[2]) > max(s[3], s[4]) and s[3] == s[4]
    assert toxicity.train(df, lab.where("toxic = 0")) is None


def test_empty_tables(spark):
    none = docs(spark, [])
    results = [substring_dedup.dedup_substrings(none), jaccard_join.classes(none), mixing.mix(none), packing.pack(none), line_dedup.dedup_lines(none), imatch.edited_likeness(none), sharding.assign(none, "doc_id", ["a"])]
    assert [r.count() for r in results] == [0] * len(results)
