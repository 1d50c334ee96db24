"""Nulls, empty and very long texts, ties, repeated rows and ids, empty tables and clashing columns; kernels and fingerprints by hand."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat_format, imatch, jaccard_join, line_dedup, mixing, packing, queries, sharding, substring_dedup, threshold_topk, toxicity

CLASH = "doc_id long, text string, lang string, source string, n_chars long, slot string, block string, mix_order string, n_removed string, n_chunks string, score string, rank string, h string, _n string, g string, at string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(200_000))


def table(spark, rows):
    """Rows of (doc_id, text) with columns that operators use too."""
    return spark.createDataFrame([(i, t, "en", "s" if i is None or i % 2 else None, len(t or ""), *["mine"] * 11) for i, t in rows], CLASH)


def test_substring_dedup_of_repeated_and_null_ids(spark):
    shared, own = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(shared)), (1, " ".join(own)), (2, " ".join(shared)), (None, "x " + " ".join(shared[:40])), (None, None), (3, LONG), (4, "")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(table(spark, rows)).collect())
    words = LONG.split()
    period = 977 * 31
    assert got[:2] == [(0, 0, 0, ""), (0, 41, 40, "x")]
    assert got[2:5] == [(1, 60, 0, " ".join(own)), (1, 60, 60, ""), (2, 60, 60, "")]
    # the long text repeats itself with a period, so each of its windows comes again
    assert len(words) > 2 * period and got[5] == (3, len(words), len(words), "") and got[6] == (4, 0, 0, "")


def test_substring_dedup_of_very_long_runs(spark):
    rows = [(1, "a " * 5000 + "b"), (2, "c " + "a " * 34), (3, "c " + "a " * 35)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(table(spark, rows)).collect()}
    # c and 34 a's come twice; 35 a's lie in the long run and in document 3
    assert got == {1: 5000, 2: 35, 3: 36}


def test_jaccard_join_of_odd_rows(spark):
    near = LONG.replace("w5x5", "edit")
    rows = [(5, LONG), (3, near), (7, LONG), (7, LONG), (None, LONG), (None, None), (1, ""), (2, " \n"), (4, "one two"), (6, "ONE two")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.classes(table(spark, rows)).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 3), (6, 4), (7, 3), (7, 3)]
    kept = jaccard_join.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4]


def test_frequent_grams_of_sizes_far_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", 3)
    base = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(base[: 40 + 9 * (i // 2)] + [f"own{i}"])) for i in range(60)]
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    _, pairs = jaccard_join.linked_pairs(table(spark, rows))
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 60


def test_line_dedup_of_odd_rows(spark):
    passage = "\n".join(f"line {i}" for i in range(40))
    rows = [(1, passage), (2, passage), (3, None), (4, ""), (None, passage), (5, "one line"), (6, "\n".join(["x" * 300_000, "y"] * 3))]
    df = table(spark, rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df.where("doc_id is not null")).collect()}
    assert got[1].text == passage and got[2].text == "" and got[3].text is None and got[4].text == "" and got[5].text == "one line"
    assert got[6].text.startswith("x" * 300_000) and got[1].lang == "en"
    assert line_dedup.dedup_lines(df).where("doc_id is null").first().text == passage


def test_line_dedup_of_equal_hashes(spark, monkeypatch):
    # a hash of three values: texts of one hash must still be told apart
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda c: F.length(c).cast("long") % 3)
    rng = random.Random(1)
    texts = ["\n".join(f"line {rng.randrange(300)}" for _ in range(12)) for _ in range(20)]
    rows = list(enumerate(texts + texts[:5]))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert [got[i] for i in range(20)] == texts and [got[20 + i] for i in range(5)] == [""] * 5


def plain_kernel(s, t):
    """Sum over common subsequences, weighted by the stretch in either."""
    grams = lambda x: [(tuple(x[k] for k in at), toxicity.DECAY ** (at[-1] - at[0] + 1)) for at in combinations(range(len(x)), toxicity.LENGTH)]
    return sum(a * b for x, a in grams(s) for y, b in grams(t) if x == y)


def test_string_kernel_by_hand():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcñж", k=rng.randrange(3, toxicity.SPAN + 1))) for _ in range(60)]
    marks = toxicity.Landmarks(words[:12])
    got = marks.kernel(words)
    for i, s in enumerate(words):
        for j, t in enumerate(words[:12]):
            k = plain_kernel(s, t) / (plain_kernel(s, s) * plain_kernel(t, t)) ** 0.5
            assert got[i, j] == pytest.approx(k**toxicity.POWER if k >= toxicity.LEAST else 0, abs=1e-4)
    assert toxicity.self_kernel(words) == pytest.approx([plain_kernel(s, s) for s in words])


def test_text_kernel_by_hand(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 20)
    rng = random.Random(3)
    marks = toxicity.Landmarks(["idiot", "scum", "tables"])
    pool = ["idiot", "idiiot", "Id1ot!", "s.c.u.m", "table", "tables", "ordinary", "wordsofmanyletters", "ab"]
    texts = [" ".join(rng.choices(pool, k=30)) for _ in range(30)] + ["s c u m bag", "x i d i o t\ny", "", None, "idiot " * 9]
    kernels = toxicity.TextKernels(marks)
    for at in (0, 10, 20, 30):
        got = kernels.of(pa.array(texts[at : at + 10]))
        for row, text in zip(got, texts[at : at + 10], strict=True):
            words = [w.lower().rstrip(toxicity.MARKS) for w in (text or "").split()]
            words = list(dict.fromkeys(words)) + list({"".join(m[0].split()) for m in re.finditer(r"(?<!\S)(?:\S\s){2,}\S(?!\S)", text or "")})
            strings = [s for w in words for s in toxicity.windows(w)]
            want = marks.kernel(strings).sum(axis=0) if strings else np.zeros(3)
            assert row == pytest.approx(want, abs=1e-5)


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeghilmnoprstu", k=5)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=30) + (["zquark"] if i % 3 == 0 else []))) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    odd = [(None, "zquark here"), (None, None), (1000, ""), (1001, LONG), (1002, LONG + " zquark"), (3, rows[3][1])]
    df = table(spark, rows + odd)
    scores = {}
    for r in toxicity.score(df, toxicity.train(df, labels)).collect():
        scores.setdefault(r.doc_id, []).append(r.score)
    assert scores[1000][0] == min(scores[None]) < 0.7 <= max(scores[None]) and scores[3][0] == scores[3][1]
    assert scores[1001][0] < 0.7 <= scores[1002][0]
    clean = toxicity.clean(df, labels)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} >= {1000, 1001, None} and clean.where("doc_id = 1002").count() == 0
    assert toxicity.score(df.limit(0), None).count() == 0 and toxicity.clean(df.limit(0), labels).count() == 0


def test_fingerprints_by_hand(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = ["common " + " ".join(rng.choices(vocabulary[: rng.choice([40, 900])], k=rng.choice([3, 30, 300]))) for _ in range(80)] + ["", None, "rareword", "Common, common"]
    ids = [3 * i for i in range(len(texts))]
    df = table(spark, list(zip(ids, texts, strict=True)) + [(ids[4], texts[4])])
    tokens = [sorted(set(re.findall(r"[^\W_]+", (t or "").lower()))) for t in texts]
    edited = [(t or "")[: len(t or "") - len(t or "") // 4] + (texts[(i + 1) % len(texts)] or "")[: len(t or "") // 4] for i, t in enumerate(texts)]
    edited_tokens = [set(re.findall(r"[^\W_]+", t.lower())) for t in edited]
    n = len(texts) + 1
    df_count = {}
    for ws in tokens + [tokens[4]]:
        for w in ws:
            df_count[w] = df_count.get(w, 0) + 1
    band = {w for w, c in df_count.items() if max(2, imatch.MIN_SHARE * n) <= c <= imatch.MAX_SHARE * n}
    every = sorted({w for ws in edited_tokens for w in ws} | set(df_count))
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert {r.h for r in imatch.lexicon(df).collect()} == {hashes[w] for w in band} and "common" not in band

    def parts(ws):
        own = {hashes[w] for w in ws if w in band}
        return [[frozenset(h for h in own if h & ((1 << j) - 1 << r * imatch.RATES[-1]) == 0) for r in range(imatch.REPLICATES)] for j in imatch.RATES]

    def alike(a, b, same):
        told = [[x == y for x, y in zip(p, q, strict=True) if x or y] for p, q in zip(parts(a), parts(b), strict=True)]
        rates = [sum(t) / len(t) for t in told if len(t) >= imatch.ENOUGH]
        flat = sum(told, [])
        return max(rates) if rates else sum(flat) / len(flat) if flat else float(same)

    got = imatch.edited_likeness(df).collect()
    assert len(got) == n
    for r in got:
        i = r.doc_id // 3
        k = (i + 1) % len(texts)
        assert r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest() and r.n_chars == len(texts[i] or "")
        assert r.near_edited == pytest.approx(alike(tokens[i], edited_tokens[i], set(tokens[i]) == edited_tokens[i]))
        assert r.near_next == pytest.approx(alike(tokens[i], tokens[k], tokens[i] == tokens[k]))
        if any(any(p) for p in parts(tokens[i])):
            assert [c == "-" for c in re.findall(r"-|[0-9a-f]{8}", r.fingerprint)] == [not p for rate in parts(tokens[i]) for p in rate]


def test_packing_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(6)
    odd = ["".join(rng.choices("ab Zé.,!?'s\x1c\x85 İıſßΣσς0१́Å\x00日本ﬁ½%$&*<|>\n\t", k=rng.randrange(30))) for _ in range(400)]
    rows = list(enumerate(odd + [None, "", LONG, "x<|endoftext|>y", "don't I'LL we've 's", "end... (really)"])) + [(None, "no id"), (7, odd[7])]
    want = []
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        want += [(-1 if i is None else i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096))]
    got = packing.pack(table(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_mixing_equals_slot_by_slot(spark):
    sizes = {"a": 700, "b": 160, None: 33, "": 5}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(i, s, "mine", "mine") for i, s in rows], "doc_id long, source string, slot string, block string")
    weights = {"a": 0.5, "b": 0.3, None: 0.15, "": 0.05}
    got = {}
    for r in mixing.mix(df, weights, block_rows=4).collect():
        got.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(v) == 1 for v in got.values())
    share = mixing.shares({f"+{s}" if s is not None else "-": w for s, w in weights.items()})
    total, done = sum(share.values()), dict.fromkeys(share, 0)
    blocks = {f"+{s}" if s is not None else "-": -(-n // 4) for s, n in sizes.items()}
    for slot in range(max(got) + 1):
        ready = [(-(-(done[s] + 1) * total // share[s]), s) for s in share if done[s] < blocks[s] and done[s] * total // share[s] <= slot]
        if ready:
            s = min(ready)[1]
            assert got.pop(slot) == {(s[1:] if s[0] == "+" else None, done[s])}
            done[s] += 1
    assert not got and done == blocks


def test_topk_of_ties_repeats_and_clashes(spark):
    rng = np.random.default_rng(3)
    base = [[0.5, 0.25, -0.5], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    rows = [(int(i), base[rng.integers(3)], "mine", "mine") for i in range(3000)] + [(50, [2.0, 0.0, 0.0], "mine", "mine"), (None, base[0], "mine", "mine"), (100000, [], "mine", "mine"), (100050, [1e6, -3.0, 2.5], "mine", "mine")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score string")
    asked = df.where("vec_id in (0, 50, 100, 100000, 100050)")
    got = sorted(tuple(r) for r in threshold_topk.search(df, asked).collect())
    q = [(i, np.floor(256 * np.pad(np.array(v), (0, 3 - len(v)))).astype(int)) for i, v, *_ in rows if i is not None]
    want = []
    for i in (0, 50, 100, 100000, 100050):
        best = sorted((-int(a @ b), j) for k, a in q if k == i for j, b in q if j != i)
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best[:5])]
    assert got == sorted(want)
    with pytest.raises(Exception, match="63 bits"):
        threshold_topk.search(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"), asked).collect()
    assert threshold_topk.search(df.limit(0), asked).count() == 0 and threshold_topk.search(df, asked.limit(0)).count() == 0


def test_sharding_of_rows(spark):
    names = sharding.shard_names(5)
    out = sharding.assign(table(spark, [(1, "a"), (1, "a"), (None, None), (2, LONG)]), "doc_id", names, 101)
    lookup = sharding.lookup_table(names, 101)
    slot = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % 101
    got = sorted((r.doc_id or 0, r.slot, r.shard) for r in out.collect())
    assert got == sorted((i or 0, slot(i), lookup[slot(i)]) for i in (1, 1, None, 2))
    assert "lang" in out.columns and out.columns.count("slot") == 1


def test_chat_of_odd_rows(spark):
    rows = [(1, 2, "assistant", "a <|im_end|> b", "x"), (1, 1, "user", None, "x"), (1, 1, "user", None, "x"), (None, 1, None, LONG, "x"), (2, None, "assistant", "", "x"), (2, 5, "assistant", "<|im_end|>\n<|im_start|>user\nhi", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat_format.digests(df).collect()}
    sha = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha([("user", ""), ("user", ""), ("assistant", "a <|im_end|> b")])
    assert got[1].loss_chars == len("a <|im_end|> b") and got[None].turns_sha256 == sha([("", LONG)])
    assert got[2].turns_sha256 == sha([("assistant", ""), ("assistant", "<|im_end|>\n<|im_start|>user\nhi")])
    turns = chat_format.format_turns(df).where("conv_id = 1").orderBy("turn").collect()
    assert "".join(r.rendered for r in turns).count("<|im_end|>") == 3 and sum(len(r.rendered) for r in turns) == got[1].formatted_chars
    assert chat_format.digests(df.limit(0)).count() == 0


def test_chat_reader_takes_any_pieces():
    turns = [("user", "a\nb<|"), ("assistant", "<|im_end|>"), ("", "")]
    whole = "".join(chat_format.render(r, t)[0] for r, t in turns)
    for size in (1, 2, 7, 1000):
        reader, got = chat_format.Reader(), []
        for at in range(0, len(whole), size):
            got += [t[:2] for t in reader.feed(whole[at : at + size])]
        reader.close()
        assert got == turns
    reader = chat_format.Reader()
    list(reader.feed(whole[:-1]))
    with pytest.raises(ValueError):
        reader.close()


def test_chat_equals_its_sql(spark, tmp_path):
    import duckdb

    texts = ["<|im_end|>", "a <|im_end|> b", "<\\|x", "plain", "", None, "<|im_start|>user\nhi<|im_end|>\n", "<|", "<\\\\|im_end|>"]
    rows = [(i // 3, i % 3, ["user", "assistant", None][i % 3], t) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.toPandas().to_parquet(tmp_path / "conversations.parquet")
    got = queries.op9_chat_format(spark, str(tmp_path)).toPandas().sort_values("conv_id")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    want = con.execute(queries.CHAT_SQL).df().sort_values("conv_id")
    assert got.to_dict("list") == want[got.columns].to_dict("list")


def test_stages_keep_columns_of_clashing_names(spark):
    rows = [(i, f"text {i} of some words\nand a line {i}") for i in range(12)] + [(None, None), (20, "")]
    df = table(spark, rows).drop("mix_order")
    for stage in (corpus_pipeline.dedup_lines, corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources):
        out = stage(spark, df, "")
        own = [c for c in out.columns if c != "mix_order"]
        assert own == df.columns and out.count() == df.count()
        assert {tuple(r) for r in out.select("slot", "block", "n_removed", "n_chunks").collect()} == {("mine",) * 4}
        assert stage(spark, df.limit(0), "").count() == 0
    assert corpus_pipeline.dedup_lines(spark, df.drop("n_chars"), "").count() == df.count()
