"""Each operator against brute force or the library it must equal, with edge cases."""

import hashlib
import unicodedata
import re
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import chat, fingerprints, html, jaccard, licenses, media, packing, pieces, quality, repeats
from blockloom.llm.words import NOT_SPACE, flat, spans, window_hashes, word_hashes


def canon(t):
    n = unicodedata.normalize
    return re.sub(r"\s+", " ", n("NFKC", n("NFKC", t or "").casefold())).strip(" ")


# --- words -----------------------------------------------------------------


def test_word_spans_and_hashes(docs):
    texts = list(docs.values())
    buf, offsets = flat(pa.array(texts, pa.string()))
    starts, ends, first = spans(buf, offsets, NOT_SPACE)
    data = buf.tobytes()
    found = [[data[s:e].decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert found == [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    hashes = word_hashes(buf, starts, ends)[0]
    flat_words = [w for x in found for w in x]
    by = {}
    for w, h in zip(flat_words, hashes, strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    windows = window_hashes(hashes, 3)
    grams = [tuple(flat_words[i : i + 3]) for i in range(len(flat_words) - 2)]
    assert len({*windows.tolist()}) == len({*grams}) == len({*zip(windows.tolist(), grams, strict=True)})


# --- 1 fingerprints -----------------------------------------------------------


def test_fingerprints_follow_canonical_bytes(frame, docs):
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame, "doc_id", "text").collect()}
    for a in docs:
        for b in docs:
            assert (got[a] == got[b]) == (canon(docs[a]) == canon(docs[b])), (a, b)
    assert got[0] == got[1] == got[2] and got[91] == got[92]


def test_equal_buckets_are_compared_by_bytes(frame, docs):
    weak = lambda c: F.substring(fingerprints.wide_digest(c), 1, 1)
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame, "doc_id", "text", weak).collect()}
    groups = {canon(t) for t in docs.values()}
    assert len(set(got.values())) == len(groups)


def test_op1(spark, saved, docs):
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(spark, saved).collect()}
    ids = sorted(docs, reverse=True)
    for i, d in enumerate(ids):
        x, y = docs[d] or "", docs[ids[(i + 1) % len(ids)]] or ""
        cut = len(x) // 3
        e = x[: len(x) - cut] + y[:cut]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == float(canon(x) == canon(e)) and r.near_next == float(canon(x) == canon(y))


def test_op1_compares_edited_texts_by_bytes(spark, frame, docs):
    """Under a digest of four bits own and edited texts share buckets; fingerprints still tell every two canonical texts apart."""
    weak = lambda c: F.substring(fingerprints.wide_digest(c), 1, 1)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame.select("doc_id", "text"), weak).collect()}
    ids, of = sorted(docs, reverse=True), {}
    for i, d in enumerate(ids):
        x, y = docs[d] or "", docs[ids[(i + 1) % len(ids)]] or ""
        e = x[: len(x) - len(x) // 3] + y[: len(x) // 3]
        r = got[d]
        for t, f in ((x, r.fingerprint), (e, r.edited_fingerprint)):
            assert of.setdefault(canon(t), f) == f
        assert r.near_edited == float(canon(x) == canon(e)) and r.near_next == float(canon(x) == canon(y))
    assert len(set(of.values())) == len(of)


def test_op1_of_missing_and_repeated_ids(spark):
    rows = [(5, "abcdef"), (5, "abcdef"), (3, None), *((None, f"t{i % 3} and more") for i in range(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprints.edited_fingerprints(df).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((d or 0, len(t or "")) for d, t in rows)
    assert len({r.fingerprint for r in got}) == 5
    only = fingerprints.edited_fingerprints(df.where("doc_id is null")).collect()
    assert len(only) == 40 and len({r.fingerprint for r in only}) == 3


def test_next_over_many_levels(spark):
    ids = [0, 1, 511, 512, 513, 10**6, 10**12, -5, 2**62]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "k long, v string")
    got = {r.k: r.v_next for r in fingerprints.with_next(df, min(ids), max(ids)).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: str(b) for a, b in zip(down, down[1:] + down[:1], strict=True)}


# --- 2 repeats ----------------------------------------------------------------


@pytest.mark.parametrize("width,fan", [(35, 11), (35, 1), (8, 2), (2, 3)])
def test_repeats(monkeypatch, frame, docs, width, fan):
    """Small bins, so that hashes are dealt on several levels."""
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(repeats, "RANGE_BYTES", 30_000)
    monkeypatch.setattr(repeats, "FAN_BITS", fan)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.drop_repeats(frame, "doc_id", "text", width, carry=("lang",)).collect()}
    assert got == repeats.brute_force(docs, width)


def passes(chunks, width, fan, ranges):
    """The three passes without Spark; each reads its chunk's rows in another order."""
    rng = np.random.default_rng(9)
    blocks, windows = repeats.Plan(40, fan, ranges), repeats.Plan(64, fan, ranges)

    def shuffled(texts):
        order = rng.permutation(len(texts))
        return order, pa.chunked_array([pa.array([texts[i] for i in order], pa.string())])

    def exchanged(sent, plan, say):
        for level in range(1, plan.levels + 1):
            sent.sort(key=lambda m: (m[:2], rng.random()))
            batches = repeats._batches(iter(sent), repeats.SENT, 500)
            if level < plan.levels:
                sent = [m for b in repeats.regrouped(batches, plan, level + 1) for m in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        said = pa.Table.from_batches(repeats.answered(batches, say))
        return {c: said.filter(pa.compute.equal(said["chunk"], c)).take(rng.permutation(said.filter(pa.compute.equal(said["chunk"], c)).num_rows)) for c in range(len(chunks))}

    hits = exchanged([m for c, t in enumerate(chunks) for m in repeats.probe(shuffled(t)[1], c, blocks, width)], blocks, repeats.Bin.anchors)
    seen = exchanged([m for c, t in enumerate(chunks) for m in repeats.extend(shuffled(t)[1], hits[c], c, windows, width, blocks.bits)], windows, repeats.Bin.repeats)
    out = {}
    for c, t in enumerate(chunks):
        order, texts = shuffled(t)
        n, gone, kept = repeats.remove(texts, seen[c], windows, width, blocks.bits)
        out |= {(c, int(i)): (int(a), int(b), k) for i, a, b, k in zip(order, n, gone, kept.to_pylist(), strict=True)}
    return out


@pytest.mark.parametrize("fan,ranges", [(11, 1), (1, 6), (3, 60)])
def test_passes_do_not_depend_on_the_order_of_rows(monkeypatch, docs, fan, ranges):
    monkeypatch.setattr(repeats, "REGROUP", 500)
    texts = [t for i, t in docs.items() if i != 7]
    chunks = [texts[i::4] for i in range(4)]
    got = passes(chunks, 35, fan, ranges)
    want = repeats.brute_force({(c, i): t for c, own in enumerate(chunks) for i, t in enumerate(own)})
    assert got == want and any(g for _, g, _ in want.values())


def test_messages_grow_with_the_text(docs):
    """A chunk's messages don't depend on how large the corpus is, and are at most one for each bin."""
    texts = pa.chunked_array([pa.array([t for i, t in docs.items() if i != 7], pa.string())])
    count = {ranges: len(list(repeats.probe(texts, 3, repeats.Plan(50, 5, ranges), 35))) for ranges in (1, 40, 10**4, 10**9)}
    assert len(set(count.values())) == 1 and count[1] <= 32
    assert [repeats.Plan(50, 5, r).levels for r in (1, 32, 33, 1024, 1025)] == [1, 1, 2, 2, 3]
    # A regrouping task sends its bin's hashes on, as many messages at most as the next level has bins in it.
    plan = repeats.Plan(50, 5, 900)
    sent = sorted(repeats.probe(texts, 3, plan, 35))
    again = [m for b in repeats.regrouped(repeats._batches(iter(sent), repeats.SENT), plan, 2) for m in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(again) <= 32 * len(sent)
    for k in (2, 3, 4):
        assert sorted(np.concatenate([repeats.undeltas(m[k]) for m in again]).tolist()) == sorted(np.concatenate([repeats.undeltas(m[k]) for m in sent]).tolist())


def thue_morse(bits):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(1 << bits))


@pytest.mark.parametrize("bits", [10, 12])
def test_words_that_collide_as_polynomials(spark, bits):
    """A Thue-Morse word and its complement are equal modulo 2**64 under any base; here they differ."""
    one = thue_morse(bits)
    other = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(30))
    texts = {1: f"{rest} {one} {rest}", 2: f"{rest} {other} {rest}", 3: f"{rest} {one}", 4: one, 5: other, 6: " ".join(one), 7: " ".join(other)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for width in (35, 31):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.drop_repeats(df, "doc_id", "text", width).collect()}
        assert got == repeats.brute_force(texts, width)
    near = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.similarity_classes(df, "doc_id", "text").collect()}
    assert near == jaccard.brute_force(texts)


def test_wrong_answers_raise(docs):
    c = repeats.Chunk(pa.chunked_array([pa.array([docs[40]])]), 35, 40)
    say = pa.table({"chunk": [0], "kind": [repeats.ANCHORS], "bin": [0], "high": [repeats.deltas(np.array([5], np.uint64))], "low": [b""]})
    with pytest.raises(RuntimeError):
        repeats.anchored(c, say)
    say = pa.table({"chunk": [0], "kind": [repeats.THESE], "bin": [0], "high": [repeats.deltas(np.array([5], np.uint64))], "low": [b"12345678"]})
    with pytest.raises(RuntimeError):
        repeats.repeated(np.array([5], np.uint64), np.array([6], np.uint64), say, repeats.Plan(64, 11, 1))


ON_EXECUTORS = """
import sys
from pyspark.sql import SparkSession
from blockloom.llm import repeats
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "800m").config("spark.sql.shuffle.partitions", "6").config("spark.checkpoint.dir", "file://" + sys.argv[2]).config("spark.log.level", "ERROR").getOrCreate()
repeats.CHUNK_BYTES, repeats.RANGE_BYTES, repeats.FAN_BITS = 200_000, 300_000, 3
df = spark.read.parquet(sys.argv[1] + "/documents.parquet").repartition(5)
want = repeats.brute_force({r.doc_id: r.text for r in df.collect()})
for _ in range(2):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.drop_repeats(df, "doc_id", "text").collect()}
    print("WRONG", sum(got[d] != x for d, x in want.items()), len(got) - len(want), "REMOVED", sum(x[1] > 0 for x in want.values()))
"""


def test_repeats_on_two_executors(tmp_path):
    """Chunks' rows come from several hosts, in any order."""
    import os
    import subprocess
    import sys

    source = "/root/testdata/sf0.01"
    if not os.path.isdir(source):
        pytest.skip("no tables")
    run = subprocess.run([sys.executable, "-c", ON_EXECUTORS, source, str(tmp_path)], capture_output=True, text=True, timeout=600, cwd=tmp_path)
    lines = [x for x in run.stdout.splitlines() if x.startswith("WRONG")]
    assert len(lines) == 2 and all(x.startswith("WRONG 0 0 ") and not x.endswith(" 0") for x in lines), run.stdout[-2000:] + run.stderr[-2000:]


def test_repeats_of_repeated_rows(spark):
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "a b")], "doc_id long, text string")
    got = repeats.drop_repeats(df, "doc_id", "text").collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(2, 0), (50, 50), (50, 50), (50, 50)]


def test_delta_codes():
    rng = np.random.default_rng(1)
    for top in (2**20, 2**48, 2**63):
        x = np.unique(rng.integers(0, top, 1000, dtype=np.uint64))
        assert (repeats.undeltas(repeats.deltas(x)) == x).all()
    assert len(repeats.undeltas(repeats.deltas(np.zeros(0, np.uint64)))) == 0


# --- 3 quality ------------------------------------------------------------------


def test_quality_on_held_out_rows():
    """Held-out accuracy: junk goes, clean text stays."""
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts, grades = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        grade = (2, 2, 1, 0)[i % 4]
        if grade == 1:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "awful"]))
        if grade == 0:
            w = [x + "***" for x in w]
        texts.append(" ".join(w))
        grades.append(grade)
    n, g = 600, np.array(grades)
    model = quality.Model(*quality.fit(*quality.features(pa.array(texts[:n])), g[:n]), 0.0)
    r, f, v = quality.features(pa.array(texts[n:]))
    tail = model.at_least(quality.scores_of(r, f, v, len(texts) - n, model.weights))
    assert (np.diff(model.cuts) > 0).all()
    assert (tail[:, 0] >= tail[:, 1]).all()
    assert (tail[g[n:] == 2][:, 1] > 0.5).mean() > 0.97 and (tail[g[n:] < 2][:, 1] < 0.5).mean() > 0.97


def test_quality_gradient_descends():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "fine", "bad", "x"], 30, p=p)) for p in ([0.4, 0.4, 0.1, 0.1], [0.25] * 4, [0.1, 0.1, 0.4, 0.4]) for _ in range(40)]
    grade = np.repeat([2, 1, 0], 40)
    r, f, v = quality.features(pa.array(texts))
    w, cuts = quality.fit(r, f, v, grade)
    s = quality.scores_of(r, f, v, len(texts), w)
    assert s[grade == 2].mean() > s[grade == 1].mean() > s[grade == 0].mean()


def test_threshold_has_the_fewest_errors():
    rng = np.random.default_rng(4)
    for n in (1, 2, 30, 300):
        clean = rng.random(n) < 0.8
        tail = np.clip(rng.normal(np.where(clean, 0.7, 0.2), 0.3), 0, 1).round(2)
        wrong = lambda t: int(((tail >= t) != clean).sum())
        got = quality.threshold(tail, clean)
        assert 0 <= got <= 0.5
        if clean.any():
            assert wrong(got) == min(map(wrong, [*tail[tail <= 0.5], 0.5]))


def test_odd_clean_labels_let_no_toxic_text_pass(spark):
    """A few toxic texts labelled clean leave the selection of documents without labels as it is."""
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts, rated = [], []
    for i in range(1600):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if i % 4 == 1:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "awful"]))
        texts.append((i, " ".join(w)))
        if i < 1000:
            rated.append((i, 1, int(i % 4 == 1 and i % 100 != 1)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = quality.trained(docs, spark.createDataFrame(rated, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.keep for r in quality.scored(docs, model).collect()}
    toxic, clean = ([got[i] for i in range(1000, 1600) if (i % 4 == 1) == x] for x in (True, False))
    assert np.mean(toxic) < 0.05 and np.mean(clean) > 0.97


def plain_features(text):
    """Features of one text by their description: number to value."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    out, shares = {}, defaultdict(int)

    def hashed(w):
        buf = np.frombuffer(w, np.uint8)
        return int(quality.word_hashes(buf, np.array([0]), np.array([len(buf)]))[0][0])

    for w in set(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())):
        out[hashed(w) >> (64 - quality.WORD_BITS)] = quality.PRESENT
        for k in (k for k in quality.STEMS if len(w) > k):
            stem = quality.mix(np.array([hashed(w[:k])], np.uint64) + np.uint64(k))
            out[int(stem[0]) >> (64 - quality.WORD_BITS)] = quality.PRESENT
    for i, w in enumerate(words):
        two = (w[-2] if len(w) > 1 else w[-1]) * 256 + w[-1]
        shares[quality._TAILS + (int(quality.mix(np.array([two], np.uint64))[0]) >> (64 - quality.TAIL_BITS))] += 1
        shares[quality._KINDS + quality._KIND[w[0]] * 8 + quality._KIND[w[-1]]] += 1
        if i and w == words[i - 1]:
            shares[quality._AGAIN] += 1
    return out | {k: quality.SHARE * n / len(words) for k, n in shares.items()}


def test_op3_equals_a_plain_version(spark, saved, docs):
    """The query's grades, probabilities and selection, text by text from the model."""
    import math

    frame = spark.read.parquet(f"{saved}/documents.parquet")
    model = quality.trained(frame, spark.read.parquet(f"{saved}/labels.parquet"))
    got = {r.doc_id: r for r in quality.op3_quality(spark, saved).collect()}
    assert set(got) == set(docs)
    for d, t in docs.items():
        score = sum(model.weights.astype(np.float32)[k] * v for k, v in plain_features(t).items())
        p = [1 / (1 + math.exp(-(score - c))) for c in model.cuts]
        assert abs(got[d].expected_grade - sum(p)) < 1e-4 and abs(got[d].tail_probability - p[-1]) < 1e-4
        assert got[d].keep == (got[d].tail_probability >= model.select)


def test_op3_repeated_ids(spark):
    """However often a labelled id stands in the documents, no more than ``fit_rows`` rows reach the driver."""
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 0, 0), (2, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.trained(docs, labels, fit_rows=40)
    assert quality.scored(docs, model).count() == 300


def test_op3_edges(spark, frame, docs, saved):
    labels = spark.read.parquet(f"{saved}/labels.parquet")
    got = quality.scored(frame, quality.trained(frame, labels)).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    none = quality.trained(frame, labels.where("false"))
    assert all(r.keep for r in quality.scored(frame, none).collect())
    odd = labels.withColumn("quality", F.lit(None).cast("int"))
    assert quality.trained(frame, odd).select == 0.0


# --- 4 pieces ---------------------------------------------------------------------


def test_pieces_equal_the_library(docs):
    import random

    import sentencepiece

    own = pieces.Pieces(pieces.default_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(4)
    parts = ["a", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "ß", "日本", "😀", "<s>", "<0x0A>", "́", "A", "!!", "...", "----", "\x00", "ö", "ﬁ", "x" * 20, "1", "23"]
    for t in [*docs.values(), *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000))]:
        ids = np.frombuffer(own.encode(t or ""), "<u4")
        assert ids.tolist() == sp.encode(t or "", add_bos=True, add_eos=True)
        assert own.decode(ids, np.array([len(ids)])) == [sp.decode(ids.tolist())]


def test_op4(spark, saved, docs):
    got = {r.doc_id: r for r in pieces.op4_pieces(spark, saved).collect()}
    assert set(got) == set(docs) and got[0].n_tokens == got[1].n_tokens == 2
    assert got[3].decoded_sha256 == hashlib.sha256(b"one").hexdigest()


# --- 5 packing ----------------------------------------------------------------------


def test_packing(monkeypatch, frame, docs):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(packing, "SEGMENT", 5_000)
    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in docs.items()}
    rows = packing.packed(frame, "doc_id", "text").collect()
    by, seq = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by.setdefault(r.doc_id, []).append((r.start, r.length))
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(docs)
    for d, x in by.items():
        assert [s for s, _ in sorted(x)] == np.cumsum([0, *(n for _, n in sorted(x))])[:-1].tolist() and sum(n for _, n in x) == len(ids[d])
    for x in seq.values():
        total = sum(n for _, n in x)
        assert [o for o, _ in sorted(x)] == np.cumsum([0, *(n for _, n in sorted(x))])[:-1].tolist()
        assert total <= 2048 and total & (total - 1) == 0  # no padding at all


def test_packing_finds_added_tokens(spark):
    """Texts with the literal of an added token, against the library at its default setting."""
    import random

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<|", "|>", " ", "  ", "\n", "\t", "a", "the", "ing", "É", "日本", "😀", "'s", "12", "..."]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "  <|endoftext|>\n", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(2000))]
    bpe = packing.byte_bpe(packing.default_tokenizer())
    for t in texts:
        assert bpe.encode(t, allowed_special="all") == tok.encode(t, add_special_tokens=False).ids, t
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts[:200])), "doc_id long, text string"), "doc_id", "text").collect()
    ids = [np.array([*tok.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4") for t in texts[:200]]
    assert {r.doc_id for r in rows} == set(range(200)) and sum(r.length for r in rows) == sum(map(len, ids))
    for r in rows:
        assert (zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()), len(ids[r.doc_id])) == (r.ids_crc32, r.doc_tokens)


def test_ranges_are_even():
    rng = np.random.default_rng(7)
    for cells in (rng.integers(0, 50, 400), np.where(rng.random(400) < 0.01, 9000, rng.integers(0, 20, 400)), np.zeros(400), np.full(400, 100.0)):
        first, n = packing.dealt(cells.astype(float), 100.0)
        load = {}
        for c, f, k in zip(cells, first, n, strict=True):
            for r in range(f, f + k):
                load[r] = load.get(r, 0) + c / k
        assert (np.diff(first) >= 0).all() and (n >= 1).all() and max(load.values()) <= 210
        assert len([x for x in load.values() if x]) <= cells.sum() / 100 * 2 + 2


def test_packing_repeated_rows_and_large_vocabularies(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, None)], "doc_id long, text string")
    rows = packing.packed(df, "doc_id", "text").collect()
    n = {r.doc_id: r.doc_tokens for r in rows}
    assert sum(r.length for r in rows) == 2 * n[1] + 2 and n[None] == 1
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        model = json.load(f)
    model["added_tokens"].append({"content": "<x>", "id": 70_000})
    (tmp_path / "big.json").write_text(json.dumps(model))
    with pytest.raises(ValueError):
        packing.byte_bpe(str(tmp_path / "big.json"))


def test_hilbert_curve_is_one():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


# --- 6 Jaccard ------------------------------------------------------------------------


@pytest.mark.parametrize("most,block", [(256, 128), (6, 3)])
def test_jaccard(monkeypatch, frame, docs, most, block):
    monkeypatch.setattr(jaccard, "MOST", most)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.similarity_classes(frame, "doc_id", "text").collect()}
    assert got == jaccard.brute_force(docs)


def test_jaccard_repeated_and_missing_ids(spark):
    t = " ".join(map(str, range(100)))
    df = spark.createDataFrame([(1, t), (1, t), (1, "zz"), (2, t + " x"), (None, t), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in jaccard.similarity_classes(df, "doc_id", "text").collect())
    assert got == [(0, 1, 3), (1, 1, 0), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 0)]


def test_verified_prunes_and_keeps():
    """Links after pruning equal links of all pairs, over texts of several groups."""
    rng = np.random.default_rng(14)
    bases = [rng.integers(0, 2**63, 100, dtype=np.uint64) for _ in range(4)]
    sets = [np.unique(np.where(rng.random(100) < 0.06, rng.integers(0, 2**63, 100, dtype=np.uint64), bases[i % 4])) for i in range(60)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sig = jaccard.signatures(np.concatenate(sets), bounds).astype(np.uint8)
    want = np.array([[i != j and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (jaccard.verified(sets, sig, 0.8, jaccard.least_matches()) == want).all() and want.any()


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_matches()
    rng = np.random.default_rng(2)
    same = rng.random((20000, 128)) < 0.8  # pairs right at the threshold
    alive = np.all([same[:, :k].sum(1) >= least[k] for k in jaccard.STEPS], axis=0)
    assert alive.all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.v: r.c for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


# --- 7 licenses --------------------------------------------------------------------------


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_licenses(spark, frame, docs):
    more = {1000: "Licensed under CC BY-NC 4.0.", 1001: "GNU General Public License, version 3; all rights reserved. CC BY cc by", 1002: "MIT License", 1003: "Accc by", 1004: "cc0"}
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string").unionByName(frame.select("doc_id", "text"))
    got = {r.doc_id: r for r in licenses.scanned(df, "doc_id", "text").collect()}
    for d, t in (docs | more).items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
        at = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = got[d]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[1000].labels == "cc-by,cc-by-nc-4.0,licensed" and got[1002].labels == "mit" and got[1003].labels == "" and got[1004].labels == "cc0"


def sample(pattern, rng):
    """A string that a pattern of the rules matches."""
    from re import _constants as c
    from re import _parser as p

    def made(parsed):
        out = ""
        for op, arg in parsed:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.ANY:
                out += rng.choice("ab ")
            elif op is c.IN:
                kind, value = rng.choice(arg)
                out += chr(value if kind is c.LITERAL else rng.randint(*value))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                lo, hi, inner = arg
                out += "".join(made(inner) for _ in range(rng.randint(lo, min(int(hi), lo + 2))))
            elif op is c.SUBPATTERN:
                out += made(arg[-1])
            elif op is c.BRANCH:
                out += made(rng.choice(arg[1]))
            else:
                assert op is c.ASSERT_NOT, op
        return out

    return made(p.parse(pattern.pattern.decode("latin1"))).encode("latin1")


def plain_scan(text):
    """(labels, score) of a text by the definition: all matches of all rules, each against all accepted before it."""
    joined = b" ".join(re.findall(rb"[0-9a-z\x80-\xff]+", text))
    found = sorted((-r.priority, -(m.end() - m.start()), m.start(), i, m.end()) for i, r in enumerate(licenses.ordered_rules()) for m in r.pattern.finditer(joined))
    kept = []
    for _, _, start, i, end in found:
        if not any(a <= start and end <= b for a, b, _ in kept):
            kept.append((start, end, i))
    miss = 1.0
    for _, _, i in sorted(kept):
        miss *= 1 - licenses.ordered_rules()[i].confidence
    base = {label for p, label in licenses.BASE.items() if f" {p} ".encode() in b" " + joined + b" "}
    return ",".join(sorted(base | {licenses.ordered_rules()[i].label for _, _, i in kept})), 1 - miss


def test_every_rule_is_reached():
    """Texts made from each rule's pattern hold its keyword, pass the prefilter and get the rule's label unless a better one covers it."""
    import random

    rng = random.Random(12)
    assert len(licenses.ordered_rules()) > 250
    for r in licenses.ordered_rules():
        for _ in range(4):
            text = re.sub(rb" +", b" ", sample(r.pattern, rng)).strip()
            if not r.pattern.search(text):
                continue
            assert r.keyword in text, (r.keyword, text)
            row = b"(" + text.replace(b" ", rng.choice([b" ", b"  ", b"-", b"\n"])) + b")."
            data = b"plain words" + row + b"accept"
            assert licenses.candidates(data, np.array([0, 11, 11 + len(row), len(data)])).tolist() == [1], text
            labels, score = plain_scan(row)
            assert labels and score > 0
            assert licenses.scan(row)[4] == labels and abs(licenses.scan(row)[5] - score) < 1e-12


def test_scan_equals_the_plain_version(spark):
    import random

    rng = random.Random(13)
    rules = licenses.ordered_rules()
    texts = []
    for _ in range(300):
        parts = [sample(rng.choice(rules).pattern, rng).decode("latin1") if rng.random() < 0.6 else rng.choice(["and", "the", "license", "2 0", "words of text", "CC BY", "all rights reserved", "gpl", "é"]) for _ in range(rng.randint(0, 12))]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts).replace("  ", " "))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        labels, score = plain_scan(low(t).encode())
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-9, t


def test_scan_takes_linear_time():
    import time

    took = []
    for n in (10_000, 80_000):
        began = time.process_time()
        licenses.scan(b"cc by all rights reserved " * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5  # 8 times the text


def test_short_names_are_scanned(spark):
    texts = {1: "EPL 2.0", 2: "Released under the EPL 2.0", 3: "OFL 1.1", 4: "released under MIT", 5: "available under the terms of the MIT", 6: "komm mit, profl replied"}
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scanned(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text").collect()}
    assert {i: labels for i, (labels, _) in got.items()} == {1: "epl-2.0", 2: "epl-2.0", 3: "ofl-1.1", 4: "mit", 5: "mit", 6: ""}
    assert all((score > 0) == (labels != "") for labels, score in got.values())


def test_containment():
    (d,) = licenses.detections(b"licensed under the apache license version 2 0")
    assert d[2].label == "apache-2.0"


# --- 8 HTML ---------------------------------------------------------------------------------


WEIGHTS = html.learned(["<html><body><nav><a>x y</a></nav><article><p>one two</p></article><footer>z</footer></body></html>"])


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p>just words", "just words"),
        ("<nav>a b c</nav><article><h1>T</h1><p>One &amp; two<br>three</p><div class='ad'>buy</div><p>four</article><footer>f</footer>", "T\nOne & two three\nfour"),
        ("<header>Site name</header><main><div><h2>Head</h2><p>a <a href=x>b</a> c &lt;i&gt;</p></div><form>no</form></main><aside>s</aside>", "Head\na b c <i>"),
        ("<body><script>var t='<p>x</p>';</script><style>p{}</style><article><p>word  \n word</p><section id=comments><p>I say so</p></section></article>", "word word"),
        ("<article><p>un<b>clo", "unclo"),
        ("<div><p>text <!-- not this --> here</p></div>", "text here"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page, WEIGHTS) == text


@pytest.mark.parametrize(
    "page,text",
    [
        *((f"<body><nav>a b</nav><div class='{c}'><{t}><p>one two three</p></{t}></div><footer>f</footer></body>", "one two three") for c in ("content-sidebar-wrap", "has-sidebar", "no-comments", "wrap sidebar") for t in ("article", "main")),
        ("<div id='content-sidebar-wrap'><p>one two three four</p></div><div class='sidebar'>x y</div>", "one two three four"),
        ("<article><div class='content-sidebar-wrap'><p>one two three</p></div><p>four</p></article>", "one two three\nfour"),
        ("<article><p class='no-comments'>one</p><p>two three</p></article>", "one\ntwo three"),
        ("<article><p>see <a href='/the-hidden-coast'>the coast</a> and <b title='A hidden place'>a place</b>, <i data-x=hidden>too</i></p></article>", "see the coast and a place, too"),
        ("<article><p>see <a title='class=ad style=display:none'>this</a></p></article>", "see this"),
        ("<div class='content-sidebar-wrap'><article class='post category-social'><p>one two</p></article></div><div id='comments' class='comments-area'><article class='comment-body'>x y z</article></div>", "one two"),
        ("<article><p hidden>x<p>one two</article>", "one two"),
        # These stay away.
        ("<article><p>one two</p><p hidden>x</p><p class=a style='display: none'>y</p><div class='b share-buttons'>z</div></article>", "one two"),
        ("<article><p>one two three</p></article><div class='comments-area'><article class='comment-body'><p>I say so and much more</p></article></div>", "one two three"),
        ("<article><p>one two three</p></article><div class='related'><article><p>x y</p></article></div>", "one two three"),
    ],
)
def test_hints_leave_the_content(page, text):
    assert html.main_text(page, WEIGHTS) == text


def test_best_region():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(200):
        s = rng.integers(-5, 5, 12).astype(float).tolist()
        a, b = html.best_region(s)
        best = max([0.0, *(sum(s[i:j]) for i, j in itertools.combinations(range(13), 2))])
        assert sum(s[a:b]) == best


def test_references_end_at_tags():
    assert html.main_text("<article><p>a &am<b></b>p; b &amp;amp; &lt<i>x</i></article>", WEIGHTS) == "a &amp; b &amp; <x"


def site(rng, marked):
    """(page, its main text): an article among boilerplate whose names say nothing, so that only scores can tell."""
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80)]

    def text(lo, hi):
        return " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))

    def links(n):
        return "<div class=x1><ul>" + "".join(f"<li><a href=/{i}>{text(1, 2)}</a></li>" for i in range(n)) + "</ul></div>"

    lines, body = [], ""
    for i in range(rng.randint(2, 7)):
        if i and rng.random() < 0.2:
            lines.append(text(2, 4))
            body += f"<h2>{lines[-1]}</h2>"
        a, b = text(10, 40), text(5, 20)
        lines.append(f"{a} & {b}")
        body += f"<p>{a}\n &amp; <b>{b[:3]}</b>{b[3:]}</p>\n"
    inner = f"<article>{body}</article>" if marked else f"<div class=x2>{body}</div>"
    return f"<html><head><title>{text(1, 4)}</title></head><body>{links(rng.randint(8, 20))}{inner}{links(rng.randint(8, 20))}</body></html>", "\n".join(lines)


def test_scores_find_unmarked_content():
    """Pages whose markup names nothing: with scores nearly all are extracted exactly, with scores off (all words alike) none is."""
    import random

    rng = random.Random(21)
    weights = html.learned([site(rng, True)[0] for _ in range(60)])
    pages = [site(rng, False) for _ in range(200)]
    found = np.mean([html.main_text(p, weights) == t for p, t in pages])
    off = html.Weights(defaultdict(lambda: 1.0), defaultdict(lambda: 0.0))
    without = np.mean([html.main_text(p, off) == t for p, t in pages])
    assert found > 0.95 and without == 0, (found, without)
    marked = [site(rng, True) for _ in range(100)]
    assert all(html.main_text(p, weights) == t for p, t in marked)


def test_region_equals_all_regions():
    """The text of the best of all regions, tried one by one."""
    import random

    rng = random.Random(22)
    weights = html.learned([site(rng, True)[0] for _ in range(30)])
    for _ in range(10):
        page, _ = site(rng, False)
        seq = html.parts(page)
        scores = html.scores_of(seq, weights)
        total = np.concatenate([[0], np.cumsum(scores)])
        best = max((total[j] - total[i], -i, -j) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1))
        a, b = html.best_region(scores)
        assert abs(sum(scores[a:b]) - best[0]) < 1e-9


@pytest.mark.parametrize("page", ["<b>" * 5000 + "<td>x</td>" * 5000, "<div>" * 5000 + "</p>" * 5000, "<i>" * 5000 + "<p>x</p>" * 5000, "<ul><li>x" * 5000 + "</li>" * 5000])
def test_deep_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html.main_text(page, WEIGHTS)
    assert time.process_time() - began < 5


def test_op8_query(spark, tmp_path):
    import random

    rng = random.Random(23)
    pages = [(i, f"u{i}", *site(rng, i % 2 == 0)) for i in range(60)]
    rows = [(i, u, p) for i, u, p, _ in pages] + [(None, None, None), (0, "u0", pages[0][2]), (99, "e", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = html.op8_html(spark, str(tmp_path)).collect()
    want = {i: t for i, _, _, t in pages} | {None: "", 99: ""}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert np.mean([r.text == want[r.page_id] for r in got]) > 0.95 and all(r.text == want[r.page_id] for r in got if r.page_id is None or r.page_id % 2 == 0)


def test_html_operator(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>", "x"), (1, "u", "<article><p>a b</p></article>", "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html.extracted(df, "page_id", "url", "html").collect()) == ["", "a b", "a b"]
    assert html.extracted(df.where("false"), "page_id", "url", "html").count() == 0


# --- 9 chat ------------------------------------------------------------------------------------


def test_validation(spark):
    schema = {"f": {"n": ("integer", True), "s": ("string", False), "a": ("array", False), "o": ("object", False), "x": ("number", False), "b": ("boolean", False)}}
    rows = [("f", '{"n": 1, "s": "x", "a": [1], "o": {"k": 1}, "x": 1.5, "b": true}'), ("f", '{"s": 3}'), ("f", "[1]"), ("f", "{bad"), ("g", "{}"), (None, "{}"), ("f", None), ("f", '{"n": null}'), ("f", '{"n": 2, "zz": 1}')]
    df = spark.createDataFrame(rows, "tool string, args string")
    got = [r.e for r in df.select(chat.violations(F.col("tool"), F.col("args"), schema).alias("e")).collect()]
    assert got == [[], ["missing n", "s is not string"], ["not an object"], ["not an object"], ["unknown tool g"], ["no tool"], ["not an object"], ["missing n"], ["unknown zz"]]


def test_limits_of_strings(spark):
    schema = {"f": {"s": ("string", True, 3)}}
    df = spark.createDataFrame([("f", '{"s": "äöü"}'), ("f", '{"s": "äöüx"}'), ("f", '{"s": 12345}'), ("f", "{}")], "tool string, args string")
    assert [r.e for r in df.select(chat.violations(F.col("tool"), F.col("args"), schema).alias("e")).collect()] == [[], ["s is too long"], ["s is not string"], ["missing s"]]


def test_levels_and_links(spark):
    chain = [(f"c{i}", f"c{i - 1}") for i in range(40)] + [("lone", "nowhere"), ("p", "q"), ("q", "p")]
    calls = spark.createDataFrame([(c, p, "f", '{"b":1,"a":2}') for c, p in chain] + [(None, None, "f", "{}"), ("lone", "nowhere", "f", '{"a":"x"}')], "call_id string, parent_id string, tool string, arguments string")
    results = spark.createDataFrame([("c0", "yes"), ("c0", "also"), ("other", "x"), (None, "y")], "call_id string, content string")
    rows = chat.linked(calls, results, {"f": {"a": ("integer", True), "b": ("integer", True)}}).collect()
    got = {r.call_id: r for r in rows}
    assert len(rows) == 44 and len(got) == 43 and all(got[f"c{i}"].level == i + 1 for i in range(40)) and got["lone"].level == 1 and got["p"].level == 0
    assert got["c0"].content == "also" and got["c0"].json == '{"arguments":{"a":2,"b":1},"id":"c0","level":1,"name":"f","result":"also"}'
    assert not got["c1"].answered and got["c1"].errors == ""
    # Calls that repeat an identifier keep their own arguments.
    assert sorted((r.errors, r.json) for r in rows if r.call_id == "lone") == [("", '{"arguments":{"a":2,"b":1},"id":"lone","level":1,"name":"f"}'), ("a is not integer; missing b", '{"arguments":{"a":"x"},"id":"lone","level":1,"name":"f"}')]


def test_op9_edges(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (5, 0, "user", "x" * 257), (5, 0, "user", "y"), (1, 1, "user", "u"), (1, 2, "assistant", 'a "q"\n'), (1, 3, "user", None), (2, 0, "assistant", "first"), (None, 1, "user", "x"), (3, None, "assistant", ""), (1, 1, "user", "u"), (4, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op9_chat(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sorted((r.errors, len(r.json) > 257) for r in got if r.conv_id == 5) == [("", False), ("text is too long", True)]
    kinds = {(r.conv_id, r.turn): (r.kind, r.answered, r.level, r.errors) for r in got}
    assert kinds[1, 1] == ("call", True, 1, "") and kinds[1, 2] == ("result", True, 1, "") and kinds[1, 3] == ("call", False, 2, "missing text") and kinds[2, 0][0] == "orphan" and kinds[None, 1][0] == "message"


# --- 10 media -------------------------------------------------------------------------------------


def test_media(spark, frame, docs, saved):
    got = {r.doc_id: r for r in media.op10_media(spark, saved).collect()}
    assert set(got) == set(docs)
    for d, t in docs.items():
        n, p = media.padded(t)
        g = media.to_png(p)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (n, len(p), zlib.crc32(p[-64:]), len(g))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(p).hexdigest(), hashlib.sha256(g).hexdigest())
        assert len(p) % 64 == 0 and p and media.from_png(g).tobytes() == p


def test_damaged_members_are_reported_alone(spark, tmp_path):
    folder = tmp_path / "a"
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(20)], "doc_id long, text string").coalesce(1)
    media.archived(df, "doc_id", "text", f"file://{folder}")
    (path,) = folder.glob("*.zip")
    with zipfile.ZipFile(path) as z:
        at = z.infolist()[3].header_offset
    data = bytearray(path.read_bytes())
    data[at + 60] ^= 0xFF
    path.write_bytes(bytes(data))
    rows = media.described(media.members(spark, f"file://{folder}", retries=1, range_bytes=700)).collect()
    assert len(rows) == 20 and [r.doc_id for r in rows if r.error] == [3]


def test_range_plan_covers_each_member_once(spark, tmp_path):
    folder = tmp_path / "b"
    df = spark.createDataFrame([(i, "x" * i) for i in range(30)], "doc_id long, text string").repartition(2)
    media.archived(df, "doc_id", "text", f"file://{folder}")
    for size in (100, 1000, 10**6):
        assert media.members(spark, f"file://{folder}", range_bytes=size).count() == 30


@pytest.mark.parametrize("rows", [1, 5, 9, 64, 1000])
def test_feature_equals_a_plain_version(rows):
    samples = np.random.default_rng(rows).integers(0, 256, (rows, 64), dtype=np.uint8)
    cut = [int(i * rows / 8) for i in range(9)]
    means = [[samples[a : max(b, a + 1), c : c + 7].sum() for c in range(0, 63, 7)] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    bits = "".join("01"[int(x > y)] for row in means for y, x in zip(row[:-1], row[1:], strict=True))
    assert media.feature(samples) == f"{int(bits, 2):016x}:{samples.mean():.4f}:{samples.std():.4f}"


def test_op10_keeps_errors(spark, saved):
    out = media.op10_media(spark, saved)
    assert "error" in out.columns and out.where("error is not null").count() == 0


# --- the queries themselves ---------------------------------------------------------------------------


def test_queries_equal_plain_versions(spark, saved, docs):
    """op2, op5, op6 and op7 as they are registered, over all documents."""
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.op2_repeats(spark, saved).collect()}
    assert got == {d: (n, g, hashlib.sha256(t.encode()).hexdigest()) for d, (n, g, t) in repeats.brute_force(docs).items()}
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.op6_jaccard(spark, saved).collect()}
    assert got == jaccard.brute_force(docs)
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.op7_licenses(spark, saved).collect()}
    assert got == {d: (x, round(s, 9)) for d, t in docs.items() for x, s in [plain_scan(low(t or "").encode())]}
    rows = packing.op5_packing(spark, saved).collect()
    assert {r.doc_id for r in rows} == set(docs) and all(r.length for r in rows)


@pytest.mark.parametrize(
    "run",
    [
        lambda d: quality.scored(d, quality.trained(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))),
        lambda d: pieces.encoded(d, "doc_id", "text"),
        lambda d: licenses.scanned(d, "doc_id", "text"),
    ],
    ids="3 4 7".split(),
)
def test_repeated_rows(spark, run):
    """Rows that repeat an id, with one text or several, and rows without an id come back each."""
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "MIT License"), (None, "x"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in run(df).collect()))) == ["1", "1", "1", "None", "None"]


def test_repeated_rows_of_media(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, None)], "doc_id long, text string")
    media.archived(df, "doc_id", "text", f"file://{tmp_path}/m")
    got = media.described(media.members(spark, f"file://{tmp_path}/m")).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == [("1", 1), ("1", 3), ("1", 3), ("None", 0)]


# --- empty tables ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "run",
    [
        lambda d: fingerprints.fingerprints(d, "doc_id", "text"),
        lambda d: repeats.drop_repeats(d, "doc_id", "text"),
        lambda d: quality.scored(d, quality.trained(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))),
        lambda d: pieces.encoded(d, "doc_id", "text"),
        lambda d: packing.packed(d, "doc_id", "text"),
        lambda d: jaccard.similarity_classes(d, "doc_id", "text"),
        lambda d: licenses.scanned(d, "doc_id", "text"),
    ],
    ids="1 2 3 4 5 6 7".split(),
)
def test_empty(empty, run):
    assert run(empty).count() == 0


def test_empty_media(spark, empty, tmp_path):
    media.archived(empty, "doc_id", "text", f"file://{tmp_path}/none")
    assert media.described(media.members(spark, f"file://{tmp_path}/none")).count() == 0


def test_empty_op9(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert chat.op9_chat(spark, str(tmp_path)).count() == 0


def test_empty_op1(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert fingerprints.op1_fingerprints(spark, str(tmp_path)).count() == 0
