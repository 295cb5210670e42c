"""The pipeline: each stage against a brute-force version on its own input."""

import zlib

import numpy as np

import corpus_pipeline as pipeline
from blockloom.llm import jaccard, packing, quality, repeats
from blockloom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def kept_by_quality(spark, saved, docs):
    """Documents whose text scores at the model's threshold, one by one."""
    import pyarrow as pa

    model = quality.trained(spark.read.parquet(f"{saved}/documents.parquet"), spark.read.parquet(f"{saved}/labels.parquet"))
    out = {}
    for d, t in docs.items():
        row, feature, value = quality.features(pa.array([t], pa.string()))
        if model.at_least(quality.scores_of(row, feature, value, 1, model.weights.astype(np.float32)))[0, -1] >= model.select:
            out[d] = t
    return out


def check_pieces(rows, docs):
    """Every id of every text, by the library, in exactly one piece."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4") for d, t in docs.items()}
    by = {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    assert set(by) == set(docs)
    for d, x in by.items():
        x.sort()
        assert [a for a, _ in x] == [0, *(b for _, b in x[:-1])] and x[-1][1] == len(ids[d])


def test_stages(spark, saved, docs):
    frame = spark.read.parquet(f"{saved}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "packing"]

    kept = written(pipeline.quality(spark, frame, saved), "t")
    assert kept.columns == COLUMNS and texts(kept) == kept_by_quality(spark, saved, docs)

    alone = written(pipeline.near_duplicates(spark, frame, saved), "t")
    classes = jaccard.brute_force(docs)
    assert alone.columns == COLUMNS and set(texts(alone)) == {c for c, _, _ in classes.values()}

    cut = pipeline.substrings(spark, alone, saved)
    want = repeats.brute_force(texts(alone))
    assert cut.columns == COLUMNS
    for r in cut.collect():
        n, gone, text = want[r.doc_id]
        assert r.text == (text if gone else docs[r.doc_id]) and (not gone or r.n_chars == len(text))

    check_pieces(pipeline.packing(spark, cut, saved).collect(), texts(cut))


def test_run_is_the_chain_of_plain_stages(spark, saved, docs):
    kept = kept_by_quality(spark, saved, docs)
    alone = {d: t for d, t in kept.items() if jaccard.brute_force(kept)[d][0] == d}
    cut = {d: text if gone else alone[d] for d, (_, gone, text) in repeats.brute_force(alone).items()}
    assert cut and len(cut) < len(docs)
    check_pieces(pipeline.run(spark, saved).collect(), cut)


def test_repeated_and_missing_ids(spark, saved):
    """Rows without an id stay; rows of one id stay or go together."""
    t = " ".join(map(str, range(80)))
    rows = [(5, t), (5, t), (5, "other words"), (6, t + " x"), (None, t), (None, None), (7, "")]
    frame = spark.createDataFrame([(d, x, "en", "s", None) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicates(spark, frame, saved).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "5", "7", "None", "None"]
    for name, stage in pipeline.STAGES:
        out = stage(spark, frame, saved).collect()
        assert name == "near_duplicates" or {str(r.doc_id) for r in out} <= {"5", "6", "7", "None"}


def test_empty(spark, saved, empty):
    none = empty.select(*COLUMNS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, saved).count() == 0
