"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings are grades 0 < 1 < 2: junk, fluent but toxic, clean.  One weight vector
over hashed features gives a document's score s; ordered thresholds t_k turn it
into P(grade >= k) = logistic(s - t_k), hence an expected grade and the tail
probability of the top grade, on which documents are selected.

Features: presence of each distinct word (letters and digits, ASCII lower case)
and of the stems of longer ones, and as shares of all words the last
two bytes of words, the kind of their first and last byte, and words equal to
the one before.

The model is fitted on at most ``FIT_ROWS`` labelled documents, taken in the
order of a hash of their ids; every document is scored.  The selection
threshold is the tail probability at which the fewest of those documents are on
the wrong side, clean ones lost and others kept alike; each is scored for that
by a model fitted without its part (of ``FOLDS``), so all of them count.

Defined cases: a null or empty text has no features and so the score 0 plus
bias; labels with a null are not fitted on; a document labelled twice is fitted
on twice, and so is an id that stands on two rows, within ``FIT_ROWS`` in all; without labels, or with one grade only, everything scores as the top
grade and is kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import ship, table
from blockloom.llm.words import byte_class, flat, mix, slices, spans, word_hashes

#: Bound of the fitting sample, and parts of it that are held out in turn.
FIT_ROWS = 6000
FOLDS = 5
GRADES = 3
WORD_BITS, TAIL_BITS = 18, 12
STEPS, RATE, SHRINK = 250, 0.1, 1e-4
#: Values of a word's presence and of a share of one.
PRESENT, SHARE = 2.0, 8.0
#: First bytes of longer words that stand for their stems.
STEMS = (4, 5)
#: Words and stems get a weight if so many fitted documents have them and their frequency differs by so many deviations between neighbouring grades.
LEAST_DOCS, LEAST_Z = 6, 5.0

_TAILS = 1 << WORD_BITS
_KINDS = _TAILS + (1 << TAIL_BITS)
_AGAIN = _KINDS + 64
SIZE = _AGAIN + 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = byte_class(bytes([*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]))
_KIND = np.full(256, 0, np.int64)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", range(0x80, 0x100))):
    _KIND[list(_set)] = _i + 1


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the texts, ascending by row and feature."""
    buf, offsets = flat(texts)
    starts, ends, first = spans(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    hashes = word_hashes(buf, starts, ends)[0]
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    low = _LOWER[buf]
    s, e, f = spans(low, offsets, _LETTER)
    of = np.repeat(np.arange(len(n)), np.diff(f)) * SIZE
    names = [of + (word_hashes(low, s, e)[0] >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
    for k in STEMS:
        long = e - s > k
        stem = mix(word_hashes(low, s[long], s[long] + k)[0] + np.uint64(k))
        names.append(of[long] + (stem >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    last = buf[ends - 1].astype(np.int64)
    before = buf[np.maximum(ends - 2, starts)].astype(np.int64)
    tails = _TAILS + (mix((before * 256 + last).astype(np.uint64)) >> np.uint64(64 - TAIL_BITS)).astype(np.int64)
    kinds = _KINDS + _KIND[buf[starts]] * 8 + _KIND[last]
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    seen = np.unique(np.concatenate(names))
    shares, count = np.unique(np.concatenate([row * SIZE + tails, row * SIZE + kinds, row[again] * SIZE + _AGAIN]), return_counts=True)
    code = np.concatenate([seen, shares])
    value = np.concatenate([np.full(len(seen), PRESENT), SHARE * count / n[shares // SIZE]])
    order = np.argsort(code)
    return code[order] // SIZE, code[order] % SIZE, value[order]


@dataclass
class Model:
    """Shared weights, ordered thresholds and the selection threshold."""

    weights: np.ndarray
    cuts: np.ndarray
    select: float

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. (rows x grades-1)."""
        return logistic(scores[:, None] - self.cuts[None, :])


def scores_of(row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(row, weights=value * weights[feature], minlength=n)


def telling(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int) -> np.ndarray:
    """Which features get a weight: shares all, words as LEAST_DOCS and LEAST_Z say."""
    docs = np.array([np.bincount(feature[grade[row] == k], minlength=SIZE) for k in range(grades)], dtype=float)
    n = np.bincount(grade, minlength=grades).astype(float)
    out = np.arange(SIZE) >= _TAILS
    for k in range(grades - 1):  # neighbouring grades
        a, b, na, nb = docs[k], docs[k + 1], max(n[k], 1), max(n[k + 1], 1)
        share = (a + b + 0.5) / (na + nb + 1)
        z = np.abs(a / na - b / nb) / np.sqrt(share * (1 - share) * (1 / na + 1 / nb) + 1e-12)
        out |= (a + b >= LEAST_DOCS) & (z >= LEAST_Z)
    return out


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean negative log-likelihood; each grade weighs alike."""
    n = len(grade)
    known = telling(row, feature, grade, grades)
    row, feature, value = (x[known[feature]] for x in (row, feature, value))
    # Only the weights that are fitted take part; the others stay 0.
    names = np.flatnonzero(known)
    feature = np.searchsorted(names, feature)
    weigh = (n / grades / np.maximum(np.bincount(grade, minlength=grades), 1))[grade] / n
    w, cuts = np.zeros(len(names)), np.arange(1, grades) - grades / 2
    free = np.concatenate([[cuts[0]], np.log(np.diff(cuts))])
    state = [np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(free)), np.zeros(len(free))]
    for step in range(1, STEPS + 1):
        cuts = np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])
        s = scores_of(row, feature, value, n, w)
        # P(grade <= k) between the borders 0 and 1.
        up = np.concatenate([np.zeros((n, 1)), logistic(cuts[None, :] - s[:, None]), np.ones((n, 1))], 1)
        hi, lo = up[np.arange(n), grade + 1], up[np.arange(n), grade]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p * weigh, lo * (1 - lo) / p * weigh
        g = dhi - dlo  # of the loss by the score
        gw = np.bincount(feature, weights=value * g[row], minlength=len(w)) + SHRINK * w
        gc = np.zeros(grades - 1)
        np.add.at(gc, np.minimum(grade, grades - 2)[grade < grades - 1], -dhi[grade < grades - 1])
        np.add.at(gc, grade[grade > 0] - 1, dlo[grade > 0])
        gf = np.concatenate([[gc.sum()], np.exp(free[1:]) * np.cumsum(gc[::-1])[::-1][1:]])
        for i, (x, d) in enumerate(((w, gw), (free, gf))):
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(SIZE)
    weights[names] = w
    return weights, np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])


def threshold(tail: np.ndarray, clean: np.ndarray) -> float:
    """The tail probability, at most 0.5, that puts the fewest documents on the wrong side; the least of several. 0 without clean ones."""
    if not clean.any():
        return 0.0
    at = np.unique(np.minimum(tail[clean], 0.5))
    lost = np.searchsorted(np.sort(tail[clean]), at)
    kept = (~clean).sum() - np.searchsorted(np.sort(tail[~clean]), at)
    return float(at[np.argmin(lost + kept)])


def held_out_tails(feature: list[np.ndarray], value: list[np.ndarray], grades: np.ndarray, model: Model) -> np.ndarray:
    """Tail probability of each document by a model that was fitted without its part; by ``model`` where the others have one grade only."""
    # Parts by content: copies are held out together, and the order of rows does not matter.
    part = np.array([int(x[:: max(1, len(x) // 7)].sum()) % FOLDS for x in feature])
    tail = np.zeros(len(grades))
    for k in np.unique(part):
        own, rest = np.flatnonzero(part == k), np.flatnonzero(part != k)
        one = model
        if len(np.unique(grades[rest])) > 1:
            one = Model(*fit(*_stacked([feature[i] for i in rest], [value[i] for i in rest]), grades[rest]), 0.0)
        r, f, v = _stacked([feature[i] for i in own], [value[i] for i in own])
        tail[own] = one.at_least(scores_of(r, f, v, len(own), one.weights))[:, -1]
    return tail


def featured(df: DataFrame) -> DataFrame:
    """``at``, ``grade`` and the features of ``text``, as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            row, feature, value = features(batch.column("text"))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            parts = [(feature[i:j].astype(np.int32).tobytes(), value[i:j].astype(np.float32).tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("grade"), pa.array([a for a, _ in parts], pa.binary()), pa.array([b for _, b in parts], pa.binary())], names=["at", "grade", "feature", "value"])

    return df.select("at", "grade", "text").mapInArrow(rows, "at long, grade int, feature binary, value binary")


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """A model from ``labels`` (doc_id, quality, toxic) of ``docs``."""
    ship(docs.sparkSession)
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").alias("rated_id"), grade.cast("int").alias("grade"))
    some = rated.orderBy(F.xxhash64("rated_id"), "rated_id", "grade").limit(fit_rows)
    # At most fit_rows ids: their size is bounded by the parameter, and so is what comes back, however often an id stands in ``docs``.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("id") == F.col("rated_id"))
    got = featured(rows.select("grade", "text", F.xxhash64("id", "text", "grade").alias("at"))).orderBy("at", "feature", "value").limit(fit_rows).toArrow()
    # In an order of content, so that the fit does not depend on the order of tasks.
    got = got.sort_by([("feature", "ascending"), ("grade", "ascending")]).combine_chunks()
    grades = got["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grades)) < 2:
        return Model(np.zeros(SIZE), np.full(GRADES - 1, -20.0), 0.0)
    feature, value = (_parts(got[c], t) for c, t in (("feature", np.int32), ("value", np.float32)))
    # Words of too few documents get no weight in any fit; without them the driver holds a fraction.
    often = np.zeros(SIZE, np.int64)
    for f in feature:
        often[f] += 1
    often = (often >= LEAST_DOCS) | (np.arange(SIZE) >= _TAILS)
    value = [v[often[f]] for f, v in zip(feature, value, strict=True)]
    feature = [f[often[f]] for f in feature]
    del got
    pa.default_memory_pool().release_unused()
    model = Model(*fit(*_stacked(feature, value), grades), 0.0)
    model.select = threshold(held_out_tails(feature, value, grades, model), grades == GRADES - 1)
    return model


def _parts(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The values of a binary column as arrays of ``kind`` that share its buffer."""
    (data,) = column.chunks
    ends = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, 4 * data.offset)
    flat = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    return [flat[i:j].view(kind) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _stacked(feature: list[np.ndarray], value: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(feature)), [len(x) for x in feature]), np.concatenate(feature).astype(np.int64), np.concatenate(value).astype(float)


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, keep`` of every row, with ``text`` where it is in ``carry`` and the other columns named there."""
    spark = df.sparkSession
    ship(spark)
    # The model's size is fixed by its parameters (about 1 MB), whatever the corpus.
    held = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts, model.select))
    names = [f"carry_{i}" for i in range(len(carry))]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(a) for c, a in zip(carry, names, strict=True)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts, select = held.value
        own = Model(weights, cuts, select)
        for batch in slices(batches, "text", 1 << 20):
            row, feature, value = features(batch.column("text"))
            p = own.at_least(scores_of(row, feature, value, batch.num_rows, weights))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.sum(1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= select), *(batch.column(c) for c in names)], names=["doc_id", "expected_grade", "tail_probability", "keep", *names])

    schema = f"doc_id {kinds['doc_id']}, expected_grade double, tail_probability double, keep boolean" + "".join(f", {c} {kinds[c]}" for c in names)
    return rows.mapInArrow(score, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))
