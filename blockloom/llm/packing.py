"""Packing along a space-filling curve.

Every document becomes token ids plus an end id.  Its ids are hashed into a
256-place vector, scaled to length one and projected to three dimensions.  The
projections, scaled by the corpus's own mean and deviation, give a Hilbert key.
Documents are range-sorted by that key and neighbours on the curve are packed
into sequences, cut wherever a sequence is full.  What is left at the end of a
range is cut into powers of two, which need no padding.

Ranges hold about equally many ids: a histogram of ids over the first ``CELL_BITS``
bits of the key, whose size is fixed, is cut into them.  A cell that holds
more than one range's ids, such as a group of copies, is spread over
ranges of its own.  Long documents travel in segments, so no row is
large.  Tokens are made once and written to the shared folder.

Defined cases: null and empty texts are the end id alone; a null doc_id is
packed like any other; repeated rows are documents of their own; extra columns
are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import ship, table, task_threads, written
from blockloom.llm.words import slices

LENGTH = 2048
END_ID = 1
#: Places of the hashed vector, dimensions of the curve and bits of each.
PLACES, DIMS, BITS = 256, 3, 16
#: Bytes of token ids in a range, ids in a row, and bits of the key that number the cells of the histogram.
RANGE_BYTES = 2 << 20
SEGMENT = 1 << 15
CELL_BITS = 15
#: Row of a sequence id: its range in the high bits.
RANGE_SHIFT = 32

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The byte-level BPE of a ``tokenizers`` file, run by the rank-merge engine of ``tiktoken``.

    The file's token strings are read back to bytes and its ids taken as merge
    ranks; its added tokens are found in texts before anything is split.  Ids
    equal those of the ``tokenizers`` library at its default setting, without
    tokens put around a text (the tests compare them).
    """
    import public_tokenizers
    import tiktoken

    task_threads()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from 256 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    added = {t["content"]: t["id"] for t in model["added_tokens"]}
    if any(t.get(k) for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} has added tokens that match by what stands around them")
    if max(len(model["model"]["vocab"]), 1 + max([*added.values(), *model["model"]["vocab"].values()])) > 1 << 16:
        raise ValueError(f"{path} has ids above 65535, which rows of 16-bit ids can't hold")
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if i not in added.values()}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def projection() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).standard_normal((PLACES, DIMS)) / math.sqrt(PLACES)


def places(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points (rows x dims, ``bits`` bits each).

    Bits are taken from the top.  Each level's cell is turned into the curve's
    frame (exchange or invert the lower bits), then the cells' Gray codes are
    undone and their bits interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        below = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(set_, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(df: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """Rows of at most ``SEGMENT`` ids: ``doc_id, start`` (ids of the document before it), ``doc_tokens, ids`` (16-bit little endian, end id last) and the document's projections ``x0..``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, project = byte_bpe(tokenizer), projection()
        names = ["doc_id", "start", "doc_tokens", "ids", *(f"x{i}" for i in range(DIMS))]
        for batch in slices(batches, "text", 1 << 20):
            ids = [np.append(bpe.encode_to_numpy(t or "", allowed_special="all"), END_ID).astype("<u2") for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in ids])
            flat = np.concatenate(ids)
            vectors = np.bincount(np.repeat(np.arange(len(n)), n) * PLACES + places(flat), minlength=len(n) * PLACES).reshape(-1, PLACES).astype(float)
            spots = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ project
            cuts = [(d, at) for d, x in enumerate(ids) for at in range(0, len(x), SEGMENT)]
            of = np.array([d for d, _ in cuts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), pa.array([at for _, at in cuts], pa.int64()), pa.array(n[of], pa.int64()), pa.array([ids[d][at : at + SEGMENT].tobytes() for d, at in cuts], pa.binary()), *(pa.array(spots[of, i]) for i in range(DIMS))], names=names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, start long, doc_tokens long, ids binary, " + ", ".join(f"x{i} double" for i in range(DIMS)))


def pieces_of(segments: Iterator[tuple[int | None, int, int, np.ndarray]], part: int, length: int) -> Iterator[tuple]:
    """Pieces of segments (document, start, ids of the document, ids) in their order: full sequences, then the rest as powers of two."""
    held: list[tuple[int | None, int, np.ndarray, int]] = []
    fill, number = 0, 0

    def sequence(now: list[tuple[int | None, int, np.ndarray, int]]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in now:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, (part << RANGE_SHIFT) + number, at
            at += len(ids)

    for doc, start, total, ids in segments:
        pos = 0
        while pos < len(ids):
            take = min(len(ids) - pos, length - fill)
            held.append((doc, start + pos, ids[pos : pos + take], total))
            fill, pos = fill + take, pos + take
            if fill == length:
                yield from sequence(held)
                held, fill, number = [], 0, number + 1
    while fill:
        room = 1 << (fill.bit_length() - 1)
        fill -= room
        now: list[tuple[int | None, int, np.ndarray, int]] = []
        while room:
            doc, start, ids, total = held.pop(0)
            take = min(room, len(ids))
            now.append((doc, start, ids[:take], total))
            if take < len(ids):
                held.insert(0, (doc, start + take, ids[take:], total))
            room -= take
        yield from sequence(now)
        number += 1


def dealt(cells: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(first range, ranges) of each cell of the curve, for ranges of about ``most`` of what ``cells`` count."""
    before = np.concatenate([[0], np.cumsum(cells)])
    first = (before[:-1] // most).astype(np.int64)
    # A large cell gets the ranges that start inside it; cells after it start after those.
    n = np.maximum(1, ((before[1:] - 1e-9) // most).astype(np.int64) - first)
    big = cells > most
    return first + big, np.where(big, n, 1)


def packed(df: DataFrame, id_col: str, text_col: str, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents of ``df``, packed along the curve (``PIECES``)."""
    spark = df.sparkSession
    ship(spark)
    docs = written(tokenised(df, id_col, text_col, tokenizer or default_tokenizer()), "tokens")
    stats = docs.where("start = 0").agg(*(f(f"x{i}").alias(f"{a}{i}") for i in range(DIMS) for f, a in ((F.mean, "m"), (F.stddev_pop, "s")))).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(DIMS)])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(DIMS)])
    names = [f"x{i}" for i in range(DIMS)]

    def keys(xs: list[np.ndarray]) -> np.ndarray:
        z = (np.stack(xs, 1) - mean) / scale
        # The logistic curve spreads values about evenly over the grid.
        grid = np.minimum((1 / (1 + np.exp(-1.7 * z)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        return hilbert(grid, BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << CELL_BITS)
        for b in batches:
            cell = keys([np.asarray(b.column(x)) for x in names]) >> (BITS * DIMS - CELL_BITS)
            n = np.asarray(b.column("n"))
            sums += np.bincount(cell, weights=n, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at].astype(np.int64))], names=["cell", "n"])

    # The histogram has a fixed number of cells, whatever the corpus.
    counted = docs.where("start = 0").select(F.col("doc_tokens").alias("n"), *names).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(1 << CELL_BITS)
    cells[counted["cell"]] = counted["n"]
    first, n_ranges = dealt(cells, RANGE_BYTES / 2)
    held = spark.sparkContext.broadcast((first, n_ranges))

    @F.pandas_udf("range long, key long")
    def place(salt: pd.Series, *xs: pd.Series) -> pd.DataFrame:
        start, n = held.value
        key = keys([x.to_numpy() for x in xs])
        cell = key >> (BITS * DIMS - CELL_BITS)
        return pd.DataFrame({"range": start[cell] + salt.to_numpy().astype(np.uint64) % n[cell].astype(np.uint64), "key": key})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, d, s, t, np.frombuffer(ids.as_buffer(), "<u2")) for b in batches for r, d, s, t, ids in zip(*(b.column(c).to_pylist() for c in ("range", "doc_id", "start", "doc_tokens")), b.column("ids"), strict=True))
        out: list[tuple] = []
        for part, own in groupby(rows, key=lambda r: r[0]):
            for row in pieces_of((r[1:] for r in own), part, length):
                out.append(row)
                if len(out) == 20_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    # Copies, rows of one document, and rows without an id are dealt by content and place.
    salt = F.xxhash64("doc_id", "start", F.spark_partition_id())
    keyed = docs.select("doc_id", "start", "doc_tokens", "ids", place(salt, *names).alias("p")).select("p.range", "p.key", "doc_id", "start", "doc_tokens", "ids")
    return keyed.repartition("range").sortWithinPartitions("range", "key", "doc_id", "start", "ids").select("range", "doc_id", "start", "doc_tokens", "ids").mapInArrow(pack, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"), "doc_id", "text")
