"""Substring dedup with fixed-block anchors.

A window is ``width`` consecutive words.  Every text is cut into
non-overlapping reference blocks of ``(width + 1) // 2`` words, so each window
holds one whole block of its own text.  The texts are dealt into chunks of a few
MB; three passes go over a chunk, with two exchanges of hashes between them:

1. index and probe: a chunk sends its block hashes and the hashes of all its
   rolling windows of block width to the bins that own them; a block that also
   stands anywhere else is an anchor;
2. extend: every window around an anchor, to the left and right, is a candidate;
   candidates meet in bins by 128-bit hashes, and a chunk is told which of
   its candidates stand in another chunk too;
3. remove: runs of windows that repeat are the maximal exact repeats and lose
   their words.

Answers name the hashes they speak of, so no pass depends on the order of rows,
which differs between reads of a shuffle; an answer that fits nothing raises.

What is sent grows in proportion to the text: each chunk sends one message at
most to each of 2 to the power ``FAN_BITS`` bins.  Where bins would outgrow a
task (``RANGE_BYTES`` of text each), another level deals every bin's hashes to
as many bins again, by tasks that stream over parts of a bin; levels grow with
the logarithm of the corpus.  Copies collapse within chunks and within bins, and
nothing is ever paired, so a group of copies costs what its text costs.

Windows are equal if two 64-bit hashes are, made from two independent hashes of
each word's bytes (see ``words``): two different windows have equal ones with
a probability of about 2**-114.

Defined cases: null and empty texts have no words; rows that repeat (same id
and text) are occurrences of their own; extra columns are carried only when
named in ``carry``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import ship, table, text_bytes
from blockloom.llm.words import flat, mask_inside, respaced, spans, window_hashes, word_hashes

WINDOW = 35
#: Bytes of text in a chunk, and of the text whose hashes a bin may hold.
CHUNK_BYTES = 4 << 20
RANGE_BYTES = 96 << 20
#: Each level deals hashes to 2 to this power bins.
FAN_BITS = 10
#: Hashes that a task regroups at once.
REGROUP = 1 << 20
#: Bits of a block hash that are sent beyond those that number the windows: one in 2 to this power anchors is a chance hit, a candidate that the 128-bit hashes then reject.
SPARE_BITS = 14

#: ``rolling`` and ``twice`` (those of ``rolling`` that occur again): block-wide windows; ``high``, ``low``, ``owner``: hashes whose chunk wants an answer.
SENT = "bin long, salt int, rolling binary, twice binary, high binary, low binary, owner binary"
#: Kinds of answers: anchored blocks; windows of a bin that repeat; windows of a bin that don't, where all others do.
ANCHORS, THESE, OTHERS = 0, 1, 2
ANSWER = "chunk int, kind int, bin long, high binary, low binary"

_NONE = np.zeros(0, np.uint64)


def deltas(values: np.ndarray) -> bytes:
    """Ascending uint64 values as bytes: the first, then 32-bit steps by byte planes, where they fit."""
    if not len(values):
        return b""
    steps = np.diff(values)
    if len(steps) and int(steps.max()) >> 32:
        return b"\x01" + values.tobytes()
    # The high plane is nearly constant, which the shuffle's compression takes out.
    planes = steps.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return b"\x00" + values[:1].tobytes() + planes.tobytes()


def undeltas(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    if data[0]:
        return np.frombuffer(data, np.uint64, offset=1)
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(4, -1)
    out = np.empty(planes.shape[1] + 1, np.uint64)
    out[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64, out=out[1:])
    out[1:] += out[0]
    return out


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    if len(values):
        edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])).tolist()
        yield from zip(edges[:-1], edges[1:], strict=True)


def ordered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """An order by both hashes."""
    order = np.argsort(high)
    h, w = high[order], low[order]
    if ((h[1:] == h[:-1]) & (w[1:] != w[:-1])).any():  # rare: different windows with one high hash
        order = np.lexsort((low, high))
    return order


class Chunk:
    """The words, anchors and candidate windows of one chunk of texts."""

    def __init__(self, texts: pa.ChunkedArray, width: int, bits: int) -> None:
        self.width, self.block, self.bits = width, (width + 1) // 2, bits
        self.buf, self.offsets = flat(texts)
        self.starts, self.ends, self.first = spans(self.buf, self.offsets)
        self.words = word_hashes(self.buf, self.starts, self.ends, 2)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rolling, at, hashes): the hashes of all block-wide windows; the starts of reference blocks and their hashes."""
        whole = mask_inside(self.first, self.block)
        all_hashes = window_hashes(self.words[0], self.block) >> np.uint64(64 - self.bits)
        counts = np.diff(self.first) // self.block
        at = np.repeat(self.first[:-1], counts) + self.block * (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
        return all_hashes[whole], at, all_hashes[at] if len(at) else np.zeros(0, np.uint64)

    def candidates(self, at: np.ndarray, anchored: np.ndarray) -> np.ndarray:
        """Starts of the windows whose reference block is anchored."""
        n = self.words.shape[1] - self.width + 1
        if n <= 0 or not anchored.any():
            return np.zeros(0, np.int64)
        edge = np.zeros(self.words.shape[1] + 1, np.int32)
        hot = at[anchored]
        text = np.searchsorted(self.first, hot, "right") - 1
        lo = np.maximum(hot - (self.block - 1), self.first[text])
        np.add.at(edge, lo, 1)
        np.add.at(edge, hot + 1, -1)
        return np.flatnonzero((np.cumsum(edge)[:n] > 0) & mask_inside(self.first, self.width))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(high, low, inverse, count): the distinct hashes in ascending order of windows at ``starts``, each window's place there, and how often each stands in the chunk."""
        high = window_hashes(self.words[0], self.width)[starts]
        low = window_hashes(self.words[1], self.width, 1)[starts]
        order = ordered(high, low)
        h, w = high[order], low[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        group = np.cumsum(fresh) - 1
        inverse = np.empty(len(h), np.int64)
        inverse[order] = group
        return h[fresh], w[fresh], inverse, np.bincount(group, minlength=int(fresh.sum()))

    def removed(self, starts: np.ndarray) -> np.ndarray:
        """For each word, whether a window at ``starts`` covers it."""
        edge = np.zeros(self.words.shape[1] + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.width, -1)
        return np.cumsum(edge)[: self.words.shape[1]] > 0

    def kept(self, gone: np.ndarray) -> pa.Array:
        """The texts' remaining words, joined by one space."""
        stay, n = ~gone, len(self.offsets) - 1
        text = np.repeat(np.arange(n), np.diff(self.first))
        data, offsets = respaced(self.buf, self.starts[stay], self.ends[stay], text[stay], n)
        return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


class Plan:
    """How hashes of ``bits`` bits are dealt: ``levels`` of 2 to the power ``fan`` bins, and in how many parts a level's bins are regrouped."""

    def __init__(self, bits: int, fan: int, ranges: int) -> None:
        self.bits, self.fan, self.levels = bits, fan, 1
        while 1 << self.levels * fan < ranges and (self.levels + 1) * fan <= bits:
            self.levels += 1
        self.parts = [max(1, -(-ranges >> level * fan)) for level in range(1, self.levels)] + [1]

    def bins(self, values: np.ndarray, level: int) -> Iterator[tuple[int, int, int]]:
        """(bin, start, end) of each bin of ``level`` that has some of the ascending ``values``."""
        of = (values >> np.uint64(self.bits - self.fan * level)).astype(np.int64)
        for i, j in runs(of):
            yield int(of[i]), i, j

    def messages(self, level: int, salt: int, rolling: np.ndarray, twice: np.ndarray, high: np.ndarray, low: np.ndarray, owner: np.ndarray) -> Iterator[tuple]:
        """One message (``SENT``) for each bin of ``level`` that gets anything; hashes ascend, low ones and owners stand beside the high ones."""
        cuts: dict[int, list[tuple[int, int]]] = {}
        for k, values in enumerate((rolling, twice, high)):
            for b, i, j in self.bins(values, level):
                cuts.setdefault(b, [(0, 0)] * 3)[k] = (i, j)
        for b, ((r, s), (t, u), (i, j)) in cuts.items():
            own = owner[i:j]
            if len(own) and (own == own[0]).all():
                own = own[:1]
            yield b, salt % self.parts[level - 1], deltas(rolling[r:s]), deltas(twice[t:u]), deltas(high[i:j]), low[i:j].tobytes(), own.tobytes()


class Bin:
    """What some messages of one bin say together."""

    def __init__(self, messages: list[tuple]) -> None:
        rolling = np.sort(np.concatenate([undeltas(m[2]) for m in messages]))
        again = rolling[1:] == rolling[:-1]
        self.twice = np.unique(np.concatenate([rolling[1:][again], *(undeltas(m[3]) for m in messages)]))
        self.rolling = rolling[np.concatenate([[True], ~again])] if len(rolling) else rolling
        high = [undeltas(m[4]) for m in messages]
        owner = [np.frombuffer(m[6], np.int32) for m in messages]
        owner = np.concatenate([o if len(o) == len(h) else np.full(len(h), o[0], np.int32) for o, h in zip(owner, high, strict=True)])
        low, high = np.concatenate([np.frombuffer(m[5], np.uint64) for m in messages]), np.concatenate(high)
        order = ordered(high, low) if len(low) else np.argsort(high)
        self.high, self.low, self.owner = high[order], low[order] if len(low) else low, owner[order]

    def by_owner(self, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(chunk, those of the places ``which`` whose hashes are its own, ascending)."""
        order = np.argsort(self.owner[which], kind="stable")
        own = self.owner[which][order]
        for i, j in runs(own):
            yield int(own[i]), which[order[i:j]]

    def anchors(self, number: int) -> Iterator[tuple]:
        """For each chunk, which of its blocks stand anywhere else."""
        at = np.searchsorted(self.twice, self.high)
        hit = at < len(self.twice)
        hit[hit] = self.twice[at[hit]] == self.high[hit]
        for chunk, own in self.by_owner(np.flatnonzero(hit)):
            yield chunk, ANCHORS, number, deltas(self.high[own]), b""

    def repeats(self, number: int) -> Iterator[tuple]:
        """For each chunk that shares windows with another, which are shared or which aren't, whichever are fewer."""
        same = (self.high[1:] == self.high[:-1]) & (self.low[1:] == self.low[:-1])
        found = np.zeros(len(self.high), bool)
        found[1:] |= same
        found[:-1] |= same
        for chunk, own in self.by_owner(np.arange(len(self.high))):
            yes = found[own]
            if yes.any():
                kind = THESE if 2 * yes.sum() <= len(yes) else OTHERS
                told = own[yes if kind == THESE else ~yes]
                yield chunk, kind, number, deltas(self.high[told]), self.low[told].tobytes()


def _batches(rows: Iterator[tuple], schema: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``most`` bytes, one at least."""
    fields = [pa.field(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in schema.split(", "))]
    held: list[tuple] = []
    size, some = 0, False

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes)) + 32
        if size >= most:
            yield batch()
            held, size, some = [], 0, True
    if held or not some:
        yield batch()


def by_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[tuple]]]:
    """((bin, salt), its messages) of batches that are sorted by both."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda m: m[:2])


def regrouped(batches: Iterator[pa.RecordBatch], plan: Plan, level: int) -> Iterator[pa.RecordBatch]:
    """Messages to bins of the level before dealt to those of ``level``, about ``REGROUP`` hashes at a time; messages to chunks pass through."""

    def rows() -> Iterator[tuple]:
        for (number, salt), messages in by_bin(batches):
            held: list[tuple] = []
            size = 0
            for m in messages:
                if number < 0:
                    yield m
                    continue
                held.append(m)
                size += (len(m[2]) + len(m[4])) // 4
                if size >= REGROUP:
                    b = Bin(held)
                    yield from plan.messages(level, salt, b.rolling, b.twice, b.high, b.low, b.owner)
                    held, size = [], 0
            if held:
                b = Bin(held)
                yield from plan.messages(level, salt, b.rolling, b.twice, b.high, b.low, b.owner)

    return _batches(rows(), SENT)


def answered(batches: Iterator[pa.RecordBatch], say: Callable[[Bin, int], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """What ``say`` has for each whole bin; a message to a chunk (its bin is -1 - chunk) becomes its answer."""

    def rows() -> Iterator[tuple]:
        for (number, _), messages in by_bin(batches):
            if number < 0:
                yield from ((-1 - number, ANCHORS, number, m[4], b"") for m in messages)
            else:
                yield from say(Bin(list(messages)), number)

    return _batches(rows(), ANSWER)


def exchanged(sent: DataFrame, plan: Plan, say: Callable[[Bin, int], Iterator[tuple]]) -> DataFrame:
    """``ANSWER`` rows for the messages ``sent``."""

    def again(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        return lambda batches: regrouped(batches, plan, level)

    for level in range(2, plan.levels + 1):
        sent = sent.repartition("bin", "salt").sortWithinPartitions("bin", "salt").mapInArrow(again(level), SENT)
    return sent.repartition("bin").sortWithinPartitions("bin", "salt").mapInArrow(lambda batches: answered(batches, say), ANSWER)


def probe(texts: pa.ChunkedArray, chunk: int, plan: Plan, width: int) -> Iterator[tuple]:
    """Pass 1 for one chunk: its blocks and rolling windows, dealt to bins."""
    rolling, _, blocks = Chunk(texts, width, plan.bits).anchors()
    rolling = np.sort(rolling)
    fresh = np.ones(len(rolling), bool)
    fresh[1:] = rolling[1:] != rolling[:-1]
    blocks = np.unique(blocks)
    return plan.messages(1, chunk, rolling[fresh], np.unique(rolling[~fresh]), blocks, _NONE, np.full(len(blocks), chunk, np.int32))


def anchored(c: Chunk, said: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hot): a chunk's candidate windows, and the hashes of its anchored blocks."""
    told = zip(said["kind"].to_pylist(), said["high"].to_pylist(), strict=True)
    hot = np.unique(np.concatenate([_NONE, *(undeltas(h) for kind, h in told if kind == ANCHORS)]))
    _, at, blocks = c.anchors()
    if not np.isin(hot, blocks).all():
        raise RuntimeError("an answer names blocks that the chunk doesn't have")
    return c.candidates(at, np.isin(blocks, hot)), hot


def extend(texts: pa.ChunkedArray, said: pa.Table, chunk: int, plan: Plan, width: int, block_bits: int) -> Iterator[tuple]:
    """Pass 2 for one chunk: its candidate windows, dealt to bins, and its anchors to itself."""
    if not said.num_rows:
        return
    c = Chunk(texts, width, block_bits)
    starts, hot = anchored(c, said)
    if len(starts):
        high, low, _, _ = c.windows(starts)
        yield -1 - chunk, 0, b"", b"", deltas(hot), b"", b""
        yield from plan.messages(1, chunk, _NONE, _NONE, high, low, np.full(len(high), chunk, np.int32))


def repeated(high: np.ndarray, low: np.ndarray, said: pa.Table, plan: Plan) -> np.ndarray:
    """Which of a chunk's distinct windows, in order, stand in other chunks too."""
    out = np.zeros(len(high), bool)
    shift = plan.bits - plan.fan * plan.levels
    for kind, number, told_high, told_low in zip(*(said[x].to_pylist() for x in ("kind", "bin", "high", "low")), strict=True):
        if kind == ANCHORS:
            continue
        start = int(np.searchsorted(high, np.uint64(number << shift)))
        end = int(np.searchsorted(high, np.uint64((number + 1 << shift) - 1), "right"))
        h, w, told = undeltas(told_high), np.frombuffer(told_low, np.uint64), np.zeros(end - start, bool)
        at, n = start + np.searchsorted(high[start:end], h), len(h)
        while len(at):  # a second step only where windows share a high hash
            ok = at < end
            ok[ok] = high[at[ok]] == h[ok]
            at, h, w = at[ok], h[ok], w[ok]
            hit = low[at] == w
            told[at[hit] - start] = True
            at, h, w = at[~hit] + 1, h[~hit], w[~hit]
        if told.sum() != n:
            raise RuntimeError("an answer names windows that the chunk doesn't have")
        out[start:end] = told if kind == THESE else ~told
    return out


def remove(texts: pa.ChunkedArray, said: pa.Table, plan: Plan, width: int, block_bits: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pass 3 for one chunk: for each text its words, how many go, and the text of those that stay."""
    c = Chunk(texts, width, block_bits)
    gone = np.zeros(c.words.shape[1], bool)
    if said.num_rows:
        starts, _ = anchored(c, said)
        high, low, inverse, count = c.windows(starts)
        again = (count > 1) | repeated(high, low, said, plan)
        gone = c.removed(starts[again[inverse]])
    total = np.concatenate([[0], np.cumsum(gone)])
    return np.diff(c.first), total[c.first[1:]] - total[c.first[:-1]], c.kept(gone)


def drop_repeats(df: DataFrame, id_col: str, text_col: str, width: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` and the columns named in ``carry``, a row for each row of ``df``.

    Every word goes that lies in a window of ``width`` words whose word
    sequence also starts anywhere else, in the same text or another.
    """
    ship(df.sparkSession)
    total = text_bytes(df, text_col)
    n_chunks, n_ranges = max(1, -(-total // CHUNK_BYTES)), max(1, -(-total // RANGE_BYTES))
    # Words are fewer than bytes, so these bits number all windows and leave some to spare.
    blocks = Plan(min(63, SPARE_BITS + max(total, CHUNK_BYTES).bit_length() - 2), FAN_BITS, n_ranges)
    windows = Plan(64, FAN_BITS, n_ranges)
    extra = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra)
    # The partition spreads rows that repeat, and is the same whenever its task runs again.
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_chunks)).cast("int"))
    spread = rows.groupBy("chunk")

    def first(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_batches(probe(t["text"], key[0].as_py(), blocks, width), SENT))

    def second(key: tuple[pa.Scalar, ...], t: pa.Table, said: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_batches(extend(t["text"], said, key[0].as_py(), windows, width, blocks.bits), SENT))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["doc_id " + kinds["doc_id"], "n_words long", "n_removed long", "kept_text string", *(f"carry_{i} {kinds[f'carry_{i}']}" for i in range(len(carry)))])

    def third(key: tuple[pa.Scalar, ...], t: pa.Table, said: pa.Table) -> pa.Table:
        n, gone, kept = remove(t["text"], said, windows, width, blocks.bits)
        return pa.table([t["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), kept, *(t[f"carry_{i}"] for i in range(len(carry)))], names=["doc_id", "n_words", "n_removed", "kept_text", *(f"carry_{i}" for i in range(len(carry)))])

    hits = exchanged(spread.applyInArrow(first, SENT), blocks, Bin.anchors)
    seen = exchanged(spread.cogroup(hits.groupBy("chunk")).applyInArrow(second, SENT), windows, Bin.repeats)
    out = spread.cogroup(seen.groupBy("chunk")).applyInArrow(third, schema)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 35-word repeats removed from every document."""
    out = drop_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same rows in DuckDB, by comparing the windows' words themselves.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d),
win AS (SELECT r, p, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS s FROM t
  WINDOW f AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY s) AS c FROM win WHERE n = 35) WHERE c > 1),
marked AS (SELECT t.r, t.p, t.word, count(a.p) OVER (PARTITION BY t.r ORDER BY t.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM t LEFT JOIN again a ON a.r = t.r AND a.p = t.p),
kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS k FROM marked GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.k, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.r = d.r
"""


def brute_force(texts: dict[int, str | None], width: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The definition, for tests: doc_id to (n_words, n_removed, kept text)."""
    import re
    from collections import Counter

    words = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in texts.items()}

    def windows(w: list[str]) -> Iterator[tuple[str, ...]]:
        return (tuple(w[i : i + width]) for i in range(len(w) - width + 1))

    counts = Counter(x for w in words.values() for x in windows(w))
    out = {}
    for d, w in words.items():
        gone = {i + k for i, x in enumerate(windows(w)) if counts[x] > 1 for k in range(width)}
        out[d] = len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)
    return out
