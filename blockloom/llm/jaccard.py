"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two texts are linked at a Jaccard
similarity of 0.8 or more.

1. Texts of the same word sequence collapse to one representative.
2. Representatives get 128 MinHash values.  Bands of four find candidates:
   at similarity 0.8 all 32 bands miss with probability 5e-8.
3. Inside a band's bucket MinHash values are compared 16, 32, 64 and 128 at a
   time; a pair is dropped as soon as the posterior probability (uniform prior)
   that its similarity reaches the threshold is below ``TOLERANCE``.  Pairs that
   stay only tie their texts together: a bucket sends a star per cluster,
   never its pairs.  A bucket above ``MOST`` texts is tied together as a whole
   here, and its pairs are pruned in the next step.
4. Tied clusters are verified.  One above ``MOST`` texts is cut into blocks, and
   each pair of blocks is a task of its own.  A task prunes its pairs as
   above and verifies those that stay exactly, on shingle sets.  Counts of links
   and a spanning forest leave the task.
5. Connected components of the forests are the classes.

Texts of one word sequence are found by a 128-bit hash of their bytes, words
joined by one space.

Defined cases: words are runs of characters other than ASCII white space,
unchanged; a text of one to four words is one shingle; texts without words
(null, empty, blank) link to nothing and are classes of their own; rows that
repeat an id are documents of their own, each with its own text, and so are rows
without an id; a class without any id is null.  Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import ship, table, written
from blockloom.llm.words import flat, mask_inside, mix, respaced, slices, spans, window_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: MinHash values of a text, and of a band.
HASHES, BAND = 128, 4
#: A pair goes when the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-9
STEPS = (16, 32, 64, 128)
#: Texts that are compared with one another at once, and those of a block of a larger group.
MOST, BLOCK = 256, 128

_rng = np.random.Generator(np.random.PCG64(5))
_MULTIPLY = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each step, the fewest equal MinHash values with which a pair stays.

    With a uniform prior the posterior of the similarity after m of k equal
    values is Beta(m+1, k-m+1); its mass above the threshold is the chance
    that Binomial(k+1, threshold) is at most m.
    """
    from math import comb

    out = {}
    for k in STEPS:
        below, m = 0.0, -1
        while m < k:
            below += comb(k + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (k - m)
            if below >= tolerance:
                break
            m += 1
        out[k] = m + 1
    return out


def shingle_sets(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(values, bounds, words, sequence): each text's ascending distinct shingles lie between its bounds; words: how many; sequence: a 128-bit hash of the words' bytes."""
    buf, offsets = flat(texts)
    starts, ends, first = spans(buf, offsets)
    hashes = word_hashes(buf, starts, ends)[0]
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    ok = mask_inside(first, SHINGLE)
    values, owner = window_hashes(hashes, SHINGLE)[ok], text[: len(ok)][ok]
    data, at = respaced(buf, starts, ends, text, len(n))
    data, at = memoryview(np.ascontiguousarray(data)), at.tolist()
    sequence = [xxhash.xxh3_128_digest(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    values, owner = np.concatenate([values, np.array([int.from_bytes(sequence[i][:8], "little") for i in short], np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(n) + 1)), n, sequence


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values (texts x HASHES, uint32) of non-empty sets."""
    out = np.empty((len(bounds) - 1, HASHES), np.uint32)
    at = bounds[:-1]
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat((values * _MULTIPLY[i] + _ADD[i]) >> np.uint64(32), at) if len(at) else 0
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band (texts x bands)."""
    keys = np.empty((len(sig), HASHES // BAND), np.uint64)
    for b in range(HASHES // BAND):
        h = np.full(len(sig), b + 1, np.uint64)
        for i in range(b * BAND, (b + 1) * BAND):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, i])
        keys[:, b] = h
    return keys


def survivors(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """For byte signatures (a x HASHES, b x HASHES): which pairs stay, as a boolean matrix."""
    alive = np.ones((len(left), len(right)), bool)
    done, matches = 0, np.zeros((len(left), len(right)), np.uint8)
    for k in STEPS:
        if alive.mean() > 0.2 or not done:
            for i in range(done, k):
                matches += left[:, i, None] == right[None, :, i]
            alive &= matches >= least[k]
        else:
            a, b = np.nonzero(alive)
            got = matches[a, b] + (left[a, done:k] == right[b, done:k]).sum(1, dtype=np.uint8)
            matches[a, b] = got
            alive[a, b] = got >= least[k]
        if not alive.any():
            break
        done = k
    return alive


def clusters(sig: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """The cluster of each signature, by flood fill over the pairs that stay."""
    label, rest, n = np.full(len(sig), -1), np.arange(len(sig)), 0
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front):
            label[front] = n
            hit = np.zeros(len(rest), bool)
            for i in range(0, len(front), 256):
                open_ = np.flatnonzero(~hit)
                if not len(open_):
                    break
                hit[open_] |= survivors(sig[front[i : i + 256]], sig[rest[open_]], least).any(0)
            front, rest = rest[hit], rest[~hit]
        n += 1
    return label


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((n, n), np.int32)
    out[np.arange(n), np.arange(n)] = sizes
    if n < 2:
        return out
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    df = np.diff(cut)
    rare = max(2, n // 24)
    for d in np.unique(df[(df > 1) & (df <= rare)]):
        who = owner[cut[:-1][df == d][:, None] + np.arange(d)]
        a, b = np.triu_indices(d, 1)
        for i in range(0, len(who), max(1, 2_000_000 // len(a))):
            part = who[i : i + max(1, 2_000_000 // len(a))]
            code, count = np.unique(part[:, a].ravel() * n + part[:, b].ravel(), return_counts=True)
            out[code // n, code % n] += count.astype(np.int32)
            out[code % n, code // n] += count.astype(np.int32)
    common = np.flatnonzero(df > rare)
    for i in range(0, len(common), 2048):
        part = common[i : i + 2048]
        m = np.zeros((n, len(part)), np.float32)
        rows = np.concatenate([owner[cut[j] : cut[j + 1]] for j in part])
        m[rows, np.repeat(np.arange(len(part)), df[part])] = 1
        both = np.rint(m @ m.T).astype(np.int32)
        both[np.arange(n), np.arange(n)] = 0
        out += both
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, exactly."""
    both = overlaps(sets)
    sizes = np.array([len(s) for s in sets])
    joint = sizes[:, None] + sizes[None, :] - both
    out = both / np.maximum(joint, 1) >= threshold
    out[np.arange(len(sets)), np.arange(len(sets))] = False
    return out


def spanning(links: np.ndarray) -> np.ndarray:
    """The first member of each row's component."""
    label, seen = np.arange(len(links)), np.zeros(len(links), bool)
    for i in range(len(links)):
        if seen[i]:
            continue
        front = np.array([i])
        seen[i] = True
        while len(front):
            label[front] = i
            front = np.flatnonzero(links[front].any(0) & ~seen)
            seen[front] = True
    return label


def verified(sets: list[np.ndarray], sig: np.ndarray, threshold: float, least: dict[int, int]) -> np.ndarray:
    """Which pairs are linked: those that pruning leaves, verified exactly among the texts they tie together."""
    alive = np.zeros((len(sets), len(sets)), bool)
    for i in range(0, len(sets), 256):
        alive[i : i + 256] = survivors(sig[i : i + 256], sig, least)
    out = np.zeros_like(alive)
    label = spanning(alive)
    order = np.argsort(label, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(group) > 1:
            out[np.ix_(group, group)] = linked([sets[i] for i in group], threshold)
    return out & alive


def components(edges: DataFrame, what: str) -> DataFrame:
    """(v, c): for each vertex of ``edges`` (a, b) the least vertex of its component.

    Least labels spread over edges and each round also jumps along the labels,
    so rounds grow with the logarithm of a component's width.  Each round is a
    table in the shared folder.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), what)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c")), what)
    while True:
        near = both.join(now, both.b == now.v).groupBy("a").agg(F.min("c").alias("m")).select(F.col("a").alias("v"), "m")
        step = now.join(near, "v", "left").select("v", F.col("c").alias("was"), F.least("c", F.coalesce("m", "c")).alias("c"))
        far = now.select(F.col("v").alias("c"), F.col("c").alias("jump"))
        step = step.join(far, "c", "left").select("v", "was", F.least("c", F.coalesce("jump", "c")).alias("c"))
        step = written(step, what)
        now = step.select("v", "c")
        if step.where("was <> c").isEmpty():
            return now


def _tasks(df: DataFrame) -> int:
    """Tasks for groups that take more work than their bytes tell: the session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def similarity_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``df``: ``doc_id``, ``class_id`` (the least doc_id of its component), ``n_links`` (other documents at the threshold or above, copies included), ``n_copies`` (other documents of the same word sequence)."""
    ship(df.sparkSession)
    every = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if every.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return _classes(every, threshold)
    # Ids that don't tell rows apart: rows get numbers, which stay as they are once written.
    numbered = written(every.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = _classes(numbered.select(F.col("row").alias("doc_id"), "text"), threshold).withColumnRenamed("doc_id", "row")
    rows = written(found.join(numbered.select("row", "doc_id"), "row"), "rows")
    least = rows.groupBy("class_id").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "class_id").select("doc_id", F.col("least").alias("class_id"), "n_links", "n_copies")


def _classes(rows: DataFrame, threshold: float) -> DataFrame:
    """``similarity_classes`` of rows (doc_id, text) whose ids are distinct and not null."""
    least = least_matches(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            values, bounds, n, sequence = shingle_sets(batch.column("text"))
            full = n > 0
            sig = np.zeros((len(n), HASHES), np.uint32)
            sig[full] = signatures(values, np.concatenate([bounds[:-1][full], bounds[-1:]]))
            sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * HASHES), len(n), [None, pa.py_buffer(sig)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sequence, pa.binary()), sigs], names=["doc_id", "n_words", "sequence", "sig"])

    # One table of keys and signatures; a signature is kept once for each word sequence of a task.
    signed = written(rows.mapInArrow(sign, "doc_id long, n_words long, sequence binary, sig binary"), "signed")
    worded = signed.where("n_words > 0")
    reps = written(worded.groupBy("sequence").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "reps")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            keys = band_keys(sig)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("rep")), keys.shape[1])), pa.array(keys.ravel().view(np.int64))], names=["rep", "bucket"])

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint8)
            sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASHES), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), sigs], names=["rep", "sig"])

    own = worded.join(reps.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "sig").dropDuplicates(["rep"])
    spread = written(own.mapInArrow(bands, "rep long, bucket long"), "bands")
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("m"), F.min("rep").alias("head")).where("m > 1")
    shared = written(spread.join(sizes, "bucket").select("rep", "bucket", "m", "head"), "shared")
    small = own.mapInArrow(trimmed, "rep long, sig binary")

    def tie(t: pa.Table) -> pa.Table:
        ids = np.asarray(t["rep"])
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
        label = clusters(sig, least)
        head = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(head, label, ids)
        a = head[label]
        return pa.table([pa.array(a[a != ids]), pa.array(ids[a != ids])], names=["a", "b"])

    # Bands of the same texts mostly have the same members: each set is compared once.
    sets = shared.where(F.col("m") <= MOST).groupBy("bucket").agg(F.array_sort(F.collect_set("rep")).alias("members")).select("members").distinct()
    listed = sets.select(F.xxhash64("members").alias("set"), F.explode("members").alias("rep"))
    pruned = listed.join(small, "rep").select("set", "rep", "sig").repartition(_tasks(rows), "set").groupBy("set").applyInArrow(tie, "a long, b long")
    whole = shared.where(F.col("m") > MOST).select(F.col("head").alias("a"), F.col("rep").alias("b"))
    tied = components(pruned.unionByName(whole).distinct(), "tied")

    return _verified(rows, signed, reps, tied, threshold)


def _verified(rows: DataFrame, signed: DataFrame, reps: DataFrame, tied: DataFrame, threshold: float) -> DataFrame:
    """Exact links inside tied clusters, then classes."""
    members = tied.select(F.col("v").alias("rep"), F.col("c").alias("cluster")).join(reps.select("rep", F.col("n").alias("copies")), "rep")
    sized = members.join(members.groupBy("cluster").agg(F.count("*").alias("m")), "cluster")
    n_blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    dealt = sized.withColumn("blocks", F.when(F.col("m") <= MOST, F.lit(1)).otherwise(n_blocks)).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = written(dealt.select("rep", "cluster", "copies", "blocks", "block"), "dealt")
    least = least_matches(threshold)
    texts = rows.join(dealt, F.col("doc_id") == F.col("rep"), "inner").dropDuplicates(["rep"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            values, bounds, _, _ = shingle_sets(batch.column("text"))
            # All these texts have words: short ones are one shingle.
            sigs = signatures(values, bounds).astype(np.uint8)
            data = [values[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "cluster", "copies", "blocks", "block")] + [pa.array(data, pa.binary()), pa.array([x.tobytes() for x in sigs], pa.binary())], names=["rep", "cluster", "copies", "blocks", "block", "shingles", "sig"])

    kept = texts.mapInArrow(sets, "rep long, cluster long, copies long, blocks int, block int, shingles binary, sig binary")
    # Of b blocks, tasks (i, j) with i <= j; block i is in b of them.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = kept.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def check(t: pa.Table) -> pa.Table:
        ids, copies, block = (np.asarray(t[c]) for c in ("rep", "copies", "block"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
        found = verified([np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()], sig, threshold, least)
        if len(np.unique(block)) > 1:  # pairs inside a block are counted by the block's own task
            found &= block[:, None] != block[None, :]
        elif t["lo"][0].as_py() != t["hi"][0].as_py():
            found[:] = False
        n = found @ copies
        head = np.full(len(ids), np.iinfo(np.int64).max)
        label = spanning(found)
        np.minimum.at(head, label, ids)
        return pa.table([pa.array(ids), pa.array(head[label]), pa.array(n.astype(np.int64))], names=["rep", "head", "n"])

    done = written(pairs.repartition(_tasks(rows), "cluster", "lo", "hi").groupBy("cluster", "lo", "hi").applyInArrow(check, "rep long, head long, n long"), "links")
    counts = done.groupBy("rep").agg(F.sum("n").alias("n_near"))
    classes = components(done.select(F.col("head").alias("a"), F.col("rep").alias("b")), "classes").select(F.col("v").alias("rep"), F.col("c").alias("class_id"))
    known = reps.join(classes, "rep", "left").join(counts, "rep", "left").select("sequence", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_near", F.lit(0)).alias("n_near"), (F.col("n") - 1).alias("n_copies"))
    out = signed.select("doc_id", "n_words", "sequence").join(known, "sequence", "left")
    own = F.col("n_words") > 0
    return out.select("doc_id", F.when(own, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(own, F.col("n_near") + F.col("n_copies")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(own, F.col("n_copies")).otherwise(F.lit(0)).cast("long").alias("n_copies"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of every document."""
    return similarity_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


#: The same rows in DuckDB, where ids are distinct: shingles are compared as words, links by a join on shingles, classes by recursion.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
worded AS (SELECT doc_id, array_to_string(w, ' ') AS s, w FROM d WHERE len(w) > 0),
reps AS (SELECT s, min(doc_id) AS rep, count(*) AS copies FROM worded GROUP BY s),
t AS (SELECT doc_id AS rep, len(w) AS n, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM worded WHERE doc_id IN (SELECT rep FROM reps)),
grams AS (SELECT DISTINCT rep, g FROM (SELECT rep, n, p, count(*) OVER f AS c, string_agg(word, ' ') OVER f AS g FROM t
  WINDOW f AS (PARTITION BY rep ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE c = 5 OR n < 5 AND p = 1),
sizes AS (SELECT rep, count(*) AS n FROM grams GROUP BY rep),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
linked AS (SELECT a, b FROM shared JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE common / (x.n + y.n - common) >= 0.8),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
near AS (SELECT l.a AS rep, sum(x.copies) AS n FROM links l JOIN reps x ON x.rep = l.b GROUP BY l.a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(r.copies - 1 + coalesce(n.n, 0), 0)::BIGINT AS n_links, coalesce(r.copies - 1, 0)::BIGINT AS n_copies
FROM d LEFT JOIN worded w ON w.doc_id = d.doc_id LEFT JOIN reps r ON r.s = w.s LEFT JOIN classes c ON c.rep = r.rep LEFT JOIN near n ON n.rep = r.rep
"""


def brute_force(texts: dict[int, str | None], threshold: float = THRESHOLD) -> dict[int, tuple[int, int, int]]:
    """The definition, for tests: doc_id to (class_id, n_links, n_copies)."""
    import re

    words = {d: tuple(re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in texts.items()}
    sets = {d: {w[i : i + SHINGLE] for i in range(max(1, len(w) - SHINGLE + 1))} if w else set() for d, w in words.items()}
    where: dict[tuple[str, ...], list[int]] = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    root = {d: d for d in texts}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    links = {}
    for d, s in sets.items():
        common: dict[int, int] = {}
        for x in s:
            for e in where[x]:
                common[e] = common.get(e, 0) + 1
        near = [e for e, k in common.items() if e != d and k / (len(s) + len(sets[e]) - k) >= threshold]
        links[d] = len(near), sum(words[e] == words[d] for e in near)
        for e in near:
            a, b = sorted((find(d), find(e)))
            root[b] = a
    return {d: (find(d), *links[d]) for d in texts}
