"""Registered block-cache queries and the SQL that gives the same rows.

Requests come from ``documents`` (and ``conversations``, ``pages``), the access
trace from ``events`` and page payloads from ``embeddings``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.geometry import DEFAULT_LIMIT, MOST_BYTES, MOST_PAGES, Geometry, block_limit, enough_disk
from blockloom.functions.keys import shard_of, word_tokens
from blockloom.operators import blocks as B
from blockloom.operators import lru, metrics, movement, tasks
from blockloom.operators.engine import ParquetEngine
from blockloom.service import BlockCache
from blockloom.sources.shared import fresh_path, written
from blockloom.sources.tables import spread, table

#: Tokens of a block, shards and slots of a shard.
N, SHARDS, SLOTS = 64, 4, 16
#: Keys that the trace touches.
KEYS = 200

Query = Callable[[SparkSession, str], DataFrame]


# --- tables of the domain -------------------------------------------------


def num_pages(spark: SparkSession, sf: str) -> int:
    """Pages of the page table: one per embedding."""
    return table(spark, sf, "embeddings").agg(F.max("vec_id").alias("m")).first()["m"] + 1


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request per document; start positions, page pointers and modes follow from its id."""
    n = num_pages(spark, sf)
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    # A generator of one row: expressions above it use the tokens made there instead of making them again.
    docs = docs.select(F.col("doc_id").alias("task_id"), "lang", "source", F.explode(F.array(word_tokens(F.col("text")))).alias("tokens"))
    pages = F.when(F.size("tokens") > 0, F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: ((F.col("task_id") * 31 + i * 7) % n).cast("int"))).otherwise(F.array().cast("array<int>"))
    return docs.withColumn("page_idx", pages).withColumn("mode", F.when(F.col("task_id") % 3 == 2, "r").otherwise("w")).withColumn("start_pos", ((F.col("task_id") % 4) * 50).cast("int")).withColumn("seq", F.col("task_id"))


def heads(spark: SparkSession, sf: str) -> DataFrame:
    """Id and mode of every request, without its tokens."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("task_id"), F.when(F.col("doc_id") % 3 == 2, "r").otherwise("w").alias("mode"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return B.block_rows(requests(spark, sf).drop("start_pos"), N, "task_id", "seq", "lang", "source", "mode")


def blocks_once(spark: SparkSession, sf: str) -> DataFrame:
    """``blocks``, made once and written, for queries that use them more than once."""
    return written(blocks(spark, sf), "blocks")


def kv_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page payloads: the digest of a vector's values in millionths."""
    digits = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e6).cast("bigint").cast("string"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("page_idx"), F.md5(F.array_join(digits, ",").cast("binary")).alias("payload"))


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """An access per event: q, r, w, w by event_id."""
    key = F.md5((F.col("user_id") % KEYS).cast("string").cast("binary"))
    ops = F.when(F.col("event_id") % 4 == 0, "q").when(F.col("event_id") % 4 == 1, "r").otherwise("w")
    return table(spark, sf, "events").select("ts", "event_id", "user_id", "event_type", ops.alias("op"), key.alias("block_key"), shard_of(key, SHARDS).alias("shard"))


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    return lru.replay(trace(spark, sf), SLOTS, ("ts", "event_id"))


_SQL_TOKENS = r"list_transform(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT)"
_SQL_KEY = "md5(array_to_string({0}, ','))"
_SQL_SHARD = f"(('0x' || substr({{0}}, 1, 8))::BIGINT % {SHARDS})"
_SQL_REQUESTS = f"""requests AS (
  SELECT doc_id AS task_id, doc_id AS seq, lang, source, tokens,
    list_transform(range(0, len(tokens)), lambda i: ((doc_id * 31 + i * 7) % np)::INT) AS page_idx,
    CASE WHEN doc_id % 3 = 2 THEN 'r' ELSE 'w' END AS mode, ((doc_id % 4) * 50)::INT AS start_pos
  FROM (SELECT *, {_SQL_TOKENS.format("text")} AS tokens FROM documents), (SELECT max(vec_id) + 1 AS np FROM embeddings))"""
_SQL_BLOCKS = f"""{_SQL_REQUESTS}, cut AS (
  SELECT *, unnest(range(0, (len(tokens) + {N - 1}) // {N})) AS b FROM requests), blocks AS (
  SELECT task_id, seq, lang, source, mode, b AS block_idx, {_SQL_KEY.format(f"tokens[b*{N}+1 : b*{N}+{N}]")} AS block_key,
    len(tokens[b*{N}+1 : b*{N}+{N}])::BIGINT AS n_tokens, page_idx[b*{N}+1 : b*{N}+{N}] AS pages FROM cut)"""
_SQL_PAGES = f"""kv AS (
  SELECT vec_id::INT AS page_idx, md5(array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * 1e6)::BIGINT), ',')) AS payload
  FROM embeddings)"""
_SQL_TRACE = f"""trace AS (
  SELECT ts, event_id, user_id, event_type, CASE event_id % 4 WHEN 0 THEN 'q' WHEN 1 THEN 'r' ELSE 'w' END AS op,
    md5((user_id % {KEYS})::VARCHAR) AS block_key, {_SQL_SHARD.format(f"md5((user_id % {KEYS})::VARCHAR)")} AS shard FROM events)"""


def _fold_sql(source: str, capacity: int, order: str = "ts, event_id", keep: str = "ts, event_id") -> str:
    """The replay as a recursion over each shard's rows: keys and slots as lists, least recently used first, and the free slots, the next to be used last."""
    return f"""seqd AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {order}) AS rn FROM {source}),
run AS (
  SELECT shard, 0::BIGINT AS rn, []::VARCHAR[] AS ks, []::BIGINT[] AS ss, range(0, {capacity})::BIGINT[] AS fs, false AS hit, -1::BIGINT AS slot, NULL::VARCHAR AS evicted
  FROM (SELECT DISTINCT shard FROM seqd)
  UNION ALL
  SELECT shard, rn,
    CASE WHEN p > 0 AND op IN ('q', 'w') THEN list_append(list_concat(ks[:p-1], ks[p+1:]), block_key)
         WHEN p > 0 AND op = 'f' THEN list_concat(ks[:p-1], ks[p+1:])
         WHEN new >= 0 THEN list_append(CASE WHEN len(fs) > 0 THEN ks ELSE ks[2:] END, block_key) ELSE ks END,
    CASE WHEN p > 0 AND op IN ('q', 'w') THEN list_append(list_concat(ss[:p-1], ss[p+1:]), ss[p])
         WHEN p > 0 AND op = 'f' THEN list_concat(ss[:p-1], ss[p+1:])
         WHEN new >= 0 THEN list_append(CASE WHEN len(fs) > 0 THEN ss ELSE ss[2:] END, new) ELSE ss END,
    CASE WHEN p > 0 AND op = 'f' THEN list_append(fs, ss[p]) WHEN new >= 0 AND len(fs) > 0 THEN fs[:len(fs) - 1] ELSE fs END,
    p > 0, CASE WHEN p > 0 THEN ss[p] ELSE new END,
    CASE WHEN new >= 0 AND len(fs) = 0 THEN ks[1] END
  FROM (SELECT *, CASE WHEN p > 0 OR op <> 'w' OR {capacity} = 0 THEN -1 WHEN len(fs) > 0 THEN fs[len(fs)] ELSE ss[1] END AS new
    FROM (SELECT r.shard, s.rn, s.op, s.block_key, r.ks, r.ss, r.fs, coalesce(list_position(r.ks, s.block_key), 0) AS p
      FROM run r JOIN seqd s ON s.shard = r.shard AND s.rn = r.rn + 1))),
replayed AS (SELECT s.shard, {", ".join("s." + x for x in keep.split(", "))}, s.op, s.block_key, r.hit, r.slot, r.evicted FROM seqd s JOIN run r USING (shard, rn))"""


_SQL_REPLAY = f"WITH RECURSIVE {_SQL_TRACE}, {_fold_sql('trace', SLOTS)}"
_FOUND: dict[str, tuple[Query, str | None]] = {}


def _register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _FOUND[name] = f, sql
        return f

    return put


# --- keying and addressing --------------------------------------------------


@_register("chunk_keys", f"WITH {_SQL_BLOCKS} SELECT task_id, block_idx, block_key, n_tokens FROM blocks")
def chunk_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Content keys of every document's blocks."""
    return blocks(spark, sf).select("task_id", "block_idx", "block_key", "n_tokens")


def _other_keys(name: str, id_cols: tuple[str, ...], text: str) -> None:
    ids = ", ".join(id_cols)
    sql = f"""SELECT {ids}, b AS block_idx, {_SQL_KEY.format(f"tk[b*{N}+1 : b*{N}+{N}]")} AS block_key FROM (
      SELECT {ids}, tk, unnest(range(0, (len(tk) + {N - 1}) // {N})) AS b FROM (SELECT {ids}, {_SQL_TOKENS.format(text)} AS tk FROM {name}))"""

    @_register(f"chunk_keys_{name}", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = spread(table(spark, sf, name).select(*id_cols, text)).select(*id_cols, word_tokens(F.col(text)).alias("tokens"))
        return B.block_rows(rows, N, *id_cols).select(*id_cols, "block_idx", "block_key")


_other_keys("conversations", ("conv_id", "turn"), "text")
_other_keys("pages", ("page_id",), "html")


@_register("start_pos_trim", f"""WITH {_SQL_REQUESTS}, cut AS (SELECT *, start_pos // {N} AS f, unnest(range(start_pos // {N}, greatest((len(tokens) + {N - 1}) // {N}, start_pos // {N}))) AS b FROM requests)
SELECT task_id, b - f AS block_idx, {_SQL_KEY.format(f"tokens[b*{N}+1 : b*{N}+{N}]")} AS block_key, page_idx[b*{N}+1]::BIGINT AS first_page, len(page_idx[b*{N}+1 : b*{N}+{N}])::BIGINT AS n_pages FROM cut""")
def start_pos_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks from the start position on, which is rounded down to a block; numbered from 0 again."""
    rows = B.block_rows(requests(spark, sf), N, "task_id")
    return rows.select("task_id", "block_idx", "block_key", F.get("pages", F.lit(0)).cast("bigint").alias("first_page"), F.size("pages").cast("bigint").alias("n_pages"))


@_register("block_pages", f"WITH {_SQL_BLOCKS} SELECT task_id, block_idx, list_min(pages)::BIGINT AS lowest, list_max(pages)::BIGINT AS highest, len(pages)::BIGINT AS n_pages FROM blocks")
def block_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The page slice of each block."""
    return blocks(spark, sf).select("task_id", "block_idx", F.array_min("pages").cast("bigint").alias("lowest"), F.array_max("pages").cast("bigint").alias("highest"), F.size("pages").cast("bigint").alias("n_pages"))


@_register("shard_load", f"WITH {_SQL_BLOCKS} SELECT {_SQL_SHARD.format('block_key')} AS shard, count(*) AS n_blocks, count(DISTINCT block_key) AS n_keys FROM blocks GROUP BY 1")
def shard_load(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks and distinct keys by shard."""
    per_key = B.with_shard(blocks(spark, sf), SHARDS).groupBy("shard", "block_key").agg(F.count("*").alias("n"))
    return per_key.groupBy("shard").agg(F.sum("n").alias("n_blocks"), F.count("*").alias("n_keys"))


_SIZES = (0, 1, 3840, 8192, 16384, 524288, 983040, 1048577, 67108864, 67108865, 200000000)
_STORE, _STORE_SHARDS = 10 << 30, 16


@_register("geometry", f"""SELECT page_bytes::BIGINT AS page_bytes, n::BIGINT AS n, (n * page_bytes)::BIGINT AS block_bytes,
  CASE WHEN page_bytes = 0 THEN 0 ELSE (({_STORE} // {_STORE_SHARDS}) // (n * page_bytes))::BIGINT END AS slots_per_shard
FROM (SELECT page_bytes::BIGINT AS page_bytes, greatest(1, least({MOST_PAGES}, greatest(1, {DEFAULT_LIMIT} // greatest(page_bytes, 1))))::BIGINT AS n FROM (VALUES {", ".join(f"({x})" for x in _SIZES)}) AS v(page_bytes))""")
def geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a block, its bytes and a shard's slots, by page size."""
    found = [(x, Geometry(x, 1, storage_bytes=_STORE, num_shard=_STORE_SHARDS)) for x in _SIZES]
    return spark.createDataFrame([(x, g.n, g.block_bytes, g.slots_per_shard) for x, g in found], "page_bytes bigint, n bigint, block_bytes bigint, slots_per_shard bigint")


_SETTINGS = ("32", "128", "0", "-4", "", "64MB", "abc", " 16", "+8", "7.5", "99999999999999999999")


@_register("block_limit", f"""SELECT setting, CASE WHEN regexp_extract(setting, '^\\s*([+-]?[0-9]+)', 1) = '' THEN {DEFAULT_LIMIT}::BIGINT
  WHEN TRY_CAST(regexp_extract(setting, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) > 0 THEN TRY_CAST(regexp_extract(setting, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) * 1048576 ELSE {DEFAULT_LIMIT}::BIGINT END AS limit_bytes
FROM (VALUES {", ".join(f"('{x}')" for x in _SETTINGS)}) AS v(setting)""")
def limits(spark: SparkSession, sf: str) -> DataFrame:
    """Block limits from settings in MiB."""
    return spark.createDataFrame([(x, block_limit(x)) for x in _SETTINGS], "setting string, limit_bytes bigint")


_DISKS = ((10, 5, 15), (10, 4, 15), (0, 0, 0), (0, 15, 15), (MOST_BYTES, MOST_BYTES, MOST_BYTES), (MOST_BYTES - 1, 0, MOST_BYTES), (1, MOST_BYTES, MOST_BYTES))


@_register("disk_check", f"""SELECT free_bytes::BIGINT AS free_bytes, held_bytes::BIGINT AS held_bytes, storage_bytes::BIGINT AS storage_bytes,
  least(free_bytes::HUGEINT + held_bytes::HUGEINT, {MOST_BYTES}) >= storage_bytes AS enough FROM (VALUES {", ".join(map(str, _DISKS))}) AS v(free_bytes, held_bytes, storage_bytes)""")
def disk_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether free space and the store's own files suffice, with sums that saturate."""
    return spark.createDataFrame([(*x, enough_disk(*x)) for x in _DISKS], "free_bytes bigint, held_bytes bigint, storage_bytes bigint, enough boolean")


# --- lookup -----------------------------------------------------------------

_RESIDENT = "resident AS (SELECT DISTINCT block_key FROM blocks WHERE source = 'src0')"


def _resident(rows: DataFrame) -> DataFrame:
    return rows.where("source = 'src0'").select("block_key")


@_register("residency_by_lang", f"WITH {_SQL_BLOCKS}, {_RESIDENT} SELECT lang, count(*) AS n_blocks, count(r.block_key) AS n_hits FROM blocks b LEFT JOIN resident r USING (block_key) GROUP BY lang")
def residency_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of all documents' blocks against those of one source."""
    rows = blocks(spark, sf)
    return B.residency(rows, _resident(rows)).groupBy("lang").agg(F.count("*").alias("n_blocks"), F.count_if("hit").alias("n_hits"))


@_register("query_exists", f"WITH {_SQL_BLOCKS}, {_RESIDENT} SELECT task_id, block_idx, r.block_key IS NOT NULL AS hit FROM blocks b LEFT JOIN resident r USING (block_key)")
def query_exists(spark: SparkSession, sf: str) -> DataFrame:
    """One flag per block."""
    rows = blocks(spark, sf)
    return B.residency(rows, _resident(rows)).select("task_id", "block_idx", "hit")


@_register("query_hits", f"WITH {_SQL_BLOCKS}, {_RESIDENT} SELECT task_id, block_idx, block_key FROM blocks WHERE block_key IN (SELECT block_key FROM resident)")
def query_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = blocks(spark, sf)
    return rows.join(_resident(rows), "block_key", "left_semi").select("task_id", "block_idx", "block_key")


@_register("query_misses", f"WITH {_SQL_BLOCKS}, {_RESIDENT} SELECT task_id, block_idx, block_key FROM blocks WHERE block_key NOT IN (SELECT block_key FROM resident)")
def query_misses(spark: SparkSession, sf: str) -> DataFrame:
    rows = blocks(spark, sf)
    return rows.join(_resident(rows), "block_key", "left_anti").select("task_id", "block_idx", "block_key")


@_register("already_pages", f"WITH {_SQL_BLOCKS}, {_RESIDENT} SELECT task_id, block_idx, generate_subscripts(pages, 1) - 1 AS pos, unnest(pages)::BIGINT AS page_idx FROM blocks WHERE mode = 'w' AND block_key IN (SELECT block_key FROM resident)")
def already_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that writes need not bring, as their block is resident; in order, repeats kept."""
    rows = blocks(spark, sf)
    hits = rows.where("mode = 'w'").join(_resident(rows), "block_key", "left_semi")
    return hits.select("task_id", "block_idx", F.posexplode("pages").alias("pos", "page_idx")).select("task_id", "block_idx", F.col("pos").cast("bigint").alias("pos"), F.col("page_idx").cast("bigint").alias("page_idx"))


# --- slot store and eviction -------------------------------------------------


@_register("free_slots", f"SELECT s::BIGINT AS shard, i::BIGINT AS slot, ({SLOTS} - 1 - i)::BIGINT AS used_as FROM range({SHARDS}) a(s), range({SLOTS}) b(i)")
def free_slots(spark: SparkSession, sf: str) -> DataFrame:
    """An empty index: every slot free, the highest used first."""
    order = []
    shard = lru.Shard(SLOTS)
    for i in range(SLOTS):
        order.append(shard.apply("w", f"k{i}")[1])
    return spark.createDataFrame([(s, slot, i) for s in range(SHARDS) for i, slot in enumerate(order)], "shard bigint, slot bigint, used_as bigint")


@_register("write_dedupe", f"""WITH {_SQL_BLOCKS} SELECT block_key, min(row(seq, block_idx)).seq AS seq, min(row(seq, block_idx)).block_idx AS block_idx, count(*) AS n_writes
FROM (SELECT block_key, {{'seq': seq, 'block_idx': block_idx}} AS w, seq, block_idx FROM blocks WHERE mode = 'w') GROUP BY block_key""".replace("min(row(seq, block_idx))", "min(w)"))
def write_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """First writer of every key in an unbounded store."""
    writes = blocks(spark, sf).where("mode = 'w'").select("block_key", "seq", "block_idx")
    return B.first_writers(writes, ["seq", "block_idx"])


@_register("lru_trace", f"{_SQL_REPLAY} SELECT shard, event_id, op, block_key, hit, slot, evicted FROM replayed")
def lru_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The whole trace with hits, slots and evictions."""
    return _replayed(spark, sf).select("shard", "event_id", "op", "block_key", "hit", "slot", "evicted")


@_register("lru_evictions", f"{_SQL_REPLAY} SELECT shard, count(*) FILTER (op = 'q' AND hit) AS query_hits, count(*) FILTER (op = 'r' AND hit) AS read_hits, count(*) FILTER (op = 'w' AND NOT hit AND slot >= 0) AS inserts, count(evicted) AS evictions FROM replayed GROUP BY shard")
def lru_evictions(spark: SparkSession, sf: str) -> DataFrame:
    done = _replayed(spark, sf)
    return done.groupBy("shard").agg(F.count_if(F.expr("op = 'q' and hit")).alias("query_hits"), F.count_if(F.expr("op = 'r' and hit")).alias("read_hits"), F.count_if(F.expr("op = 'w' and not hit and slot >= 0")).alias("inserts"), F.count("evicted").alias("evictions"))


@_register("lru_final_residents", f"{_SQL_REPLAY} SELECT shard, unnest(ks) AS block_key, unnest(ss) AS slot FROM run WHERE (shard, rn) IN (SELECT shard, max(rn) FROM run GROUP BY shard)")
def lru_final_residents(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot of the slots after the trace."""
    return lru.final_residents(_replayed(spark, sf), ("ts", "event_id"))


_SQL_WRITES = "writes AS (SELECT * FROM trace WHERE op = 'w')"


@_register("lru_write_only", f"WITH RECURSIVE {_SQL_TRACE}, {_SQL_WRITES}, {_fold_sql('writes', SLOTS)} SELECT shard, event_id, block_key, hit FROM replayed")
def lru_write_only(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of the trace's writes alone, by the replay."""
    return lru.replay(trace(spark, sf).where("op = 'w'"), SLOTS, ("ts", "event_id")).select("shard", "event_id", "block_key", "hit")


@_register("lru_stack_distance", f"WITH RECURSIVE {_SQL_TRACE}, {_SQL_WRITES}, {_fold_sql('writes', SLOTS)} SELECT shard, event_id, block_key, hit FROM replayed")
def lru_stack_distance(spark: SparkSession, sf: str) -> DataFrame:
    """The same hits without a fold, by the stack distance of every write: a check of the replay."""
    return lru.write_only_hits(trace(spark, sf).where("op = 'w'"), SLOTS, ["ts", "event_id"]).select("shard", "event_id", "block_key", "hit")


@_register("lru_zero_slots", f"WITH {_SQL_TRACE} SELECT shard, event_id, false AS hit, -1::BIGINT AS slot FROM trace")
def lru_zero_slots(spark: SparkSession, sf: str) -> DataFrame:
    """A store whose shards have no slot: nothing is ever stored."""
    return lru.replay(trace(spark, sf), 0, ("ts", "event_id")).select("shard", "event_id", "hit", "slot")


_SQL_FAILING = f"""failing AS (SELECT ts, event_id, block_key, shard, CASE WHEN event_id % 7 = 3 THEN 'f' ELSE op END AS op FROM trace)"""
_SQL_FAILED = f"WITH RECURSIVE {_SQL_TRACE}, {_SQL_FAILING}, {_fold_sql('failing', SLOTS)}"


def _failing(spark: SparkSession, sf: str) -> DataFrame:
    """The trace in which every seventh access is a write that failed."""
    return trace(spark, sf).withColumn("op", F.when(F.col("event_id") % 7 == 3, "f").otherwise(F.col("op")))


@_register("failed_writes", f"{_SQL_FAILED} SELECT shard, event_id, op, block_key, hit, slot, evicted FROM replayed")
def failed_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Failed writes take their key out and free its slot, which the next new key gets."""
    return lru.replay(_failing(spark, sf), SLOTS, ("ts", "event_id")).select("shard", "event_id", "op", "block_key", "hit", "slot", "evicted")


@_register("snapshot", f"{_SQL_FAILED}, last AS (SELECT * FROM run WHERE (shard, rn) IN (SELECT shard, max(rn) FROM run GROUP BY shard)), every AS (SELECT shard, list_concat(list_transform(range(1, len(ks) + 1), lambda i: {{'k': ks[i], 's': ss[i]}}), list_transform(fs, lambda x: {{'k': NULL::VARCHAR, 's': x}})) AS l FROM last) SELECT shard, (i - 1)::BIGINT AS rank, l[i].k AS block_key, l[i].s AS slot FROM (SELECT shard, l, unnest(range(1, len(l) + 1)) AS i FROM every)")
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The whole state after the trace with failed writes: resident keys by recency, then the free slots in order."""
    return lru.state_of(lru.folded(_failing(spark, sf), SLOTS, ("ts", "event_id")))


_HALF = "(SELECT (min(event_id) + max(event_id)) // 2 FROM events)"


@_register("snapshot_resume", f"WITH RECURSIVE {_SQL_TRACE}, {_SQL_FAILING}, late AS (SELECT *, event_id > {_HALF} AS second FROM failing), {_fold_sql('late', SLOTS, 'second, ts, event_id', 'ts, event_id, second')} SELECT shard, event_id, op, block_key, hit, slot, evicted FROM replayed WHERE second")
def snapshot_resume(spark: SparkSession, sf: str) -> DataFrame:
    """The later half of the accesses, from a snapshot of the store after the earlier half."""
    rows = _failing(spark, sf)
    ends = rows.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    half = ((ends["lo"] or 0) + (ends["hi"] or 0)) // 2
    early = lru.folded(rows.where(F.col("event_id") <= half), SLOTS, ("ts", "event_id"))
    state = written(lru.state_of(early), "state")
    return lru.replay(rows.where(F.col("event_id") > half), SLOTS, ("ts", "event_id"), initial=state).select("shard", "event_id", "op", "block_key", "hit", "slot", "evicted")


@_register("shard_capacity", f"""WITH {_SQL_BLOCKS} SELECT shard, n_keys, least(n_keys, {SLOTS * 4})::BIGINT AS kept, greatest(n_keys - {SLOTS * 4}, 0)::BIGINT AS over
FROM (SELECT {_SQL_SHARD.format('block_key')} AS shard, count(DISTINCT block_key) AS n_keys FROM blocks WHERE mode = 'w' GROUP BY 1)""")
def shard_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the written keys a shard's slots can hold at once."""
    keys = B.with_shard(blocks(spark, sf).where("mode = 'w'"), SHARDS).select("shard", "block_key").distinct()
    out = keys.groupBy("shard").agg(F.count("*").alias("n_keys"))
    return out.withColumn("kept", F.least("n_keys", F.lit(SLOTS * 4)).cast("bigint")).withColumn("over", F.greatest(F.col("n_keys") - SLOTS * 4, F.lit(0)).cast("bigint"))


# --- data movement -----------------------------------------------------------

_SQL_STORED = f"""firsts AS (SELECT block_key, min({{'seq': seq, 'block_idx': block_idx, 'pages': pages}}).pages AS pages FROM blocks WHERE mode = 'w' GROUP BY block_key),
moves AS (SELECT block_key, generate_subscripts(pages, 1) - 1 AS pos, unnest(pages) AS page_idx FROM firsts),
stored AS (SELECT block_key, pos, payload FROM moves JOIN kv USING (page_idx))"""
_SQL_MOVED = f"WITH {_SQL_BLOCKS}, {_SQL_PAGES}, {_SQL_STORED}"


def _stored(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    writes = rows.where("mode = 'w'").select("block_key", "seq", "block_idx", "pages")
    return movement.gather(B.first_writers(writes, ["seq", "block_idx"]), kv_pages(spark, sf))


@_register("gather", f"{_SQL_MOVED} SELECT block_key, pos, payload FROM stored")
def gather(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of every stored block, in page order."""
    return _stored(spark, sf, blocks(spark, sf))


_SQL_READS = "reads AS (SELECT seq, block_idx, block_key, pages FROM blocks WHERE mode = 'r' AND block_key IN (SELECT block_key FROM firsts))"


@_register("scatter_last_wins", f"""{_SQL_MOVED}, {_SQL_READS}, out_moves AS (SELECT seq, block_idx, block_key, generate_subscripts(pages, 1) - 1 AS pos, unnest(pages) AS page_idx FROM reads),
last AS (SELECT page_idx, max({{'seq': seq, 'block_idx': block_idx, 'pos': pos, 'k': block_key}}) AS m FROM out_moves GROUP BY page_idx)
SELECT page_idx::INT AS page_idx, payload FROM last LEFT JOIN stored s ON s.block_key = m.k AND s.pos = m.pos""")
def scatter_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Pages after all reads of resident blocks; the last position wins."""
    rows = blocks_once(spark, sf)
    keys = rows.where("mode = 'w'").select("block_key").distinct()
    reads = rows.where("mode = 'r'").join(keys, "block_key", "left_semi").select("seq", "block_idx", "block_key", "pages")
    # Only blocks that win a page are looked up in the store.
    won = written(movement.winners(reads, ["seq", "block_idx"]), "winners")
    writes = rows.where("mode = 'w'").select("block_key", "seq", "block_idx", "pages").join(won.select("block_key").distinct(), "block_key", "left_semi")
    return movement.settled(won, movement.fetch(won, B.first_writers(writes, ["seq", "block_idx"]), kv_pages(spark, sf)))


@_register("round_trip", f"{_SQL_MOVED} SELECT count(*) AS n_moves, count(*) FILTER (s.payload = kv.payload) AS n_equal FROM moves JOIN kv USING (page_idx) JOIN stored s USING (block_key, pos)")
def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored position read back against its page."""
    rows = blocks_once(spark, sf)
    writes = rows.where("mode = 'w'").select("block_key", "seq", "block_idx", "pages")
    firsts = written(B.first_writers(writes, ["seq", "block_idx"]).select("block_key", "pages"), "firsts")
    pages = kv_pages(spark, sf)
    stored = written(movement.gathered(firsts, pages), "stored")
    return spark.createDataFrame([movement.compared(movement.gathered(firsts, pages), stored)], "n_moves bigint, n_equal bigint")


@_register("range_reject", f"WITH {_SQL_BLOCKS} SELECT task_id, block_idx, CASE WHEN list_max(pages) >= (SELECT (max(vec_id) + 1) * 4 // 5 FROM embeddings) THEN 'page_range' END AS reject_code FROM blocks")
def range_reject(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that point beyond a page table of four fifths of the pages."""
    return movement.out_of_range(blocks(spark, sf), num_pages(spark, sf) * 4 // 5).select("task_id", "block_idx", "reject_code")


@_register("short_blocks", f"WITH {_SQL_BLOCKS} SELECT n_tokens, count(*) AS n_blocks, count(DISTINCT block_key) AS n_keys FROM blocks WHERE n_tokens < {N} GROUP BY n_tokens")
def short_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that are not full: only real pages are stored."""
    return blocks(spark, sf).where(f"n_tokens < {N}").groupBy("n_tokens").agg(F.count("*").alias("n_blocks"), F.count_distinct("block_key").alias("n_keys"))


@_register("engine_round_trip", f"""{_SQL_MOVED} SELECT {_SQL_SHARD.format('s.block_key')} AS shard, s.block_key, s.pos, s.payload FROM stored s WHERE {_SQL_SHARD.format('s.block_key')} < 2""")
def engine_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks written to a durable store by shard in two batches, the second of which repeats keys; two shards read back."""
    rows = blocks_once(spark, sf)
    stored = written(B.with_shard(_stored(spark, sf, rows), SHARDS), "stored")
    engine = ParquetEngine(spark, fresh_path(spark, "store"))
    engine.write(stored.where("shard % 2 = 0"))
    # Keys that are there already are kept as they are.
    engine.write(stored.withColumn("payload", F.when(F.col("shard") % 2 == 0, F.lit("late")).otherwise(F.col("payload"))))
    return engine.stored().where("shard < 2").select("shard", "block_key", "pos", "payload")


# --- tasks ---------------------------------------------------------------------

_SQL_STATES = f"""{_SQL_BLOCKS}, writes AS (SELECT block_key, min({{'seq': seq, 'block_idx': block_idx}}) AS w FROM blocks WHERE mode = 'w' GROUP BY block_key),
seen AS (SELECT b.*, coalesce(w.w < {{'seq': b.seq, 'block_idx': b.block_idx}}, false) AS hit FROM blocks b LEFT JOIN writes w USING (block_key)),
outcome AS (SELECT *, CASE WHEN mode = 'r' AND NOT hit THEN 3 ELSE 2 END AS state, mode = 'w' OR hit AS data_ready FROM seen)"""


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks in request order against a store without limit: one is there if an earlier request, or block, wrote it."""
    rows = blocks_once(spark, sf)
    first = rows.where("mode = 'w'").groupBy("block_key").agg(F.min(F.struct("seq", "block_idx")).alias("w"))
    known = rows.join(first, "block_key", "left").withColumn("hit", F.coalesce(F.col("w") < F.struct("seq", "block_idx"), F.lit(False))).drop("w")
    return tasks.outcomes(known.withColumn("slot", F.lit(0))).withColumn("data_ready", (F.col("mode") == "w") | F.col("hit"))


@_register("read_outcome", f"WITH {_SQL_STATES} SELECT task_id, block_idx, mode, hit, state::INT AS state, mode = 'w' AS stored FROM outcome")
def read_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """State of each block in request order: reads that miss are aborted, writes finish whether or not the key is there."""
    return _outcomes(spark, sf).select("task_id", "block_idx", "mode", "hit", "state", "stored")


@_register("task_state", f"""WITH {_SQL_STATES}, per AS (SELECT task_id, count(*) AS n, count(*) FILTER (state = 2) AS f, count(*) FILTER (state = 3) AS a, count(*) FILTER (data_ready) AS g,
  string_agg(state::VARCHAR, ',' ORDER BY block_idx) AS s FROM outcome GROUP BY task_id)
SELECT r.task_id, r.mode, coalesce(n, 0) AS n_blocks, coalesce(f, 0) AS finished, coalesce(a, 0) AS aborted, coalesce(f, 0) + coalesce(a, 0) = coalesce(n, 0) AS ready,
  CASE WHEN r.mode = 'w' THEN coalesce(g, 0) >= coalesce(n, 0) ELSE coalesce(f, 0) + coalesce(a, 0) = coalesce(n, 0) END AS data_safe, coalesce(s, '') AS states
FROM requests r LEFT JOIN per USING (task_id)""")
def task_state(spark: SparkSession, sf: str) -> DataFrame:
    """Ready, data_safe and block states of every request; one without blocks is ready."""
    return tasks.rollup(heads(spark, sf), _outcomes(spark, sf))


@_register("abort_effect", f"""WITH {_SQL_STATES} SELECT task_id, block_idx, CASE WHEN task_id % 5 = 0 AND task_id + 2 < task_id + block_idx THEN 3 ELSE state END::INT AS state FROM outcome""")
def abort_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Aborts of every fifth request after its third block ended: later blocks are aborted, earlier ones stay."""
    done = _outcomes(spark, sf).withColumn("end_seq", F.col("task_id") + F.col("block_idx"))
    aborts = heads(spark, sf).where("task_id % 5 = 0").select("task_id", (F.col("task_id") + 2).alias("abort_seq"))
    return tasks.aborted(done, aborts).select("task_id", "block_idx", F.col("state").cast("int").alias("state"))


_SQL_FLIGHT = "flight AS (SELECT event_id AS task_id, CASE WHEN event_type = 'click' THEN 'w' ELSE 'r' END AS mode, epoch_us(ts) AS b, epoch_us(ts) + (event_id % 97 + 1) * 1000000 AS e FROM events)"


def _flight(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks with a begin and an end, in microseconds."""
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(F.col("event_id").alias("task_id"), F.when(F.col("event_type") == "click", "w").otherwise("r").alias("mode"), begin.alias("begin"), (begin + (F.col("event_id") % 97 + 1) * 1000000).alias("end"))


@_register("active_tasks", f"""WITH {_SQL_FLIGHT}, ev AS (SELECT mode, b AS t, 1 AS d FROM flight UNION ALL SELECT mode, e, -1 FROM flight), per AS (SELECT mode, t, sum(d) AS d FROM ev GROUP BY mode, t)
SELECT mode, t AS instant, (sum(d) OVER (PARTITION BY mode ORDER BY t))::BIGINT AS n_active FROM per""")
def active_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks in flight by mode over time."""
    return tasks.active(_flight(spark, sf))


@_register("validate_requests", f"""WITH {_SQL_REQUESTS}, odd AS (SELECT task_id, tokens, start_pos, CASE WHEN task_id % 11 = 0 THEN 'x' ELSE mode END AS mode, CASE WHEN task_id % 7 = 0 THEN page_idx[:3] ELSE page_idx END AS page_idx FROM requests),
counted AS (SELECT *, greatest((len(tokens) + {N - 1}) // {N} - start_pos // {N}, 0) AS blocks, (greatest(len(page_idx) - (start_pos // {N}) * {N}, 0) + {N - 1}) // {N} AS page_blocks FROM odd)
SELECT task_id, CASE WHEN mode NOT IN ('r', 'w') THEN 'mode' WHEN blocks <> page_blocks THEN 'block_count' END AS reject_code, len(tokens) = len(page_idx) AS strict_ok FROM counted""")
def validate_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The first check that a request fails, and the strict length check apart."""
    odd = requests(spark, sf).withColumn("mode", F.when(F.col("task_id") % 11 == 0, "x").otherwise(F.col("mode"))).withColumn("page_idx", F.when(F.col("task_id") % 7 == 0, F.slice("page_idx", 1, 3)).otherwise(F.col("page_idx")))
    return tasks.validated(odd, N).select("task_id", "reject_code", "strict_ok")


# --- metrics ---------------------------------------------------------------------


@_register("write_throughput_tumbling", f"""WITH {_SQL_TRACE}, per AS (SELECT time_bucket(INTERVAL 3 SECOND, ts) AS start, count(*) AS n_writes, count(*) * 524288 AS bytes FROM trace WHERE op = 'w' GROUP BY 1)
SELECT start, bytes::BIGINT AS bytes, n_writes, (sum(bytes) OVER (ORDER BY start))::BIGINT AS total_bytes, bytes / 3.0::DOUBLE AS rate FROM per""")
def write_throughput_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes written by windows of 3 seconds, and in total."""
    writes = trace(spark, sf).where("op = 'w'").select("ts", F.lit(524288).alias("bytes"))
    return metrics.write_throughput(writes)


@_register("read_busy_batches", f"""WITH {_SQL_FLIGHT}, reads AS (SELECT task_id % 50 AS lane, b, e FROM flight WHERE mode = 'r'),
m AS (SELECT *, CASE WHEN b > max(e) OVER (PARTITION BY lane ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM reads),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY lane ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT lane, min(b) AS "begin", max(e) AS "end", count(*) AS n_reads, (count(*) * 524288)::BIGINT AS bytes FROM i GROUP BY lane, island""")
def read_busy_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Busy periods of reads in each of 50 lanes (services), with their bytes."""
    reads = _flight(spark, sf).where("mode = 'r'").select((F.col("task_id") % 50).alias("lane"), "begin", "end", F.lit(524288).alias("bytes"))
    return metrics.read_batches(reads, "lane")


@_register("bytes_counters", f"{_SQL_REPLAY} SELECT op, (count(*) FILTER (op = 'w' AND NOT hit AND slot >= 0) * 524288)::BIGINT AS written, (count(*) FILTER (op = 'r' AND hit) * 524288)::BIGINT AS read FROM replayed GROUP BY op")
def bytes_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes moved by operation: deduplicated writes and missed reads move none."""
    done = _replayed(spark, sf)
    return done.groupBy("op").agg((F.count_if(F.expr("op = 'w' and not hit and slot >= 0")) * 524288).alias("written"), (F.count_if(F.expr("op = 'r' and hit")) * 524288).alias("read"))


# --- extensions ----------------------------------------------------------


@_register("lru_online", f"{_SQL_REPLAY} SELECT shard, epoch_us(ts) AS seq, event_id AS tie, op, block_key, hit, slot, evicted FROM replayed")
def lru_online(spark: SparkSession, sf: str) -> DataFrame:
    """The trace as a stream: the same replay as keyed state, run until what is there is taken."""
    from blockloom.streaming.online import replay_available

    rows = trace(spark, sf).select("shard", F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), F.col("event_id").alias("tie"), "op", "block_key")
    return replay_available(rows, SLOTS)


@_register("xxh3_keys", None)
def xxh3_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Byte-exact XXH3-128 keys of document blocks."""
    from blockloom.functions.xxh3 import xxh3_key

    rows = requests(spark, sf).select("task_id", F.posexplode(B.split(F.col("tokens"), N)).alias("block_idx", "chunk"))
    return rows.select("task_id", "block_idx", xxh3_key("chunk").alias("block_key"))


_CACHE_BYTES, _CACHE_SHARDS = 256 << 20, 8
_CACHE_SLOTS = Geometry(8192, 1, storage_bytes=_CACHE_BYTES, num_shard=_CACHE_SHARDS).slots_per_shard
#: Requests with modes that don't exist and page lists that are too short, as the service gets them.
_SQL_SERVED = f"""{_SQL_REQUESTS}, odd AS (
  SELECT task_id, seq, tokens, start_pos, CASE WHEN task_id % 11 = 0 THEN 'x' ELSE mode END AS mode, CASE WHEN task_id % 7 = 0 THEN page_idx[:3] ELSE page_idx END AS page_idx FROM requests),
served AS (SELECT *, start_pos // {N} AS f, (len(tokens) + {N - 1}) // {N} AS nb FROM odd
  WHERE mode IN ('r', 'w') AND greatest((len(tokens) + {N - 1}) // {N} - start_pos // {N}, 0) = (greatest(len(page_idx) - (start_pos // {N}) * {N}, 0) + {N - 1}) // {N}),
cut AS (SELECT *, unnest(range(f, greatest(nb, f))) AS b FROM served),
sblocks AS (SELECT task_id, seq, mode, b - f AS block_idx, {_SQL_KEY.format(f"tokens[b*{N}+1 : b*{N}+{N}]")} AS block_key, page_idx[b*{N}+1 : b*{N}+{N}] AS pages FROM cut),
coded AS (SELECT task_id, seq, mode, block_idx, block_key, ('0x' || substr(block_key, 1, 8))::BIGINT % {_CACHE_SHARDS} AS shard,
  CASE WHEN list_max(pages) >= (SELECT (max(vec_id) + 1) * {{0}} // 10 FROM embeddings) THEN 'page_range' {{1}} END AS reject_code FROM sblocks),
ops AS (SELECT *, unnest(CASE WHEN reject_code IS NOT NULL THEN ['x'] WHEN mode = 'w' THEN ['q', 'w'] ELSE ['r'] END) AS op FROM coded),
phased AS (SELECT *, seq * 2 + CASE WHEN op = 'q' THEN 0 ELSE 1 END AS phase {{2}} FROM ops),
{_fold_sql("phased", _CACHE_SLOTS, "{3}phase, block_idx", "task_id, seq, mode, block_idx, reject_code{4}")},
result AS (SELECT *, reject_code IS NOT NULL AS bad FROM replayed WHERE op <> 'q')
SELECT task_id, block_idx, mode, hit AND NOT bad AS hit, CASE WHEN bad THEN -1 ELSE slot END AS slot, evicted,
  CASE WHEN bad OR mode = 'r' AND NOT hit THEN 3 ELSE 2 END::INT AS state, mode = 'w' AND NOT bad AND slot >= 0 AS stored, reject_code FROM result"""


def _sql_served(tenths: int, code: str = "", extra: str = "", before: str = "", keep: str = "") -> str:
    out = f"WITH RECURSIVE {_SQL_SERVED}"
    for i, x in enumerate((str(tenths), code, extra, before, keep)):
        out = out.replace(f"{{{i}}}", x)
    return out


def _served(spark: SparkSession, sf: str, tenths: int = 10) -> tuple[DataFrame, BlockCache]:
    """Requests, some of which don't hold, and an empty cache whose page table has so many tenths of the pages."""
    odd = requests(spark, sf).withColumn("mode", F.when(F.col("task_id") % 11 == 0, "x").otherwise(F.col("mode"))).withColumn("page_idx", F.when(F.col("task_id") % 7 == 0, F.slice("page_idx", 1, 3)).otherwise(F.col("page_idx")))
    return odd, BlockCache(Geometry(page_bytes=8192, num_pages=num_pages(spark, sf) * tenths // 10, storage_bytes=_CACHE_BYTES, num_shard=_CACHE_SHARDS))


_MADE = ("task_id", "block_idx", "mode", "hit", "slot", "evicted", "state", "stored", "reject_code")


@_register("service_create", _sql_served(9))
def service_create(spark: SparkSession, sf: str) -> DataFrame:
    """All requests through the batch service: validation, rejected blocks, queries, writes, reads, states."""
    rows, cache = _served(spark, sf, 9)
    return cache.create(rows).select(*_MADE)


@_register("service_reopen", _sql_served(10, extra=", seq % 2 AS second", before="second, ", keep=", second") + " WHERE second = 1")
def service_reopen(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of odd number by a cache that is opened with the state that those of even number left."""
    rows, cache = _served(spark, sf)
    cache.create(rows.where("seq % 2 = 0"))
    again = BlockCache(cache.geometry, cache.state)
    return again.create(rows.where("seq % 2 = 1")).select(*_MADE)


@_register("service_abort", _sql_served(10, code="WHEN task_id % 5 = 0 AND block_idx >= 1 + task_id % 3 THEN 'aborted'"))
def service_abort(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth request is aborted after its first blocks: the others never reach the store."""
    rows, cache = _served(spark, sf)
    aborts = heads(spark, sf).where("task_id % 5 = 0").select("task_id", (F.col("task_id") % 3 + 1).alias("after"))
    return cache.create(rows, aborts).select(*_MADE)


@_register("service_query", _sql_served(10).rsplit("SELECT", 1)[0] + f", last AS (SELECT ks FROM run WHERE (shard, rn) IN (SELECT shard, max(rn) FROM run GROUP BY shard)), held AS (SELECT DISTINCT unnest(ks) AS block_key FROM last), asked AS (SELECT task_id, unnest(range(0, nb)) AS b, tokens FROM (SELECT task_id, tokens, (len(tokens) + {N - 1}) // {N} AS nb FROM requests)), akeys AS (SELECT task_id, b AS block_idx, {_SQL_KEY.format(f"tokens[b*{N}+1 : b*{N}+{N}]")} AS block_key FROM asked) SELECT task_id, block_idx, h.block_key IS NOT NULL AS hit FROM akeys LEFT JOIN held h USING (block_key)")
def service_query(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's blocks looked up in the cache after all requests; hits are promoted, none comes or goes."""
    rows, cache = _served(spark, sf)
    cache.create(rows)
    return cache.query(requests(spark, sf))


@_register("active_writes", f"""WITH {_SQL_FLIGHT}, ev AS (SELECT b AS t, 1 AS d FROM flight WHERE mode = 'w' UNION ALL SELECT e, -1 FROM flight WHERE mode = 'w'), per AS (SELECT t, sum(d) AS d FROM ev GROUP BY t)
SELECT t AS instant, (sum(d) OVER (ORDER BY t))::BIGINT AS n_active FROM per""")
def active_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Writes in flight, by the cache's own call."""
    _, cache = _served(spark, sf)
    return cache.active_threads(_flight(spark, sf), "w")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s is not None}
