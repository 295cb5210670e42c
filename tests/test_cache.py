"""Fixtures of the block cache with their expected results."""

import random

import pytest
from pyspark.sql import functions as F

from blockloom.functions.geometry import DEFAULT_LIMIT, MIB, Geometry, block_limit, enough_disk
from blockloom.operators import blocks as B
from blockloom.operators import lru, metrics, movement, tasks
from blockloom.service import BlockCache

N = 64
REQUEST = "task_id long, seq long, mode string, tokens array<long>, page_idx array<int>, start_pos int"


def request(task, tokens, pages=None, mode="w", start=0):
    return task, task, mode, list(tokens), list(pages if pages is not None else [i % 50 for i in range(len(tokens))]), start


def cache(pages=50, shards=1, slots=100):
    return BlockCache(Geometry(page_bytes=8192, num_pages=pages, storage_bytes=slots * shards * 524288, num_shard=shards))


def keys(spark, *lists):
    df = spark.createDataFrame([(i, list(t)) for i, t in enumerate(lists)], "task_id long, tokens array<long>")
    out = [[] for _ in lists]
    for r in B.block_rows(df, N, "task_id").orderBy("task_id", "block_idx").collect():
        out[r.task_id].append(r.block_key)
    return out


def test_chunk_boundaries(spark):
    found = keys(spark, range(3), range(N), range(N + 1), range(3 * N), range(3 * N - 1), [])
    assert [len(x) for x in found] == [1, 1, 2, 3, 3, 0]
    assert found[1] == found[2][:1] == found[3][:1]  # position-free, prefix-free


def test_keys_are_content(spark):
    a, b, c = keys(spark, range(100), range(100), range(1, 101))
    assert a == b and a != c


@pytest.mark.parametrize("pages,n", [(983040, 64), (8192, 64), (16384, 64), (MIB + 1, 63), (64 * MIB, 1), (64 * MIB + 1, 1), (0, 64)])
def test_geometry(pages, n):
    g = Geometry(page_bytes=pages, num_pages=1, storage_bytes=1 << 40)
    assert g.n == n and g.block_bytes == n * pages


def test_reference_slots():
    assert Geometry(983040, 128, storage_bytes=5 << 30, num_shard=8).slots_per_shard == 10
    assert Geometry(524288, 1024, storage_bytes=600 << 20, num_shard=4).slots_per_shard == 4
    assert Geometry(3840, 12800, storage_bytes=32 << 30, num_shard=32).slots == 139808


def test_geometry_checks():
    with pytest.raises(ValueError):
        Geometry(8192, 1, num_shard=0)
    with pytest.raises(ValueError):
        Geometry(8192, 1, storage_bytes=1000)
    assert enough_disk(10, 5, 15) and not enough_disk(10, 4, 15) and enough_disk(1 << 63, 1 << 63, (1 << 63) - 1)


@pytest.mark.parametrize("text,mib", [("32", 32), (" 7x", 7), ("0", None), ("-3", None), ("", None), (None, None), ("x", None), ("9" * 30, None)])
def test_block_limit(text, mib):
    assert block_limit(text) == (mib * MIB if mib else DEFAULT_LIMIT)


def test_query_partial_and_empty(spark):
    df = spark.createDataFrame([request(0, range(60)), request(1, []), request(2, range(10000))], REQUEST)
    resident = spark.createDataFrame([(keys(spark, range(30))[0][0],)], "block_key string")
    rows = cache().query(df, resident).collect()
    assert sum(r.task_id == 0 for r in rows) == 1 and sum(r.task_id == 2 for r in rows) == 157
    assert not any(r.hit for r in rows)  # a short block has a key of its own


def test_write_then_read_and_absent_read(spark):
    reqs = spark.createDataFrame([request(0, range(100)), request(1, range(100), mode="r"), request(2, range(5, 60), mode="r"), request(3, range(100))], REQUEST)
    c = cache()
    made = c.create(reqs).orderBy("task_id", "block_idx").collect()
    assert [(r.task_id, r.hit, r.state, r.stored) for r in made] == [(0, False, 2, True)] * 2 + [(1, True, 2, False)] * 2 + [(2, False, 3, False)] + [(3, True, 2, True)] * 2
    rolled = {r.task_id: r for r in c.rollup(reqs, c.create(reqs)).collect()}
    assert all(r.ready for r in rolled.values()) and rolled[2].states == "3"


def test_start_position(spark):
    reqs = spark.createDataFrame([request(0, range(5 * N), [i % 50 for i in range(5 * N)], start=2 * N)], REQUEST)
    rows = B.block_rows(reqs, N, "task_id").orderBy("block_idx").collect()
    assert [r.block_idx for r in rows] == [0, 1, 2]
    assert {p for r in rows for p in r.pages} == set(range(50)) and rows[0].pages[0] == 2 * N % 50


def test_no_slots(spark):
    g = Geometry(page_bytes=8192, num_pages=50, storage_bytes=524288, num_shard=4)
    made = BlockCache(g).create(spark.createDataFrame([request(0, range(10))], REQUEST)).collect()
    assert [(r.state, r.stored) for r in made] == [(2, False)]


def test_rejections(spark):
    reqs = spark.createDataFrame([request(0, range(10), mode="invalid"), request(1, range(100), [0, 1, 2]), request(2, [-1], [0]), request(3, range(10), range(5)), request(4, [1, 2], [0, 50])], REQUEST)
    got = {r.task_id: r for r in tasks.validated(reqs, N).collect()}
    assert [got[i].reject_code for i in range(5)] == ["mode", "block_count", "negative_token", None, None]
    assert not got[3].strict_ok
    made = {r.task_id: r for r in cache().create(reqs).collect()}
    assert set(made) == {3, 4} and made[4].reject_code == "page_range" and made[4].state == tasks.ABORTED


def test_gather_scatter(spark):
    pages = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "page_idx int, payload string")
    wrote = spark.createDataFrame([("k", [1, 2, 49]), ("s", [7])], "block_key string, pages array<int>")
    stored = movement.gather(wrote, pages)
    reads = spark.createDataFrame([(0, 0, "k", [5, 5, 5]), (1, 0, "s", [9, 8])], "seq long, block_idx long, block_key string, pages array<int>")
    got = {r.page_idx: r.payload for r in movement.scatter(reads, stored, ["seq", "block_idx"]).collect()}
    assert got == {5: "p49", 9: "p7", 8: None}  # the last position wins; beyond what was stored there is nothing


def test_gather_sends_blocks_by_stretch(spark):
    """Pages with repeats, gaps, nulls and negative numbers give what a join on each page gives; what is sent are blocks, not their pages one by one."""
    known = [(i, f"p{i}") for i in range(3000) if i % 7] + [(3, "again"), (3, "again"), (5, None), (-2, "minus"), (None, "none")]
    pages = spark.createDataFrame(known, "page_idx int, payload string")
    wrote = spark.createDataFrame([("k", [1, 2, 49, 2900, 7, 3, 5]), ("s", [7]), ("e", []), ("n", None), ("m", [-2, None, 4000, 1023, 1024, 1025, 1, 1]), ("l", list(range(2999, -1, -1)))], "block_key string, pages array<int>")
    got = movement.gather(wrote, pages)
    plain = wrote.select("block_key", F.posexplode("pages").alias("pos", "page_idx")).join(pages, "page_idx").select("block_key", F.col("pos").cast("long").alias("pos"), "payload")
    assert got.dtypes == plain.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan.split("Exchange")[0]


def test_fetch_is_gather_of_what_is_asked(spark):
    pages = spark.createDataFrame([(i, f"p{i}") for i in range(50)] + [(7, "again"), (8, None)], "page_idx int, payload string")
    wrote = spark.createDataFrame([("k", [1, 2, 49, 99, 8]), ("s", [7]), ("t", list(range(50)))], "block_key string, pages array<int>")
    asked = spark.createDataFrame([("k", 2), ("k", 2), ("k", 3), ("k", 4), ("k", 5), ("s", 0), ("z", 0)], "block_key string, pos long")
    got = movement.fetch(asked, wrote, pages)
    want = movement.gather(wrote, pages).join(asked.distinct(), ["block_key", "pos"], "left_semi")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 5


def test_compared_is_a_join_by_position(spark):
    """Equal, changed, missing, repeated and null payloads count as in a join of all rows; equal blocks aren't joined row by row."""
    pages = spark.createDataFrame([(i, f"p{i}") for i in range(3000)] + [(7, "again"), (8, None)], "page_idx int, payload string").where("page_idx <> 8 or payload is null")
    wrote = spark.createDataFrame([("k", [1, 2, 49, 99]), ("s", [7, 9]), ("t", list(range(8, 50))), ("u", [5, 2000, 2001]), ("v", [2999, 1])], "block_key string, pages array<int>")
    rows = movement.gathered(wrote, pages)
    changed = rows.where("not (block_key = 'v' and pos = 1)").withColumn("payload", F.when(F.expr("block_key = 'u' and pos = 2"), "late").otherwise(F.col("payload")))
    for stored in (rows, changed, rows.where("block_key = 'k'"), rows.where("false")):
        pairs = rows.select("block_key", "pos", F.col("payload").alias("page")).join(stored, ["block_key", "pos"])
        assert movement.compared(rows, stored) == (pairs.count(), pairs.where("page = payload").count())


def test_abort(spark):
    blocks = spark.createDataFrame([(0, i, 10 + i, 2) for i in range(5)] + [(1, 0, 3, 3)], "task_id long, block_idx long, end_seq long, state int")
    aborts = spark.createDataFrame([(0, 12), (0, 20)], "task_id long, abort_seq long")
    got = {(r.task_id, r.block_idx): r.state for r in tasks.aborted(blocks, aborts).collect()}
    assert [got[0, i] for i in range(5)] == [2, 2, 2, 3, 3] and got[1, 0] == 3


def test_empty_task_is_ready(spark):
    t = spark.createDataFrame([(7, "w")], "task_id long, mode string")
    none = spark.createDataFrame([], "task_id long, block_idx long, state int, data_ready boolean")
    (r,) = tasks.rollup(t, none).collect()
    assert r.ready and r.data_safe and r.states == ""


def trace_of(spark, n, shards, n_keys, ops, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randrange(shards), i, i, rng.choice(ops), f"k{rng.randrange(n_keys)}") for i in range(n)]
    return spark.createDataFrame(rows, "shard long, a long, b long, op string, block_key string"), rows


def test_replay_against_lists(spark):
    df, rows = trace_of(spark, 3000, 3, 12, "qwrwf")
    got = {r.b: r for r in lru.replay(df, 4, ("a", "b")).collect()}
    lists, free = {s: [] for s in range(3)}, {s: list(range(4)) for s in range(3)}
    for s, _, i, op, k in rows:
        held = lists[s]  # [key, slot], least recently used first
        at = next((j for j, x in enumerate(held) if x[0] == k), None)
        assert got[i].hit == (at is not None)
        if op == "f" and at is not None:
            free[s].append(held.pop(at)[1])
        elif at is not None and op in "qw":
            held.append(held.pop(at))
        elif at is None and op == "w":
            if free[s]:
                held.append([k, free[s].pop()])
            else:
                old = held.pop(0)
                assert got[i].evicted == old[0]
                held.append([k, old[1]])
            assert got[i].slot == held[-1][1]
    final = {(r.shard, r.block_key, r.slot) for r in lru.final_residents(lru.replay(df, 4, ("a", "b")), ("a", "b")).collect()}
    assert final == {(s, k, slot) for s, held in lists.items() for k, slot in held}


def test_replay_is_stack_distance_for_writes(spark):
    df, _ = trace_of(spark, 800, 2, 10, "w")
    a = {r.b: r.hit for r in lru.replay(df, 4, ("a", "b")).collect()}
    b = {r.b: r.hit for r in lru.write_only_hits(df, 4, ["a", "b"]).collect()}
    assert a == b


def test_pressure(spark):
    df, rows = trace_of(spark, 4000, 4, 400, "wwq")
    done = lru.replay(df, 4, ("a", "b"))
    inserts, evictions = done.where("op = 'w' and not hit").count(), done.where("evicted is not null").count()
    assert evictions > 0 and inserts - evictions == lru.final_residents(done, ("a", "b")).count() == 16


def test_snapshot_restores():
    """A restored shard goes on exactly as the first would, failed writes included."""
    rng = random.Random(5)
    for _ in range(50):
        s, t = lru.Shard(4), lru.Shard(4)
        for _ in range(30):
            s.apply(rng.choice("qwrwf"), f"k{rng.randrange(8)}")
        t.restore(s.snapshot())
        for _ in range(30):
            op, key = rng.choice("qwrwf"), f"k{rng.randrange(8)}"
            assert t.apply(op, key) == s.apply(op, key)
        assert t.snapshot() == s.snapshot()


@pytest.mark.parametrize("bad", [None, lru.Snapshot([("a", 0)], []), lru.Snapshot([("a", 0), ("b", 0)], [1, 2]), lru.Snapshot([("a", 0), ("a", 1)], [2, 3]), lru.Snapshot([], [0, 1, 2, 3, 4])])
def test_snapshots_that_do_not_fit_are_refused(bad):
    with pytest.raises(ValueError):
        lru.Shard(4).restore(bad)


def test_replay_from_a_state(spark):
    """Two replays, the second from the state the first left, are one replay; shards without accesses keep their state."""
    df, _ = trace_of(spark, 2000, 3, 12, "qwrwf")
    whole = {r.b: (r.hit, r.slot, r.evicted) for r in lru.replay(df, 4, ("a", "b")).collect()}
    state = spark.createDataFrame(lru.state_of(lru.folded(df.where("a < 900"), 4, ("a", "b"))).collect(), lru.STATE)
    later = df.where("a >= 900 and shard <> 1")
    done = lru.folded(later, 4, ("a", "b"), initial=state)
    got = {r.b: (r.hit, r.slot, r.evicted) for r in done.where("rank is null").collect()}
    assert got and all(whole[b] == x for b, x in got.items())
    after = {(r.shard, r.rank, r.block_key, r.slot) for r in lru.state_of(done).collect()}
    assert len(after) == 12 and {x for x in after if x[0] == 1} == {tuple(r) for r in state.where("shard = 1").collect()}


def test_cache_lives_across_calls(spark):
    c = cache(slots=2)
    assert {r.stored for r in c.create(spark.createDataFrame([request(0, range(50)), request(1, range(100, 150))], REQUEST)).collect()} == {True}
    ask = spark.createDataFrame([request(0, range(50)), request(1, range(100, 150)), request(2, range(7))], REQUEST)
    assert [r.hit for r in c.query(ask.where("task_id <> 1")).orderBy("task_id").collect()] == [True, False]
    # The query promoted the first block, so the second gives way.
    c.create(spark.createDataFrame([request(5, range(200, 250))], REQUEST))
    assert [r.hit for r in c.query(ask).orderBy("task_id").collect()] == [True, False, False]
    again = BlockCache(c.geometry, c.state)
    assert [r.page_idx for r in again.already(spark.createDataFrame([request(9, range(50))], REQUEST)).orderBy("pos").collect()] == list(range(50))
    with pytest.raises(ValueError):
        BlockCache(cache(slots=3).geometry, c.state)
    with pytest.raises(ValueError):
        cache().resident()


def test_new_content_after_a_change(spark):
    """New tokens get new blocks; the old key still reads as it was written."""
    c = cache()
    c.create(spark.createDataFrame([request(0, range(40))], REQUEST))
    c.create(spark.createDataFrame([request(1, range(1, 41)), request(2, range(40))], REQUEST))
    made = c.create(spark.createDataFrame([request(3, range(40), mode="r"), request(4, range(1, 41), mode="r"), request(5, range(2, 42), mode="r")], REQUEST))
    assert [(r.hit, r.state) for r in made.orderBy("task_id").collect()] == [(True, 2), (True, 2), (False, 3)]


def test_second_write_finds_its_pages(spark):
    c = cache()
    reqs = spark.createDataFrame([request(0, range(20), range(20))], REQUEST)
    c.create(reqs)
    assert [r.page_idx for r in c.already(reqs).orderBy("pos").collect()] == list(range(20))


def test_abort_right_after_create(spark):
    """Blocks are finished or aborted, never both, and aborted ones aren't stored."""
    c = cache(slots=400)
    reqs = spark.createDataFrame([request(0, range(200 * N)), request(1, range(20_000, 20_010))], REQUEST)
    made = c.create(reqs, spark.createDataFrame([(0, 30), (0, 90)], "task_id long, after long")).collect()
    assert sum(r.state == 2 for r in made if r.task_id == 0) == 30 and sum(r.state == 3 for r in made if r.task_id == 0) == 170
    assert all(r.stored == (r.state == 2) for r in made) and c.resident().count() == 31
    blocks = spark.createDataFrame([(0, i, 10 + i, 2) for i in range(5)], "task_id long, block_idx long, end_seq long, state int")
    assert [r.state for r in c.abort(blocks, spark.createDataFrame([(0, 12)], "task_id long, abort_seq long")).orderBy("block_idx").collect()] == [2, 2, 2, 3, 3]


def test_active_threads(spark):
    flights = spark.createDataFrame([(0, "w", 0, 10), (1, "w", 5, 7_200_000_001), (2, "r", 1, 2), (3, "w", 7, 7)], "task_id long, mode string, begin long, end long")
    got = [(r.instant, r.n_active) for r in cache().active_threads(flights, "w").orderBy("instant").collect()]
    assert got == [(0, 1), (5, 2), (7, 2), (10, 1), (7_200_000_001, 0)]  # a task without blocks leaks nothing
    with pytest.raises(ValueError):
        cache().active_threads(flights, "x")


def test_running_sums_over_buckets(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, rng.randrange(-3, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, at long, v long")
    got = {r.at: r.total for r in metrics.running_sum(df, ["g"], "at", "v", F.floor(F.col("at") / 7)).collect()}
    sums = {}
    for g, at, v in rows:
        sums[g] = sums.get(g, 0) + v
        assert got[at] == sums[g]
    assert metrics.running_sum(df.where("false"), ["g"], "at", "v", F.col("at")).count() == 0


def test_engine(spark, tmp_path):
    from blockloom.operators.engine import ParquetEngine, check_disk

    engine = ParquetEngine(spark, f"file://{tmp_path}/store")
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "block_key string")
    assert [r.hit for r in engine.query(keys).collect()] == [False] * 3 and engine.read(keys).count() == 0
    first = spark.createDataFrame([(0, "a", 0, "x"), (0, "a", 1, "y"), (1, "b", 0, "z")], "shard long, block_key string, pos long, payload string")
    assert sorted(map(tuple, engine.write(first).collect())) == [("a", 2), ("b", 1)]
    later = spark.createDataFrame([(0, "a", 0, "other"), (1, "c", 0, "new")], "shard long, block_key string, pos long, payload string")
    assert [tuple(r) for r in engine.write(later).collect()] == [("c", 1)]
    again = ParquetEngine(spark, f"file://{tmp_path}/store")  # what was written lasts
    assert sorted((r.block_key, r.hit) for r in again.query(keys).collect()) == [("a", True), ("b", True), ("z", False)]
    assert sorted(map(tuple, again.read(keys).collect())) == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    free = check_disk(spark, f"file://{tmp_path}/store", 1 << 20, 2)
    assert free >= check_disk(spark, f"file://{tmp_path}/not/yet/there", 1 << 20, 2) - (1 << 30) > 0
    for bytes_, shards in (((1 << 63) - 1, 2), (1, 0)):
        with pytest.raises(ValueError):
            check_disk(spark, f"file://{tmp_path}/store", bytes_, shards)


def test_engine_spreads_a_shard(spark, tmp_path):
    """A large batch of one shard is written by several tasks; shards with new and known keys, and rows without a shard, keep what they should."""
    from blockloom.operators.engine import ParquetEngine

    engine = ParquetEngine(spark, f"file://{tmp_path}/store")
    rows = spark.range(0, 4000, 1, 4).selectExpr("0L as shard", "concat('k', id) as block_key", "0L as pos", "md5(cast(id as string)) as payload")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert engine.write(rows).count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list((tmp_path / "store" / "shard=0").glob("part-*"))) >= 4
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before
    later = spark.createDataFrame([(0, "k1", 0, "other"), (0, "new", 0, "n"), (1, "one", 0, "o"), (None, "none", 0, "x"), (None, None, 0, "y"), (2, "k2", 0, "other")], "shard long, block_key string, pos long, payload string")
    assert sorted(map(repr, engine.write(later).collect())) == sorted(map(repr, spark.createDataFrame([("new", 1), ("one", 1), ("none", 1), (None, 1)], "block_key string, n_rows long").collect()))
    assert engine.write(later.where("shard is null").withColumn("block_key", F.concat(F.lit("only"), F.col("block_key")))).where("block_key = 'onlynone'").count() == 1
    assert engine.stored().where("block_key <> 'onlynone'").count() == 4003 and engine.read(later.where("block_key = 'k1'")).collect()[0].payload != "other"
    assert sorted(map(repr, (tuple(r) for r in engine.stored().where("payload in ('n', 'o', 'x', 'y') and coalesce(block_key, '') not like 'only%'").select("shard", "block_key").collect()))) == ["(0, 'new')", "(1, 'one')", "(None, 'none')", "(None, None)", "(None, None)"]


def test_online_equals_batch(spark, tmp_path):
    """Two triggers, parted inside rows of one time: none is lost, and every row is as in the batch."""
    import time

    from blockloom.streaming.online import online

    df, rows = trace_of(spark, 400, 2, 9, "qwrwf")
    source = tmp_path / "in"
    one = df.select("shard", (F.col("a") / 50).cast("long").alias("seq"), F.col("b").alias("tie"), "op", "block_key")
    for lo, hi in ((0, 210), (210, 400)):
        one.where(f"tie >= {lo} and tie < {hi}").coalesce(1).write.mode("append").json(str(source))
        time.sleep(1.2)  # files are taken in the order of their times
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).json(str(source))
    q = online(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.tie: (r.hit, r.slot, r.evicted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.b: (r.hit, r.slot, r.evicted) for r in lru.replay(df, 3, ("a", "b")).collect()}


def test_available_trace_goes_by_ranges(spark, monkeypatch):
    """No trigger gets much more than its share of the rows, and the result is the batch's."""
    from blockloom.streaming import online as module

    got, started = [], module.online
    monkeypatch.setattr(module, "online", lambda trace, capacity: got.append(1) or started(trace, capacity))
    df, rows = trace_of(spark, 600, 2, 9, "qwrwf")
    one = df.select("shard", (F.col("a") / 50).cast("long").alias("seq"), F.col("b").alias("tie"), "op", "block_key")
    out = {r.tie: (r.hit, r.slot, r.evicted) for r in module.replay_available(one, 3, 250).collect()}
    assert out == {r.b: (r.hit, r.slot, r.evicted) for r in lru.replay(df, 3, ("a", "b")).collect()} and len(out) == 600
    assert len(got) == 3


def test_shared_folder_is_named_on_a_cluster():
    from types import SimpleNamespace

    from blockloom.sources.shared import shared_dir

    none = SimpleNamespace(getOrElse=lambda x: x)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))))
    with pytest.raises(ValueError):
        shared_dir(fake)


def test_xxh3(spark):
    import numpy as np
    import xxhash

    from blockloom.functions.xxh3 import xxh3_key

    lists = [[1, 2, 3], [], None, [2**62, -1], list(range(100))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<long>")
    got = {r.i: r.k for r in df.select("i", xxh3_key("t").alias("k")).collect()}
    assert got == {i: None if t is None else xxhash.xxh3_128(np.array(t, "<i8").tobytes()).hexdigest() for i, t in enumerate(lists)}
