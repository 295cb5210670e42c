"""The cache in batch form: the calls of a block-cache client over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.geometry import Geometry
from blockloom.operators import blocks as B
from blockloom.operators import lru, movement, tasks
from blockloom.sources.shared import written


class BlockCache:
    """Requests (task_id, seq, mode, tokens, page_idx, start_pos) against a store of ``geometry``.

    The store lives across calls: ``create`` and ``query`` start from the slots
    that the call before left (``state``, a ``lru.STATE`` table in the shared
    folder), and a cache opened with another's ``state`` goes on from there.
    """

    def __init__(self, geometry: Geometry, state: DataFrame | None = None) -> None:
        self.geometry, self.state = geometry, state
        if state is not None:
            self._check(state)

    def _check(self, state: DataFrame) -> None:
        """Refuse a state of other shards or slots."""
        g = self.geometry
        bad = state.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))
        bad = bad.where(~F.col("shard").between(0, g.num_shard - 1) | (F.col("n") != g.slots_per_shard) | (F.col("d") != F.col("n")) | (F.col("lo") != 0) | (F.col("hi") != g.slots_per_shard - 1))
        if not bad.isEmpty():
            raise ValueError(f"the state isn't one of {g.num_shard} shards with {g.slots_per_shard} slots each")

    def _run(self, trace: DataFrame, seq: tuple[str, str], carry: tuple[str, ...]) -> DataFrame:
        """Replay ``trace`` from the present state and keep the one after it."""
        done = lru.folded(trace, self.geometry.slots_per_shard, seq, carry, self.state)
        done = written(done, "replay")
        self.state = lru.state_of(done)
        return done.where("rank is null").drop("rank")

    def resident(self) -> DataFrame:
        """(block_key) of the stored blocks."""
        if self.state is None:
            raise ValueError("nothing was ever written")
        return self.state.where("block_key is not null").select("block_key")

    def hash(self, requests: DataFrame) -> DataFrame:
        """(task_id, block_idx, block_key) of every block, start positions ignored."""
        return B.block_rows(requests.select("task_id", "tokens"), self.geometry.n, "task_id").select("task_id", "block_idx", "block_key")

    def query(self, requests: DataFrame, resident: DataFrame | None = None) -> DataFrame:
        """(task_id, block_idx, hit) in block order.

        Against ``resident`` keys if given; else against the store, where a hit
        is promoted, requests in order of task_id.
        """
        if resident is not None:
            return B.residency(self.hash(requests), resident).select("task_id", "block_idx", "hit")
        trace = B.with_shard(self.hash(requests), self.geometry.num_shard).withColumn("op", F.lit("q"))
        return self._run(trace, ("task_id", "block_idx"), ()).select("task_id", "block_idx", "hit")

    def create(self, requests: DataFrame, aborts: DataFrame | None = None) -> DataFrame:
        """Replays the requests in ``seq`` order: a row per block with hit, slot, evicted, state, stored and reject_code.

        A write first queries all its blocks, then writes them; rejected
        requests and blocks touch nothing.  ``aborts`` (task_id, after): blocks
        of the task from number ``after`` on had not ended when it was aborted;
        they are aborted for good and touch nothing.
        """
        g = self.geometry
        checked = tasks.validated(requests, g.n)
        rows = B.with_shard(B.block_rows(checked.where("reject_code is null"), g.n, "task_id", "seq", "mode"), g.num_shard)
        rows = movement.out_of_range(rows, g.num_pages)
        if aborts is not None:
            first = aborts.groupBy("task_id").agg(F.min("after").alias("after"))
            gone = F.coalesce(F.col("block_idx") >= F.col("after"), F.lit(False))
            rows = rows.join(first, "task_id", "left").withColumn("reject_code", F.coalesce("reject_code", F.when(gone, F.lit("aborted")))).drop("after")
        ops = F.when(F.col("reject_code").isNotNull(), F.array(F.lit("x"))).when(F.col("mode") == "w", F.array(F.lit("q"), F.lit("w"))).otherwise(F.array(F.lit("r")))
        trace = rows.withColumn("op", F.explode(ops)).withColumn("phase", F.col("seq") * 2 + (F.col("op") != "q").cast("int"))
        carried = ("task_id", "seq", "mode", "n_tokens", "pages", "reject_code")
        done = self._run(trace, ("phase", "block_idx"), carried).where("op <> 'q'")
        bad = F.col("reject_code").isNotNull()
        out = tasks.outcomes(done.withColumn("hit", ~bad & F.col("hit")).withColumn("slot", F.when(bad, F.lit(-1).cast("bigint")).otherwise(F.col("slot"))))
        return out.withColumn("state", F.when(bad, tasks.ABORTED).otherwise(F.col("state"))).drop("op", "phase")

    def abort(self, blocks: DataFrame, aborts: DataFrame) -> DataFrame:
        """States of ``blocks`` (task_id, end_seq, state) after ``aborts`` (task_id, abort_seq): what had not ended is aborted."""
        return tasks.aborted(blocks, aborts)

    def active_threads(self, flights: DataFrame, mode: str) -> DataFrame:
        """(instant, n_active): tasks (task_id, mode, begin, end) of ``mode`` in flight after each begin or end."""
        return tasks.active(flights, mode).select("instant", "n_active")

    def already(self, requests: DataFrame, resident: DataFrame | None = None) -> DataFrame:
        """(task_id, block_idx, pos, page_idx) of pages whose block is stored already, for writes."""
        known = self.resident() if resident is None else resident
        rows = B.block_rows(requests.where("mode = 'w'"), self.geometry.n, "task_id")
        hits = rows.join(known.select("block_key").distinct(), "block_key", "left_semi")
        return hits.select("task_id", "block_idx", F.posexplode("pages").alias("pos", "page_idx"))

    def rollup(self, requests: DataFrame, created: DataFrame) -> DataFrame:
        """Ready, data_safe and states of each request."""
        return tasks.rollup(requests.select("task_id", "mode"), created.withColumn("data_ready", F.col("reject_code").isNull()))
