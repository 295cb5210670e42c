"""The bounded store: least-recently-used slots per shard.

Operations, in order within a shard:

* ``q`` query: a hit is promoted; a miss changes nothing;
* ``w`` write: a resident key is promoted and kept as it is; else a free slot
  is used, the highest first, else the least recently used key gives up its own;
* ``r`` read: finds or misses, promotes nothing;
* ``f`` failed write: the key goes and its slot is free again;
* ``x`` rejected: touches nothing.

A shard's rows meet in one partition in order and are folded as a stream: the
state is the shard's slots, never its trace.  The state after a replay is a table
(``STATE``) that another replay can start from.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A shard's slots: the resident keys, least recently used first, then the free slots (no key), the next to be used last.
STATE = "shard bigint, rank bigint, block_key string, slot bigint"


@dataclass
class Snapshot:
    """Resident keys and their slots, least recently used first, and the free slots, the next to be used last."""

    held: list[tuple[str, int]] = field(default_factory=list)
    free: list[int] = field(default_factory=list)


class Shard:
    """Slots of one shard."""

    def __init__(self, capacity: int, snapshot: Snapshot | None = None) -> None:
        self.capacity = capacity
        self.held: OrderedDict[str, int] = OrderedDict()
        self.free = list(range(capacity))
        if snapshot is not None:
            self.restore(snapshot)

    def apply(self, op: str, key: str) -> tuple[bool, int, str | None]:
        """(hit, slot or -1, evicted key) of one operation."""
        held = self.held
        slot = held.get(key, -1)
        hit, evicted = slot >= 0, None
        if op == "f":
            if hit:
                self.free.append(held.pop(key))
        elif hit:
            if op not in "rx":
                held.move_to_end(key)
        elif op == "w":
            if self.free:
                slot = self.free.pop()
            elif held:
                evicted, slot = held.popitem(last=False)
            if slot >= 0:
                held[key] = slot
        return hit, slot, evicted

    def snapshot(self) -> Snapshot:
        return Snapshot(list(self.held.items()), list(self.free))

    def restore(self, snapshot: Snapshot | None) -> None:
        """Take over a snapshot; one that is missing, or doesn't have each of the shard's slots once, is refused."""
        if snapshot is None:
            raise ValueError("no snapshot")
        slots = [s for _, s in snapshot.held] + list(snapshot.free)
        if sorted(slots) != list(range(self.capacity)) or len({k for k, _ in snapshot.held}) < len(snapshot.held):
            raise ValueError(f"a snapshot of {len(slots)} slots doesn't fit a shard of {self.capacity}")
        self.held, self.free = OrderedDict(snapshot.held), list(snapshot.free)


def folded(trace: DataFrame, capacity: int, seq: tuple[str, str], carry: tuple[str, ...] = (), initial: DataFrame | None = None) -> DataFrame:
    """``trace`` (shard, op, block_key, the two ``seq`` columns and those to ``carry``) with ``hit, slot, evicted``, and after each shard's rows its ``STATE``.

    Rows of a state have a ``rank``, those of the trace have none.  ``initial``
    is the state to start from; shards that it lacks start empty, and shards
    without any trace keep theirs.
    """
    a, b = seq
    rows = trace.select(F.col("shard").cast("bigint").alias("shard"), a, F.col(b).cast("bigint").alias(b), "op", "block_key", *carry)
    rows = rows.withColumns({"rank": F.lit(None).cast("bigint"), "slot": F.lit(None).cast("bigint")})
    if initial is not None:
        known = {"shard": F.col("shard").cast("bigint"), "op": F.lit("i"), "block_key": F.col("block_key"), "rank": F.col("rank").cast("bigint"), "slot": F.col("slot").cast("bigint")}
        rows = rows.unionAll(initial.select(*(known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema.fields)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", hit boolean, evicted string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, start, kinds = None, Shard(capacity), Snapshot(), None

        def begin() -> None:
            nonlocal start
            if start.held or start.free:
                shard.restore(start)
                start = Snapshot()

        def state() -> pa.RecordBatch:
            begin()
            snap = shard.snapshot()
            n = len(snap.held) + len(snap.free)
            own = {"shard": [at] * n, "op": ["i"] * n, "block_key": [k for k, _ in snap.held] + [None] * len(snap.free), "slot": [s for _, s in snap.held] + snap.free, "rank": list(range(n))}
            return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(n, f.type) for f in kinds], schema=kinds)

        for batch in batches:
            kinds = kinds or pa.schema([*batch.schema, pa.field("hit", pa.bool_()), pa.field("evicted", pa.string())])
            edges = np.flatnonzero(np.diff(np.asarray(batch.column("shard")), prepend=np.nan, append=np.nan)) if batch.num_rows else [0]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(i, j - i)
                number = part.column("shard")[0].as_py()
                if number != at:
                    if at is not None:
                        yield state()
                    at, shard, start = number, Shard(capacity), Snapshot()
                n = j - i - part.column("rank").null_count
                for key, slot in zip(part.column("block_key").slice(0, n).to_pylist(), part.column("slot").slice(0, n).to_pylist(), strict=True):
                    if key is None:
                        start.free.append(slot)
                    else:
                        start.held.append((key, slot))
                part = part.slice(n)
                if part.num_rows:
                    begin()
                    out = [shard.apply(op, key) for op, key in zip(part.column("op").to_pylist(), part.column("block_key").to_pylist(), strict=True)]
                    made = {"hit": [x[0] for x in out], "slot": [x[1] for x in out], "evicted": [x[2] for x in out]}
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else part.column(f.name) for f in kinds], schema=kinds)
        if at is not None:
            yield state()

    # The partitioning comes from the shard alone, so that a shard is whole in one task; its state (rows with a rank) comes first.
    return rows.repartition("shard").sortWithinPartitions("shard", F.col("rank").isNull(), "rank", a, b).mapInArrow(fold, schema)


def replay(trace: DataFrame, capacity: int, seq: tuple[str, str], carry: tuple[str, ...] = (), initial: DataFrame | None = None) -> DataFrame:
    """Every row of ``trace`` with hit, slot and evicted key, from an empty store or from the state ``initial``."""
    out = folded(trace, capacity, seq, carry, initial).where("rank is null")
    return out.select("shard", *seq, "op", "block_key", *carry, "hit", "slot", "evicted")


def state_of(done: DataFrame) -> DataFrame:
    """The ``STATE`` after ``folded`` rows."""
    return done.where("rank is not null").select("shard", "rank", "block_key", "slot")


def final_residents(replayed: DataFrame, seq: tuple[str, str]) -> DataFrame:
    """(shard, block_key, slot) after a replay: keys written in, and neither evicted nor failed since."""
    at = F.struct(*seq)
    ins = replayed.where("op = 'w' and not hit and slot >= 0").groupBy("shard", "block_key").agg(F.max(F.struct(at.alias("at"), "slot")).alias("i"))
    outs = replayed.where("evicted is not null").select("shard", F.col("evicted").alias("block_key"), at.alias("at"))
    outs = outs.unionByName(replayed.where("op = 'f' and hit").select("shard", "block_key", at.alias("at")))
    last = outs.groupBy("shard", "block_key").agg(F.max("at").alias("gone"))
    return ins.join(last, ["shard", "block_key"], "left").where("gone is null or gone < i.at").select("shard", "block_key", F.col("i.slot").alias("slot"))


#: Positions of a shard's trace that the stack-distance join takes together.
STRETCH = 64


def write_only_hits(trace: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Hits of a trace of writes by stack distance, without a fold: a key is resident if fewer than ``capacity`` distinct others came since it last did.

    Those others are the rows in between whose own last place lies before it.
    The range join goes by stretches of positions; its rows are the total
    length of all reuse windows, so it is a cross-check, not the way large
    traces are replayed.
    """
    by_shard = Window.partitionBy("shard").orderBy(*order)
    by_key = Window.partitionBy("shard", "block_key").orderBy("pos")
    rows = trace.withColumn("pos", F.row_number().over(by_shard).cast("bigint")).withColumn("prev", F.lag("pos").over(by_key))
    reach = rows.where("prev is not null").select("shard", F.col("pos").alias("at"), F.col("prev").alias("since"), F.explode(F.sequence(F.expr(f"prev div {STRETCH}"), F.expr(f"pos div {STRETCH}"))).alias("stretch"))
    seen = rows.select("shard", "pos", F.coalesce("prev", F.lit(0)).alias("own"), F.expr(f"pos div {STRETCH}").alias("stretch"))
    near = seen.join(reach, ["shard", "stretch"]).where("pos > since and pos < at and own <= since")
    dist = near.groupBy("shard", "at").agg(F.count("*").alias("d")).withColumnRenamed("at", "pos")
    out = rows.join(dist, ["shard", "pos"], "left")
    return out.withColumn("hit", F.col("prev").isNotNull() & (F.coalesce("d", F.lit(0)) < capacity)).drop("d", "prev", "pos")
