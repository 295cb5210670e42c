"""The bounded store online: the batch fold as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blockloom.operators.lru import Shard, Snapshot
from blockloom.sources.shared import fresh_path

OUT = "shard bigint, seq bigint, tie bigint, op string, block_key string, hit boolean, slot bigint, evicted string"


class LruProcessor(StatefulProcessor):
    """One shard's slots; rows are ordered by (seq, tie), and those at or before the last seen are late and dropped."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getValueState("entries", "seq bigint, tie bigint, keys array<string>, slots array<bigint>, free array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        shard, last = Shard(self.capacity), None
        if self.entries.exists():
            seq, tie, keys, slots, free = self.entries.get()
            last = (seq, tie)
            shard.restore(Snapshot(list(zip(keys, map(int, slots), strict=True)), [int(x) for x in free]))
        # One trigger's rows of a shard; the trigger's size bounds them.
        pdf = pd.concat(list(rows)).sort_values(["seq", "tie"], kind="stable")
        if last is not None:
            pdf = pdf[(pdf["seq"] > last[0]) | ((pdf["seq"] == last[0]) & (pdf["tie"] > last[1]))]
        if len(pdf):
            out = [shard.apply(op, k) for op, k in zip(pdf["op"], pdf["block_key"], strict=True)]
            self.entries.update((int(pdf["seq"].iloc[-1]), int(pdf["tie"].iloc[-1]), list(shard.held), list(shard.held.values()), shard.free))
            yield pd.DataFrame({"shard": key[0], "seq": pdf["seq"], "tie": pdf["tie"], "op": pdf["op"], "block_key": pdf["block_key"], "hit": [x[0] for x in out], "slot": [x[1] for x in out], "evicted": [x[2] for x in out]})

    def close(self) -> None:
        pass


def online(trace: DataFrame, capacity: int) -> DataFrame:
    """A streaming ``trace`` (shard, seq, tie, op, block_key) replayed; (seq, tie) is its order.  Needs the RocksDB state store."""
    return trace.groupBy("shard").transformWithStateInPandas(LruProcessor(capacity), OUT, "Append", "None")


#: Rows of a trigger of ``replay_available``: a worker holds its shard's share of them.
ROWS = 500_000


def replay_available(trace: DataFrame, capacity: int, rows: int = ROWS) -> DataFrame:
    """A batch ``trace`` put through the stream: written to the shared folder by ranges of its order, streamed range by range, and read back.

    Ranges hold about ``rows`` rows and rows of one (seq, tie) stay together, so
    no row is late.  Each is moved to the source when the one before is done.
    """
    spark = trace.sparkSession
    top = fresh_path(spark, "online")
    trace.write.parquet(f"{top}/trace")
    whole = spark.read.schema(trace.schema).parquet(f"{top}/trace")
    whole.repartitionByRange(max(1, -(-whole.count() // rows)), "seq", "tie").write.parquet(f"{top}/ranges")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(top).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(path(f"{top}/ranges")) if f.getPath().getName().startswith("part-"))
    fs.mkdirs(path(f"{top}/in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    dealt = "spark.sql.shuffle.partitions"
    before, shards = {k: spark.conf.get(k) for k in (provider, dealt)}, whole.select("shard").distinct().count()
    # Every trigger commits a state store for each partition; those beyond the shards hold nothing.
    spark.conf.set(dealt, str(max(1, min(int(before[dealt]), 2 * shards))))
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name in names:
            if not fs.rename(path(f"{top}/ranges/{name}"), path(f"{top}/in/{name}")):
                raise OSError(f"{name} can't be moved")
            stream = online(spark.readStream.schema(trace.schema).parquet(f"{top}/in"), capacity).writeStream.format("parquet").outputMode("append")
            stream.option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(OUT).parquet(f"{top}/out")
