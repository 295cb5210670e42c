"""What a store of blocks can do, and a durable one.

A store takes and gives DataFrames: keys to look up, blocks to write, keys to read.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.geometry import MOST_BYTES, enough_disk

#: Files that a task keeps open while it writes to shards; beyond, it sorts its rows.
WRITERS = 16


def _among(shards: list[int | None]) -> Column:
    """Whether the shard is one of ``shards``, where null is one too."""
    return F.when(F.col("shard").isNull(), F.lit(None in shards)).otherwise(F.col("shard").isin([s for s in shards if s is not None]))


class StorageEngine(Protocol):
    """A content-addressed store of blocks."""

    def query(self, keys: DataFrame) -> DataFrame:
        """``keys`` (block_key and others) with ``hit``."""

    def write(self, blocks: DataFrame) -> DataFrame:
        """Store blocks (shard, block_key, pos, payload); the first write of a key counts.  Returns (block_key, n_rows) of those that are new."""

    def read(self, keys: DataFrame) -> DataFrame:
        """(block_key, pos, payload) of the keys that are stored."""


class ParquetEngine:
    """An unbounded durable store: parquet files by shard, a batch of new blocks for each write."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/shard=*"))
        return found is not None and len(found) > 0

    def stored(self) -> DataFrame:
        """All blocks (shard, block_key, pos, payload)."""
        if not self._exists():
            return self.spark.createDataFrame([], "block_key string, pos bigint, payload string, shard bigint")
        return self.spark.read.schema("block_key string, pos bigint, payload string, shard bigint").parquet(self.path)

    def query(self, keys: DataFrame) -> DataFrame:
        known = self.stored().select("block_key").distinct().withColumn("hit", F.lit(True))
        return keys.join(known, "block_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def write(self, blocks: DataFrame) -> DataFrame:
        from blockloom.sources.shared import written

        # What is new is settled before any of it is visible.
        fresh = written(self._fresh(blocks).select("block_key", "pos", "payload", "shard"), "fresh")
        # Every task writes to the shards that it has rows of, with a file open for each instead of a sort: a shard is never the work of one task.
        writers = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(writers, None)
        self.spark.conf.set(writers, str(WRITERS))
        try:
            fresh.write.mode("append").partitionBy("shard").parquet(self.path)
        finally:
            if before is None:
                self.spark.conf.unset(writers)
            else:
                self.spark.conf.set(writers, before)
        return fresh.groupBy("block_key").agg(F.count("*").alias("n_rows"))

    def _fresh(self, blocks: DataFrame) -> DataFrame:
        """Rows of ``blocks`` whose key isn't stored.

        Keys are looked up before rows: where all of a shard's keys are new, or
        none is, its rows are taken or left without a join.
        """
        if not self._exists():
            return blocks
        known = self.stored().select("block_key").distinct()
        keys = blocks.select("shard", "block_key").distinct().join(known.withColumn("known", F.lit(True)), "block_key", "left")
        found = keys.groupBy("shard").agg(F.count("*").alias("n"), F.count("known").alias("n_known")).collect()
        whole, mixed = ([r["shard"] for r in found if test(r)] for test in (lambda r: r["n_known"] == 0, lambda r: 0 < r["n_known"] < r["n"]))
        out = blocks.where(_among(whole))
        return out.unionAll(blocks.where(_among(mixed)).join(known, "block_key", "left_anti").select(*blocks.columns)) if mixed else out

    def read(self, keys: DataFrame) -> DataFrame:
        return self.stored().join(keys.select("block_key").distinct(), "block_key", "left_semi").select("block_key", "pos", "payload")


def check_disk(spark: SparkSession, path: str, storage_bytes: int, num_shard: int) -> int:
    """Free bytes where ``path`` is or will be, with what the store there already holds; raises if they don't suffice.

    The nearest folder above ``path`` that exists is asked, through Spark's own
    file systems.  Folders of shards that are there already count as free.
    """
    if num_shard <= 0:
        raise ValueError("num_shard must be above 0")
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    probe = fs.makeQualified(where)
    while not fs.exists(probe) and probe.getParent() is not None:
        probe = probe.getParent()
    free = fs.getStatus(probe).getRemaining()
    shards = (hadoop.Path(f"{path.rstrip('/')}/shard={i}") for i in range(num_shard))
    held = sum(fs.getContentSummary(s).getLength() for s in shards if fs.exists(s))
    if not enough_disk(free, held, storage_bytes):
        raise ValueError(f"{storage_bytes} bytes are wanted, {min(free + held, MOST_BYTES)} are there")
    return min(free + held, MOST_BYTES)
