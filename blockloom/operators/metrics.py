"""Throughput of writes and of busy periods of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, by: list[str], at: str, value: str, span: Column) -> DataFrame:
    """``rows`` with ``total``: the sum of ``value`` over the rows of the same ``by`` up to and with ``at``.

    Rows are summed up inside buckets of ``at`` (numbered by ``span``, which
    rises with it) and the totals of the buckets before are added.  Only those
    totals meet in one task, a row for each bucket.
    """
    rows = rows.withColumn("bucket", span)
    inside = Window.partitionBy(*by, "bucket").orderBy(at)
    sums = rows.groupBy(*by, "bucket").agg(F.sum(value).alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.select(*by, "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    out = rows.join(carried, [*by, "bucket"])
    return out.withColumn("total", (F.col("before") + F.sum(value).over(inside)).cast("bigint")).drop("bucket", "before")


def write_throughput(writes: DataFrame, seconds: int = 3) -> DataFrame:
    """Bytes of ``writes`` (ts, bytes) by tumbling window, in total so far, and the window's rate in bytes a second."""
    per = writes.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.sum("bytes").cast("bigint").alias("bytes"), F.count("*").alias("n_writes"))
    per = per.select(F.col("w.start").alias("start"), "bytes", "n_writes")
    hour = F.date_trunc("hour", "start")
    return running_sum(per, [], "start", "bytes", hour).select("start", "bytes", "n_writes", F.col("total").alias("total_bytes"), (F.col("bytes") / F.lit(float(seconds))).alias("rate"))


def read_batches(reads: DataFrame, lane: str) -> DataFrame:
    """Busy periods of ``reads`` (lane, begin, end, bytes): a new one starts where no read is active; (lane, begin, end, n_reads, bytes)."""
    order = Window.partitionBy(lane).orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = reads.withColumn("fresh", F.coalesce((F.col("begin") > before).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(lane, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n_reads"), F.sum("bytes").cast("bigint").alias("bytes")).drop("island")
