"""Requests, block outcomes and their rollup to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.metrics import running_sum

#: States of a block.
INITIAL, WORKING, FINISHED, ABORTED = 0, 1, 2, 3


def validated(requests: DataFrame, n: int) -> DataFrame:
    """``requests`` and ``reject_code``: the first of mode, negative token, block count that fails; ``strict_ok``: as many pages as tokens."""
    start = F.floor(F.coalesce("start_pos", F.lit(0)) / n)
    blocks = F.greatest(F.ceil(F.size("tokens") / n) - start, F.lit(0))
    pages = F.ceil(F.greatest(F.size("page_idx") - start * n, F.lit(0)) / n)
    code = F.when(~F.coalesce(F.col("mode").isin("r", "w"), F.lit(False)), "mode").when(F.exists("tokens", lambda t: t < 0), "negative_token").when(F.coalesce("start_pos", F.lit(0)) < 0, "start_pos").when(blocks != pages, "block_count")
    return requests.withColumn("reject_code", code).withColumn("strict_ok", F.size("tokens") == F.size("page_idx"))


def outcomes(blocks: DataFrame) -> DataFrame:
    """``state`` and ``stored`` of blocks (mode, hit, slot): a read finishes on a hit and is aborted on a miss; every write finishes, stored or not."""
    state = F.when((F.col("mode") == "r") & ~F.col("hit"), ABORTED).otherwise(FINISHED)
    return blocks.withColumn("state", state).withColumn("stored", (F.col("mode") == "w") & (F.col("slot") >= 0))


def aborted(blocks: DataFrame, aborts: DataFrame) -> DataFrame:
    """``blocks`` (task_id, end_seq, state) after aborts (task_id, abort_seq): a block that had not ended by then is aborted, others keep their state."""
    first = aborts.groupBy("task_id").agg(F.min("abort_seq").alias("abort_seq"))
    late = F.col("abort_seq") < F.col("end_seq")
    return blocks.join(first, "task_id", "left").withColumn("state", F.when(late, ABORTED).otherwise(F.col("state"))).drop("abort_seq")


def rollup(tasks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per task (task_id, mode): ready, data_safe, finished, aborted, states; a task without blocks is ready at once.

    ``blocks``: task_id, block_idx, state, data_ready (payload gathered).
    """
    per = blocks.groupBy("task_id").agg(
        F.count("*").alias("n_blocks"),
        F.count_if(F.col("state") == FINISHED).alias("finished"),
        F.count_if(F.col("state") == ABORTED).alias("aborted"),
        F.count_if("data_ready").alias("gathered"),
        F.array_sort(F.collect_list(F.struct("block_idx", "state"))).alias("s"),
    )
    out = tasks.join(per, "task_id", "left").fillna(0, ["n_blocks", "finished", "aborted", "gathered"])
    ready = F.col("finished") + F.col("aborted") == F.col("n_blocks")
    safe = F.when(F.col("mode") == "w", F.col("gathered") >= F.col("n_blocks")).otherwise(ready)
    states = F.coalesce(F.array_join(F.transform("s", lambda x: x["state"].cast("string")), ","), F.lit(""))
    return out.select("task_id", "mode", "n_blocks", "finished", "aborted", ready.alias("ready"), safe.alias("data_safe"), states.alias("states"))


#: Instants of a bucket that sums of tasks in flight are carried over.
SPAN = 3_600_000_000


def active(tasks: DataFrame, mode: str | None = None, span: int = SPAN) -> DataFrame:
    """Tasks in flight by mode after each start or end (task_id, mode, begin, end): (mode, instant, n_active).

    Events are summed per instant and mode first; instants are then summed up
    inside spans of time, whose totals are carried on.  A task without blocks ends
    where it begins.  Any other ``mode`` than r, w or None is refused.
    """
    if mode not in (None, "r", "w"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = tasks.where(F.col("mode") == mode) if mode else tasks
    events = rows.select("mode", F.col("begin").alias("instant"), F.lit(1).alias("d")).unionAll(rows.select("mode", F.col("end").alias("instant"), F.lit(-1).alias("d")))
    per = events.groupBy("mode", "instant").agg(F.sum("d").alias("d"))
    return running_sum(per, ["mode"], "instant", "d", F.floor(F.col("instant") / span)).select("mode", "instant", F.col("total").alias("n_active"))
