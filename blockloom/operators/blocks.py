"""Requests to blocks: chunking, start positions, page slices, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.keys import block_key, shard_of


def split(tokens: Column, n: int, first: Column | int = 0) -> Column:
    """Consecutive chunks of ``n`` tokens from block ``first`` on, the last maybe short; none for no tokens.

    Use it inside a generator: in a projection above the one that makes
    ``tokens``, the optimizer would make them anew for every chunk.
    """
    start = F.lit(first) * n if isinstance(first, int) else first * n
    starts = F.when(F.size(tokens) > start, F.sequence(start.cast("int"), F.size(tokens) - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(tokens, s + 1, F.lit(n)))


def block_rows(requests: DataFrame, n: int, *keep: str) -> DataFrame:
    """A row for each block from the start position on: ``keep``, ``block_idx`` from 0, ``block_key``, ``n_tokens``, ``pages``.

    ``requests``: tokens, and if present page_idx and start_pos.  The start
    position is rounded down to a whole block, for tokens and pages alike.
    """
    has = set(requests.columns)
    first = F.floor(F.coalesce("start_pos", F.lit(0)) / F.lit(n)).cast("int") if "start_pos" in has else F.lit(0)
    paged = "page_idx" in has
    chunks = split(F.col("tokens"), n, first)
    if paged:
        # Pages are cut alongside, so that rows carry a block's own slice only.
        page_starts = F.transform(F.sequence(F.lit(0), F.size(chunks)), lambda i: F.slice("page_idx", ((first + i) * n + 1).cast("int"), n))
        chunks = F.arrays_zip(chunks.alias("chunk"), F.slice(page_starts, 1, F.size(chunks)).alias("pages"))
    else:
        chunks = F.transform(chunks, lambda c: F.struct(c.alias("chunk"), F.lit(None).cast("array<int>").alias("pages")))
    rows = requests.select(*keep, F.posexplode(chunks).alias("at", "b"))
    tokens, pages = F.col("b.chunk"), F.col("b.pages")
    return rows.select(*keep, F.col("at").cast("bigint").alias("block_idx"), block_key(tokens).alias("block_key"), F.size(tokens).cast("bigint").alias("n_tokens"), pages.alias("pages"))


def with_shard(blocks: DataFrame, num_shard: int) -> DataFrame:
    return blocks.withColumn("shard", shard_of(F.col("block_key"), num_shard))


def residency(blocks: DataFrame, resident: DataFrame) -> DataFrame:
    """``blocks`` and whether each one's key is among ``resident`` (block_key)."""
    known = resident.select("block_key").distinct().withColumn("hit", F.lit(True))
    return blocks.join(known, "block_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def first_writers(blocks: DataFrame, order: list[str]) -> DataFrame:
    """Each key's first write in ``order`` with what it wrote: an unbounded store keeps the first and never overwrites.

    An aggregate with partial sums on the map side, so a hot key costs a row per task.
    """
    rest = [c for c in blocks.columns if c != "block_key" and c not in order]
    return blocks.groupBy("block_key").agg(F.min(F.struct(*order, *rest)).alias("w"), F.count("*").alias("n_writes")).select("block_key", "w.*", "n_writes")
