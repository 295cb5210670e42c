"""Tokens and block keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    """Token ids of a text: for each white-space word, the first eight hex digits of its md5.

    A null text has no tokens.
    """
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint"))


def block_key(tokens: Column) -> Column:
    """Content key of one block: md5 over the comma-joined token ids (position- and prefix-free)."""
    return F.md5(F.array_join(tokens.cast("array<string>"), ",").cast("binary"))


def shard_of(key: Column, num_shard: int) -> Column:
    """Shard of a hex key: its leading 32 bits modulo the number of shards."""
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % F.lit(num_shard)).cast("bigint")
