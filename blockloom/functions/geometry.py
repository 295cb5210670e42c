"""Cache geometry: pages to a block, blocks to a slot store, disk check."""

from __future__ import annotations

import re
from dataclasses import dataclass

MIB = 1 << 20
#: Most pages of a block, and the default block limit.
MOST_PAGES, DEFAULT_LIMIT = 64, 64 * MIB
#: Sums of sizes stop here.
MOST_BYTES = (1 << 63) - 1


def block_limit(setting: str | None) -> int:
    """Bytes a block may have, from a setting in MiB: its leading integer if above 0 and in range, else the default."""
    m = re.match(r"\s*([+-]?\d+)", setting or "")
    n = int(m[1]) if m else 0
    return n * MIB if 0 < n < 1 << 63 else DEFAULT_LIMIT


@dataclass(frozen=True)
class Geometry:
    """Sizes that follow from the page size, the block limit and the store."""

    page_bytes: int
    num_pages: int
    limit: int = DEFAULT_LIMIT
    storage_bytes: int = 32 << 30
    num_shard: int = 32

    def __post_init__(self) -> None:
        if self.num_shard <= 0:
            raise ValueError("num_shard must be above 0")
        if self.page_bytes < 0 or self.num_pages < 0:
            raise ValueError("pages can't have negative sizes")
        if self.storage_bytes < self.block_bytes:
            raise ValueError("the store is smaller than one block")

    @property
    def n(self) -> int:
        """Pages (tokens) of a block."""
        return max(1, min(MOST_PAGES, max(1, self.limit // max(self.page_bytes, 1))))

    @property
    def block_bytes(self) -> int:
        return self.n * self.page_bytes

    @property
    def slots_per_shard(self) -> int:
        """May be 0 though the whole store holds a block: then nothing is ever stored."""
        return self.storage_bytes // self.num_shard // self.block_bytes if self.block_bytes else 0

    @property
    def slots(self) -> int:
        return self.slots_per_shard * self.num_shard


def enough_disk(free_bytes: int, existing_bytes: int, storage_bytes: int) -> bool:
    """Whether free space and what the store's files already hold suffice; a sum too large to count does."""
    return min(free_bytes + existing_bytes, MOST_BYTES) >= storage_bytes
