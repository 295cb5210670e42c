"""Optional byte-exact block keys: XXH3-128 over the tokens as little-endian 64-bit integers (Arrow batches)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


@F.arrow_udf("string")
def xxh3_key(tokens: pa.Array) -> pa.Array:
    """Keys of token arrays; a null array has none, and no array may hold a null."""
    import xxhash

    # All tokens are one buffer; a key is made of a slice of it.
    data = memoryview(np.asarray(tokens.values, dtype="<i8")).cast("B") if len(tokens.values) else b""
    ends = (8 * np.asarray(tokens.offsets, dtype=np.int64)).tolist()
    known = tokens.is_valid().to_pylist()
    return pa.array([xxhash.xxh3_128_hexdigest(data[i:j]) if ok else None for ok, i, j in zip(known, ends[:-1], ends[1:], strict=True)], pa.string())
