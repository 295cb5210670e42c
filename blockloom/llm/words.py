"""Words of Arrow string columns and their hashes, computed on the UTF-8 bytes with numpy.

A word of up to ``SHORT`` bytes is hashed by tabulation: the sum of a random
64-bit value for each byte at its place, so that two words collide with
probability 2**-64 whatever they look like.  Longer words are hashed by XXH3.
A second half is as independent of the first as another hash function.

Windows of words are polynomials over word hashes, so every window of a text
costs a few vector operations whatever its width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The white space that separates words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text worked on at once.
BLOCK = 1 << 20

_ROOTS = (0x9E3779B97F4A7C15 & ~7 | 5, 0xC2B2AE3D27D4EB4F & ~7 | 5)
#: Bytes of a word that the tables below cover; longer words are hashed whole by XXH3.
SHORT = 64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(0, 2**64, (2, SHORT * 256), dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _series(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fresh array)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def byte_class(members: bytes, inverse: bool = False) -> np.ndarray:
    out = np.full(256, inverse)
    out[list(members)] = not inverse
    return out


NOT_SPACE = byte_class(SPACES, inverse=True)


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the byte spans of all words, and for each text the number of words before it (n+1 values)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = inside[buf]
    opens = m.copy()
    opens[1:] &= ~m[:-1]
    closes = m.copy()
    closes[:-1] &= ~m[1:]
    filled = offsets[:-1] < offsets[1:]
    at = offsets[:-1][filled]
    opens[at] = m[at]
    at = offsets[1:][filled] - 1
    closes[at] = m[at]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, halves: int = 1) -> np.ndarray:
    """``halves`` (1 or 2) independent 64-bit hashes of each word (halves x words), alike wherever the word stands."""
    out = np.empty((halves, len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        s, n = starts[i:j] - lo, ends[i:j] - starts[i:j]
        part = buf[lo : int(ends[j - 1])]
        edge = np.zeros(len(part) + 1, np.int8)
        edge[s] += 1
        edge[s + n] -= 1
        letters = part[np.cumsum(edge, dtype=np.int8)[:-1].view(bool)]
        at = np.cumsum(n) - n
        place = (np.arange(len(letters)) - np.repeat(at, n)).astype(np.uint16) & np.uint16(SHORT - 1)
        place <<= np.uint16(8)
        place |= letters
        for k in range(halves):
            out[k, i:j] = np.add.reduceat(_BYTES[k][place], at)
        for w in np.flatnonzero(n > SHORT):
            out[:, i + w] = np.frombuffer(xxhash.xxh3_128_digest(part[s[w] : s[w] + n[w]]), np.uint64)[:halves]
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash for each ``width`` consecutive values of ``words`` (len - width + 1 of them), text ends ignored."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    root = _ROOTS[which] ^ 0x5A5A5A5A5A5A5A58
    out = np.empty(n, np.uint64)
    back = pow(root, -1, 1 << 64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        part = words[lo : hi + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _series(root, len(part)), dtype=np.uint64, out=sums[1:])
        out[lo:hi] = mix((sums[width:] - sums[:-width]) * _series(back, len(part))[: hi - lo])
    return out


def mask_inside(first: np.ndarray, width: int) -> np.ndarray:
    """For each start of a window among all words, whether the window lies in one text."""
    n = int(first[-1])
    if n < width:
        return np.zeros(0, bool)
    edge = np.zeros(n + 1, np.int32)
    counts = np.diff(first)
    np.add.at(edge, first[:-1][counts >= width], 1)
    np.add.at(edge, (first[1:] - width + 1)[counts >= width], -1)
    return (np.cumsum(edge)[: n - width + 1]) > 0


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int = 2 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0), dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def respaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of ``n`` texts made of some words of ``buf``, joined by one space; ``text``: each word's, ascending."""
    buf = buf.copy()
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    keep = np.cumsum(edge, dtype=np.int8)[: len(buf)] > 0
    inner = np.zeros(len(starts), bool)
    inner[:-1] = text[:-1] == text[1:]
    buf[ends[inner]] = 0x20
    keep[ends[inner]] = True
    sizes = np.bincount(text, weights=ends - starts + inner, minlength=n).astype(np.int64)
    return buf[keep], np.concatenate([[0], np.cumsum(sizes)])
