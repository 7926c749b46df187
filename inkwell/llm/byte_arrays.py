"""Text columns of Arrow batches as numpy byte arrays: words, their hashes and their owners, without a Python loop.

Everything works on slices of about 256 KB (`slices`), so memory doesn't grow with batch size; one longer document is a slice
of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
SLICE_ROWS = 1000
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are no part of a term: all ASCII but letters and digits.
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if len(_powers.get(key, ())) < n:
        p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(p, out=p)
        _powers[key] = p
    return _powers[key]


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows) of consecutive parts of a text column."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for base in range(0, len(texts), SLICE_ROWS):
        col = texts.slice(base, SLICE_ROWS).cast(pa.large_binary())
        if col.null_count:
            col = pc.fill_null(col, b"")
        at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        held = col.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield base + i, base + j, data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def words(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that are not `apart`, inside its row."""
    inside = ~apart[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = at[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes from differences of running sums, then mixed."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(STEP, len(data) + 1)[: len(data)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * _power(BACK, len(data) + 1)[start])


def crc32_mod(doc_id: "pa.Array", by: int) -> np.ndarray:
    """crc32 of the id's decimal text, modulo by (null id: of the empty text)."""
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % by for x in doc_id.to_pylist()], np.int64)
