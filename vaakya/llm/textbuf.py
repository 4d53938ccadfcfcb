"""Numpy kernels over the byte buffers of Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; that class is ASCII, so
splitting UTF-8 bytes and splitting code points give the same words.  Word hashes are
64-bit polynomial hashes over random byte weights, finished with a bijective mixer.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that one numpy call sees at most, unless a single text is longer.
BLOCK_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        _tables[name] = have = np.multiply.accumulate(steps)
    return have[:n]


def _weights() -> np.ndarray:
    if "weights" not in _tables:
        _tables["weights"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _tables["weights"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offs, offs[lo] + size, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the index of each text's first word."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    solid = ~WHITE[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | cut[1:n]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash a word, the same in whatever batch the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_weights()[raw] * _powers("up", _BASE, len(raw)), out=total[1:])
    value = (total[ends] - total[starts]) * _powers("down", _INVERSE, len(raw))[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (order matters); len(hashes) - n + 1 values."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[k : len(hashes) - n + 1 + k])
    return out


def trim() -> None:
    """Give freed memory back to the system, which the allocator of a reused worker keeps otherwise."""
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
