"""Text columns in Arrow batches as flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The word characters' complement: space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each row begins and the last ends; null rows have no bytes."""
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]] if len(col) else data[:0], at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
