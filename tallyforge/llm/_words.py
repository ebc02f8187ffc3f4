"""Hashes of words and windows of words for a batch of UTF-8 texts at once."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches again, of about ``most`` bytes of text each (a longer text comes alone)."""
    for batch in batches:
        col = batch.column(text)
        size = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in col.cast(pa.binary()))])
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word in order, number of the first word of each text and the total).

    Words are runs of anything but space and the controls 9 to 13.
    """
    size = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = _GAP[raw]
    begin = ~gap & np.concatenate([[True], gap[:-1]])
    end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    start = np.flatnonzero(begin)
    text_start = np.concatenate([[0], np.cumsum(size + 1)])
    first = np.searchsorted(start, text_start)
    if not len(start):
        return np.zeros(0, np.uint64), first
    power = np.cumprod(np.full(len(raw), _ODD))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power)])
    # (sums over a word) / power of its start, as that power is odd and so has an inverse
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    back = np.cumprod(np.full(len(raw), inverse))
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)), first


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` neighbours in an array of word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out)


def pieces(clean: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text whose only separators are spaces in parts of about ``most`` bytes, cut where a word ends; a longer word comes whole."""
    at = 0
    while at < len(clean):
        upto = at + most
        if upto < len(clean):
            cut = clean.rfind(b" ", at, upto)
            cut = cut if cut >= 0 else clean.find(b" ", upto)
            upto = cut + 1 if cut >= 0 else len(clean)
        yield clean[at:upto]
        at = upto


def give_back() -> None:
    """Hand memory that finished work has freed back to the system; a worker process goes on to other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call, memory stays with the process
        ctypes.CDLL(None).malloc_trim(0)
