"""Words of many texts at once: runs of bytes in one buffer, their hashes, and strings cut out of it. All with numpy, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together, about.
SLICE = 1 << 21

_RANDOM = np.random.default_rng(12).integers(1, 1 << 63, 257, dtype=np.uint64)
_BASE = np.uint64(int(_RANDOM[256]) | 1)

#: A-Z as a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and last place + 1 of each maximal run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(body: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; body is the words' bytes, one after the other."""
    if not len(sizes):
        return np.empty(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()), _BASE))
    place = np.arange(len(body)) - np.repeat(starts, sizes)
    return mixed(np.add.reduceat(_RANDOM[body] * powers[place], starts))


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] for each pair, as Arrow's binary."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    picked = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(picked)])


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts as UTF-8) of runs of whole texts of about `size` bytes together; a null text is empty."""
    first, held, total = 0, [], 0
    for k, text in enumerate(texts):
        held.append((text or "").encode())
        total += len(held[-1])
        if total >= size:
            yield first, held
            first, held, total = k + 1, [], 0
    if held:
        yield first, held
