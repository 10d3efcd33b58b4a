"""Words of columns of texts, known by 64-bit hashes: split, cut out and hashed by vector arithmetic, no word at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words that are hashed at a time, and an odd number whose powers weigh them.
HASHED, _BASE = 1 << 20, 0x9E3779B97F4A7C15


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2 ** 64 and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(HASHED - 1, x, np.uint64)))) for x in (_BASE, inverse))


def _hashes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that lie one behind the other: polynomials of their bytes, mixed."""
    out, sizes = np.empty(len(offsets) - 1, np.uint64), np.diff(offsets)
    powers, inverses = _powers()
    start = 0
    while start < len(out):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + HASHED, "right")) - 1)
        begin = offsets[start:end] - offsets[start]
        part = data[offsets[start] : offsets[end]]
        if len(part) > HASHED:  # one word longer than all powers is known by the hashes of its pieces
            pieces = _hashes_of(part, np.append(np.arange(0, len(part), HASHED), len(part))).view(np.uint8)
            out[start] = _hashes_of(pieces, np.array([0, len(pieces)]))[0]
        elif len(part):
            sums = np.add.reduceat(part * powers[: len(part)], np.minimum(begin, len(part) - 1))
            out[start:end] = np.where(sizes[start:end] > 0, sums * inverses[begin], np.uint64(0))
        else:
            out[start:end] = 0
        start = end
    out += sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    out = (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ out >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F)


def split_words(texts: pa.Array, split: Callable[[pa.Array], pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The words of large strings in a row, and where each text's begin (and the end of the last); `split` may leave empty ones."""
    found = split(texts)
    words, ends = found.flatten(), found.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return (words if upto[-1] == len(words) else words.filter(real)), upto[ends - ends[0]]


def hashes(words: pa.Array) -> np.ndarray:
    """The hash of each word of an array of large strings."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    return _hashes_of(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1])


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Stretches of about `size` bytes; a longer text is a stretch of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, start = np.cumsum(sizes), 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + size, "right")))
        yield texts.slice(start, end - start)
        start = end
