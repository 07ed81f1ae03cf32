"""Word shingle sets as sorted arrays of 64-bit numbers, whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _MUL | np.uint64(1))
    out[0] = 1
    return np.multiply.accumulate(out)


def words(texts: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of the texts, lower-cased in A-Z, and the bounds of each text in them."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.searchsorted(starts, np.append(0, np.cumsum(sizes)))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    length = ends - starts
    chars = data[inside].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(length) - length
    place = np.arange(len(chars)) - np.repeat(first, length)
    value = mixed(chars * _MUL + np.uint64(seed)) * _powers(int(length.max()))[place]
    return mixed(np.add.reduceat(value, first) + length.astype(np.uint64)), bounds


def shingle_sets(texts: list[str], size: int, seed: int = 0) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of *size* words of each text.

    A text of fewer words has one shingle, the whole sequence; a text without words has none. Two
    different shingles get the same number with a chance of 2**-64.
    """
    word, bounds = words(texts, seed)
    n = max(len(word) - size + 1, 0)
    rolled = np.zeros(n, np.uint64)
    odd = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for i in range(size):
        rolled += word[i : i + n] * odd[i]
    rolled = mixed(rolled + np.uint64(size))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            yield mixed((word[a:b] * odd[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
