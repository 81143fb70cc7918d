"""64-bit hashes of all words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.Generator(np.random.PCG64(20_240_229)).integers(1, 1 << 64, 256, np.uint64)
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection in which every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each."""
    if not _powers or len(_powers[0]) < size:
        steps = np.full((2, max(size, 1 << 18)), 1, np.uint64)
        steps[0, 1:], steps[1, 1:] = _BASE, _INVERSE
        _powers[:] = np.multiply.accumulate(steps, axis=1)
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``), and where each text's begin: text i has
    the words from bounds[i] to bounds[i + 1]."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = ~_GAP[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[:len(raw)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return hashes, np.searchsorted(begins, offsets)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on, where there are so many (also across texts)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[:n])


def in_parts(texts: list[bytes], most: int) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is a range of its own."""
    out, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > most:
            out.append((begin, i))
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out
