"""Word shingles of whole texts as 64-bit hashes, vectorised over batches of texts.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case. A text's set holds the hashes of its
distinct windows of ``SIZE`` words, or of its whole sequence if it has fewer words, or nothing. Two different shingles
of one comparison get the same hash with a probability of about 5e-20.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE = 5
#: Bytes of text hashed at once; a longer text is hashed by itself.
CHUNK = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_PLACES = mix(np.arange(1001, 1001 + SIZE, dtype=np.uint64) * _STEP) | np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        both = []
        for base in (_POWER, _INVERSE):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            both.append(np.cumprod(t))
        if n > 2 * CHUNK:
            return both[0], both[1]
        _powers = both[0], both[1]
    return _powers[0][:n], _powers[1][:n]


def _hashed(texts: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    space = _SPACE[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.r_[True, space[:-1]])
    stops = np.flatnonzero(inside[:-1] & space[1:]) + 1
    up, down = _power_tables(len(data))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[_LOWER[data]] * up)]
    words = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * _STEP)
    bounds = np.r_[0, np.searchsorted(starts, ends)]
    m = len(words) - SIZE + 1
    windows = np.zeros(max(m, 0), np.uint64)
    for k in range(SIZE):
        if m > 0:
            windows += words[k : k + m] * _PLACES[k]
    windows = mix(windows)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= SIZE:
            yield np.unique(windows[a : b - SIZE + 1])
        elif b > a:
            yield mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    with np.errstate(over="ignore"):
        part: list[bytes] = []
        size = 0
        for t in texts:
            data = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
            if part and size + len(data) > CHUNK:
                yield from _hashed(part)
                part, size = [], 0
            part.append(data)
            size += len(data) + 1
        if part:
            yield from _hashed(part)


def signature(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set that equal sets share."""
    with np.errstate(over="ignore"):
        a, b = mix(own + _STEP).sum(), mix(own ^ _POWER).sum()
    return int(np.int64(np.uint64(a))), int(np.int64(np.uint64(b)))
