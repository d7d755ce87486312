"""Word and shingle helpers that run inside Spark tasks, over blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
#: Bytes that part words: space and \\t to \\r. No byte of a longer UTF-8 sequence is among them.
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _INV)):
            steps = np.full(n + n // 4, base)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(data: bytes, gap: np.ndarray = _GAP) -> np.ndarray:
    """Hashes of the words of UTF-8 bytes, A-Z taken as a-z. gap: by byte, whether it parts words."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~gap[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its k-word shingles.

    A text of fewer words has one shingle, the whole sequence; one without
    words, or null, has none.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(encoded):
        stop, size = at, 0
        while stop < len(encoded) and (stop == at or size + len(encoded[stop]) <= _BLOCK):
            size += len(encoded[stop]) + 1
            stop += 1
        block = encoded[at:stop]
        counts = [len(b.split()) for b in block]
        h = word_hashes(b" ".join(block))
        n = max(0, len(h) - k + 1)
        s = np.full(n, np.uint64(k))
        for i in range(k):
            s = mix(s * _P + h[i : i + n])
        first = 0
        for c in counts:
            if c >= k:
                own = np.sort(s[first : first + c - k + 1])
                yield own[np.r_[True, own[1:] != own[:-1]]]
            elif c:
                x = np.full(1, np.uint64(c))
                for i in range(c):
                    x = mix(x * _P + h[first + i : first + i + 1])
                yield x
            else:
                yield np.empty(0, np.uint64)
            first += c
        at = stop
