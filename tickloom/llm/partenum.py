"""PartEnum signatures: sets that are similar enough share at least one.

Sizes fall into bands whose upper ends grow by a quarter; similar sets lie in
one band or in neighbouring ones. Under the tag of a band, at most k elements
are in only one of two similar sets. The feature domain is cut into n1 parts,
more than k / 2 of them, so that at least one part holds at most one such
element, and each part into n2 cells, of which all but one then agree. Every
subset of n2 - 1 cells of every part is a signature.

`slack` more parts are cut than are needed, so that 1 + slack parts agree that
well. A set in which at most `slack` parts have an empty subset needs no
signature of an empty subset: of the agreeing parts, one has none. Only sets
with more such parts give their empty subsets too, and two of those share them.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

from .shingles import mix

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = np.uint64(0xD1B54A32D192ED03)
#: Leading bits of a hash that name its cell in a table of counts.
COUNT_BITS = 20


@lru_cache(maxsize=4096)
def band_of(n: int) -> tuple[int, int, int]:
    """(index, lowest, highest size) of the band of size n."""
    i, low, high = 0, 1, 1
    while high < n:
        i, low = i + 1, high + 1
        high = low * 5 // 4
    return i, low, high


@lru_cache(maxsize=4096)
def shape(high: int, percent: int) -> tuple[int, int, int]:
    """(n1, n2, slack) for the tag of the band that ends at `high`."""
    k = (100 - percent) * 2 * high // (100 + percent)
    if k == 0:
        return 1, 1, 0
    least = k // 2 + 1
    slack = 0 if k < 8 else -(-3 * least // 10)
    return least + slack, 3 if k < 16 else 2, slack


def tags(n: int, percent: int) -> list[tuple[int, int]]:
    """(band index, its highest size) of each tag that a set of n elements needs."""
    i, _, high = band_of(n)
    out = [(i, high)]
    low = high + 1
    if 100 * n >= percent * low:
        out.append((i + 1, low * 5 // 4))
    return out


@lru_cache(maxsize=8)
def _subsets(n2: int) -> np.ndarray:
    return np.array(list(combinations(range(n2), max(1, n2 - 1))))


def count_cells(elements: np.ndarray) -> np.ndarray:
    """The cell of each hash in a table of counts."""
    return (elements >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """How common (uint8) the elements of a cell are: 0 up to what chance puts into one, else higher by an eighth of a doubling."""
    usual = float(np.median(counts))
    least = max(32.0, 8 * usual**0.5)
    over = np.maximum(counts - usual, 1) / least
    return np.where(over > 1, np.minimum(255, 1 + np.floor(8 * np.log2(over))), 0).astype(np.uint8)


def prefix(elements: np.ndarray, percent: int, levels: np.ndarray) -> np.ndarray:
    """Keys (uint64) of the rarest elements of one sorted set: so many that similar sets share one."""
    n = len(elements)
    order = np.argsort(levels[count_cells(elements)], kind="stable")
    return mix(elements[order[: n - -(-percent * n // 100) + 1]] ^ _TOKEN) if n else elements


def signatures(elements: np.ndarray, percent: int, levels: np.ndarray | None = None) -> np.ndarray:
    """Signatures (uint64) of one set of distinct hashes, without those that `levels` has as common."""
    n = len(elements)
    if not n:
        return np.empty(0, np.uint64)
    found = []
    m = mix((elements if levels is None else elements[levels[count_cells(elements)] == 0]) + _GOLD)
    value = mix(m ^ _GOLD)
    for tag, high in tags(n, percent):
        n1, n2, slack = shape(high, percent)
        cell = (m % np.uint64(n1 * n2)).astype(np.uint16 if n1 * n2 < 1 << 16 else np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
        sums = np.zeros(n1 * n2, np.uint64)
        if len(starts):
            sums[cell[starts]] = np.add.reduceat(value[order], starts)
        filled = np.zeros(n1 * n2, bool)
        filled[cell[starts]] = True
        subsets = _subsets(n2)
        total = sums.reshape(n1, n2)[:, subsets].sum(2, dtype=np.uint64)
        some = filled.reshape(n1, n2)[:, subsets].any(2)
        place = np.arange(total.size, dtype=np.uint64).reshape(total.shape)
        sig = mix(total + mix(place + np.uint64(tag * 1_000_003 + 1)))
        keep = some if (~some).any(1).sum() <= slack else np.ones_like(some)
        found.append(sig[keep])
    return np.concatenate(found)


def sketch_cells(n: int, percent: int) -> int:
    """Cells of the sketch of a set of n: a power of two, eight or more for each element that may differ, sixteen up to 1024."""
    k = (100 - percent) * 2 * n // (100 + percent)
    return 1 << min(15, max(6, min(10, (16 * k).bit_length()), (8 * k).bit_length()))


def sketch(elements: np.ndarray, percent: int) -> bytes:
    """A bit for each cell: whether an odd number of elements fall there. Two sets differ in at least as many elements as bits."""
    cells = sketch_cells(len(elements), percent)
    at = (mix(elements ^ _GOLD) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(bool), bitorder="little").tobytes()


def fold(bits: np.ndarray, to: int) -> np.ndarray:
    """Packed sketches (bytes along the last axis) brought down to `to` bytes."""
    while bits.shape[-1] > to:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_link(a: bytes, n_a: int, b: bytes, n_b: int, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return (100 + percent) * int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= (100 - percent) * (n_a + n_b)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)
