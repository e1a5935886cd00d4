"""Suffix arrays, longest-previous-factor arrays and winnowed anchors of byte strings, as array operations."""

from __future__ import annotations

import functools

import numpy as np

#: Any odd number works; powers of it and of its inverse shift a rolling sum.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Bits of a place in a piece.
PLACE_BITS = 23


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    return up, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any slices of a byte string from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        n = max(1 << 16, 1 << (len(data) + 1).bit_length())
        up, self.down = _powers(n)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        with np.errstate(over="ignore"):
            return _mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def _sliding_minimum(value: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbours: suffix minima of one block and prefix minima of the next."""
    n = len(value) - span + 1
    padded = np.full(-(-len(value) // span) * span, MASK, np.uint64)
    padded[: len(value)] = value
    blocks = padded.reshape(-1, span)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(left[:n], right[span - 1 : span - 1 + n])


#: The white space of the word rules.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_edges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after) of the words of a text."""
    edges = np.flatnonzero(np.diff(~SPACE[np.frombuffer(raw, np.uint8)], prepend=False, append=False))
    return edges[::2], edges[1::2]


def word_windows(raw: bytes, edges: tuple[np.ndarray, np.ndarray], words: int, gram: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(mark, hash) of every run of ``words`` words of a text. The mark is the least hash of the run's grams of
    ``gram`` words, so equal runs have equal marks and one mark serves many neighbouring runs."""
    starts, ends = edges
    if len(starts) < words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    one = []  # hashes of words, in pieces of bounded memory (a word may be longer than a piece)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + piece)))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        one.append(Rolling(np.frombuffer(raw, np.uint8, hi - lo, lo)).hashes(starts[at:stop] - lo, ends[at:stop] - lo))
        at = stop
    h = np.concatenate(one)
    with np.errstate(over="ignore"):
        grams = np.zeros(len(h) - gram + 1, np.uint64)
        for j in range(gram):
            grams = grams * np.uint64(BASE) + h[j : j + len(grams)]
        up, down = _powers(max(1 << 16, 1 << len(h).bit_length()))
        sums = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)], dtype=np.uint64)]
        n = len(h) - words + 1
        whole = _mixed((sums[words:] - sums[:n]) * down[:n])
    return _sliding_minimum(_mixed(grams), words - gram + 1), whole


def anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, first, last) of the anchors of a string.

    The anchor of a window is its gram of the least hash, the leftmost on a tie, so equal windows have equal
    anchors at equal places. Each start of a window belongs to one anchor, which owns the run first..last.
    """
    span = window - gram + 1
    n = len(data) - window + 1
    if n < 1:
        e = np.zeros(0, np.int64)
        return e, e.astype(np.uint64), e, e
    if len(data) >= 1 << PLACE_BITS:
        raise ValueError(f"a piece must have fewer than {1 << PLACE_BITS} bytes")
    h = Rolling(data).all_of(gram)
    # the same bits of the hash count in every piece, whatever its length, or equal windows could differ in anchors
    place_bits = PLACE_BITS
    value = (h >> np.uint64(place_bits) << np.uint64(place_bits)) | np.arange(len(h), dtype=np.uint64)
    least = _sliding_minimum(value, span)
    at = (least & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], n] - 1
    return at[first], h[at[first]], first, last


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(suffixes in order of their first ``depth`` bytes or more, ranks by prefix length) by prefix doubling from
    8-byte keys. Equal ranks at a length mean equal prefixes of that length; zero bytes follow the end."""
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    ranks: dict[int, np.ndarray] = {}
    h = 8
    while True:
        order = np.argsort(key, kind="stable" if h >= depth else None)
        in_order = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[True, in_order[1:] != in_order[:-1]])
        ranks[h] = new
        if h >= depth:
            return order, ranks
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - h)] = new[h:]
        key = (new << 32 | nxt).astype(np.uint64)
        h *= 2


def common_prefix(data: np.ndarray, ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b (different places), up to twice the longest rank."""
    n = len(data)
    off = np.zeros(len(a), np.int64)
    for h in sorted(ranks, reverse=True):
        x, y = a + off, b + off
        inside = (x < n) & (y < n)
        same = inside & (ranks[h][np.minimum(x, n - 1)] == ranks[h][np.minimum(y, n - 1)])
        off += np.where(same, h, 0)
    live = np.ones(len(a), bool)
    for _ in range(8):
        x, y = a + off, b + off
        live &= (x < n) & (y < n)
        live &= data[np.minimum(x, n - 1)] == data[np.minimum(y, n - 1)]
        off += live
    return np.minimum(off, n - np.maximum(a, b))


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place of a smaller value, or -1, by pointer jumping."""
    n = len(values)
    found = np.arange(-1, n - 1)
    todo = np.arange(n)
    guard = np.r_[values, np.iinfo(np.int64).min]  # place -1 is smaller than all
    while len(todo):
        todo = todo[guard[found[todo]] > values[todo]]
        found[todo] = found[found[todo]]
    return found


def factors(data: np.ndarray, depth: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, longest next factor) of each place, exact up to ``depth``.

    The longest match with an earlier place is with the previous or the next suffix, in suffix order, that starts
    earlier; likewise for later places. Pairs that cannot share ``least`` bytes by their ranks are left at 0.
    """
    order, ranks = suffix_ranks(data, depth)
    known = [h for h in ranks if h <= least]
    out = []
    for places in (order, -order):
        best = np.zeros(len(data), np.int64)
        before = _nearest_smaller(places)
        after = len(data) - 1 - _nearest_smaller(places[::-1])[::-1]
        after[after == len(data)] = -1
        for near in (before, after):
            own = np.flatnonzero(near >= 0)
            a, b = order[own], order[near[own]]
            if known:
                keep = ranks[max(known)][a] == ranks[max(known)][b]
                a, b = a[keep], b[keep]
            np.maximum.at(best, a, common_prefix(data, ranks, a, b)) if len(a) else None
        out.append(best)
    return out[0], out[1]
