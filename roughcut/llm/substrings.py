"""Numpy parts of substring deduplication: anchored segments of texts, and repeated
strings of a block of segments from its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

from roughcut.llm.shingles import mix

#: Bytes of the strings that anchor the windows.
ANCHOR = 24

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = mix(np.arange(1, 257, dtype=_U))


_KEPT: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; kept up to a million of them."""
    if len(_KEPT.get("power", ())) >= n:
        return _KEPT["power"], _KEPT["inverse"]
    both = []
    for factor in (_BASE, _INVERSE):
        x = np.full(max(n, 1 << 19), factor, _U)
        x[0] = 1
        both.append(np.cumprod(x))
    if n <= 1 << 20:
        _KEPT["power"], _KEPT["inverse"] = both
    return both[0], both[1]


class Rolling:
    """Hashes of any byte ranges of one buffer, from prefix sums modulo 2**64."""

    def __init__(self, buf: np.ndarray) -> None:
        n = len(buf)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_VALUE[buf] * power[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start]
                   + np.asarray(length).astype(_U))


    def everywhere(self, length: int) -> np.ndarray:
        """The hash of ``length`` bytes from each place that has so many."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + _U(length))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` consecutive values."""
    span, out = 1, x
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[:len(x) - w + 1], out[w - span:][:len(x) - w + 1])
    return out


def segments(buf: np.ndarray, ends: np.ndarray, length: int,
             anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Cut the windows of ``length`` bytes of several texts into segments.

    ``buf`` holds the texts one after the other, text i up to ``ends[i]``. A window's
    anchor is the ``anchor``-byte string in it with the least hash (the first of equal
    ones); consecutive windows with the same anchor at the same place form a segment.
    Equal windows have equal anchors at equal offsets. Returns, by segment: the number
    of its text, its start in that text, its number of windows, the hash of its anchor,
    and the hash of all its bytes (windows + length - 1).
    """
    begins = np.concatenate([[0], ends[:-1]])
    none = np.empty(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none
    roll = Rolling(buf)
    # the low bits hold the place, so that the least value is unique and the first of equal strings
    hashes = roll.everywhere(anchor)
    at = np.arange(len(hashes))
    bits = max(1, int(len(buf)).bit_length())
    order = (hashes >> _U(bits) << _U(bits)) | at.astype(_U)
    least = _sliding_least(order, length - anchor + 1)
    place = (least & _U((1 << bits) - 1)).astype(np.int64)
    start = at[:len(place)]
    owner = np.repeat(np.arange(len(ends)), ends - begins)[:len(place)]
    ok = start + length <= ends[owner]
    start, place, owner = start[ok], place[ok], owner[ok]
    if not len(start):
        return none, none, none, none, none
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    windows = np.diff(np.r_[new, len(start)])
    first = start[new]
    return (owner[new], first - begins[owner[new]], windows,
            hashes[place[new]].astype(np.int64), roll(first, windows + (length - 1)).astype(np.int64))


_FIRST = 8  # bytes that the first sort compares at once


def _first_keys(text: np.ndarray) -> np.ndarray:
    padded = np.concatenate([text, np.zeros(_FIRST, np.uint8)])
    key = np.zeros(len(text), _U)
    for j in range(_FIRST):
        key = key << _U(8) | padded[j:j + len(text)]
    return key


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``text`` in the order of (at least) the ``depth`` bytes from there, and
    how many bytes neighbours in that order share, counted up to the first eight.

    Prefix doubling from eight bytes on; each round sorts only what is still tied.
    """
    n = len(text)
    key = _first_keys(text)
    order = np.argsort(key)
    ranked = key[order]
    differ = ranked[1:] ^ ranked[:-1]
    shared = np.zeros(n, np.int8)
    for j in range(1, _FIRST + 1):
        shared[1:] += differ < _U(1 << (8 * (_FIRST - j))) if j < _FIRST else differ == 0
    head = np.r_[True, differ != 0]  # first of its tie
    span = _FIRST
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    while span < depth:
        at = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        rank[order] = at[group]
        tied = np.flatnonzero(~(head & np.r_[head[1:], True]))
        if not len(tied):
            break
        position = order[tied]
        after = rank[np.minimum(position + span, n)]
        pair = group[tied] * (n + 1) + after + 1
        by = np.argsort(pair)
        order[tied] = position[by]
        pair = pair[by]
        # a tie's slots stay together, so neighbours in `tied` with unequal pairs part here
        head[tied[1:]] |= pair[1:] != pair[:-1]
        span *= 2
    return order, shared


def repeated_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``text`` in suffix order, and the class of each place in that order:
    places are of one class when their suffixes share the first ``length`` bytes (at least
    eight). Strings that run over the end of the text are not told apart.

    The common prefixes of neighbours are derived by increasing value. An interval of
    the order holds the suffixes that begin with some string; for every byte that stands
    before it in the Burrows-Wheeler transform, the interval of the string with that
    byte in front follows by backward extension. Breadth first: where an extension's
    right end was not known as a boundary, the neighbours there share exactly as many
    bytes as the level has, and the extension is kept for the next level, so every
    boundary is found once. The levels below eight can be read off the sorted eight-byte
    keys; the search starts there. At level ``length`` it stops: the boundaries not found
    by then are common prefixes of at least ``length``.
    """
    if length < _FIRST:
        raise ValueError(f"strings of at least {_FIRST} bytes")
    text = np.concatenate([text, np.zeros(1, np.uint8)])  # so that the last byte extends something
    n = len(text)
    order, shared = suffix_order(text, length + 1)
    order = order.astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    before = np.where(order > 0, text[order - 1], 0).astype(np.int64)  # the transform
    step = np.where(order > 0, rank[order - 1], -1)  # backward step of each place
    found = np.ones(n + 1, bool)
    found[:n] = shared < _FIRST
    found[0] = True
    edges = np.flatnonzero(found)
    right = np.r_[shared, np.int8(_FIRST - 1)][edges[1:]]
    keep = right == _FIRST - 1
    low, high = edges[:-1][keep], edges[1:][keep]
    for _ in range(_FIRST, length):
        size = high - low
        place = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        which = np.repeat(np.arange(len(low)), size)
        to = step[place]
        key = which << 8 | before[place]
        if (to < 0).any():
            key, to = key[to >= 0], to[to >= 0]
        if not len(to):
            break
        if (key[1:] < key[:-1]).any():
            by = np.argsort(key)
            key, to = key[by], to[by]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        low, high = np.minimum.reduceat(to, new), np.maximum.reduceat(to, new) + 1
        fresh = ~found[high]
        low, high = low[fresh].astype(np.int64), high[fresh].astype(np.int64)
        found[high] = True
        if not len(low):
            break
    real = order < n - 1
    return order[real].astype(np.int64), np.cumsum(found[:n])[real]
