"""Numpy part of periodic run detection: suffix array, common prefixes, branching squares, runs."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffix array of integer ``codes`` whose last element occurs once.

    Prefix doubling; each round sorts only what is still tied. Returns the order, the
    rank of each suffix, the ranks by level (level k tells suffixes apart by their first
    2**k codes) and, for each place in the order, the first level that told it from the
    place before.
    """
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    head = np.r_[True, ranked[1:] != ranked[:-1]]
    start = np.flatnonzero(head)
    rank[order] = start[np.cumsum(head) - 1]
    levels = [rank.astype(np.int32)]
    born = np.where(head, 0, -1).astype(np.int8)
    span = 1
    while True:
        tied = np.flatnonzero(~(head & np.r_[head[1:], True]))
        if not len(tied):
            break
        place = order[tied]
        after = rank[np.minimum(place + span, n - 1)]
        pair = rank[place] * n + after
        by = np.argsort(pair, kind="stable")
        order[tied] = place[by]
        pair = pair[by]
        # the slots of a tie stay together, so neighbours with unequal pairs part here
        parted = tied[1:][pair[1:] != pair[:-1]]
        fresh = parted[~head[parted]]
        head[fresh] = True
        born[fresh] = len(levels)
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank = rank.copy()
        rank[order[tied]] = group[tied]
        levels.append(rank.astype(np.int32))
        span *= 2
    return order, rank, levels, born


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray], born: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in the order."""
    shared = np.zeros(len(order), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        at = np.flatnonzero(born > level)  # told apart later, so equal up to some 2**level
        a, b = order[at - 1] + shared[at], order[at] + shared[at]
        # a suffix that ends here is told apart by the last code, which occurs once
        equal = levels[level][a] == levels[level][b]
        shared[at[equal]] += 1 << level
    return shared


def _bounds(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place k with shared[k] > 0: where the suffixes left of it start that share
    more than shared[k] with their neighbours, and the end of those right of it that share
    at least as much. The two stretches are the sides that meet at k."""
    values = shared.tolist()
    n = len(values)
    left, right = [0] * n, [n] * n
    stack: list[int] = []
    for k, d in enumerate(values):
        while stack and values[stack[-1]] > d:
            right[stack.pop()] = k
        left[k] = stack[-1] if stack else 0
        if d:
            stack.append(k)
        else:
            left[k] = k
            stack = [k]
    return np.array(left, np.int64), np.array(right, np.int64)


_EXPAND = 1 << 21  # suffixes of smaller sides that are checked at once


def branching_squares(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square xx that no later one of its period follows: the
    suffixes at i and at i + period share exactly ``period`` codes.

    Two suffixes share exactly d codes when they lie on different sides of a place of
    the order where the common prefix is d. Of both sides the smaller is gone through:
    for each suffix i there, the rank of i + d and of i - d tells whether it lies on the
    other side. Every pair meets at one place, and smaller sides sum to n log n.
    """
    order, rank, levels, born = suffix_array(codes)
    shared = neighbour_prefixes(order, levels, born)
    left, right = _bounds(shared)
    n = len(codes)
    k = np.flatnonzero(shared > 0)
    lo, hi, d = left[k], right[k], shared[k]
    small_left = k - lo <= hi - k
    begin, size = np.where(small_left, lo, k), np.where(small_left, k - lo, hi - k)
    other_lo, other_hi = np.where(small_left, k, lo), np.where(small_left, hi, k)
    starts, periods = [], []
    total = np.cumsum(size)
    cut = 0
    while cut < len(k):
        done = total[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(total, done + _EXPAND)))
        s = size[cut:end]
        which = np.repeat(np.arange(cut, end), s)
        i = order[np.repeat(begin[cut:end] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))]
        for step in (d[which], -d[which]):
            j = i + step
            ok = (j >= 0) & (j < n)
            r = rank[np.where(ok, j, 0)]
            ok &= (r >= other_lo[which]) & (r < other_hi[which])
            starts.append(np.minimum(i, j)[ok])
            periods.append(d[which][ok])
        cut = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def _reach(codes: np.ndarray, start: int, period: int, least: int) -> int:
    """How far to the left of ``start`` codes equal the one ``period`` later, from ``least`` on."""
    size = 64
    while start > least:
        a = max(least, start - size)
        differ = np.flatnonzero(codes[a:start] != codes[a + period:start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, size = a, size * 4
    return start


def runs(codes: np.ndarray, owner_start: np.ndarray, least: int = 24,
         times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every maximal periodic run of ``codes`` with
    length >= max(least, times * period); ``times`` is at least 3. ``owner_start`` gives for
    each place the first place of its text; codes that close a text occur once.

    Every run ends in one branching square of its period; rotating that square to the left
    as long as codes repeat gives the run. A square of a multiple of the period gives the
    same run again and is dropped.
    """
    if times < 3:
        raise ValueError("runs of at least three periods")
    at, period = branching_squares(codes)
    # words that must still repeat to the left of the square
    need = np.maximum(least - 2 * period, (times - 2) * period)
    far = at - owner_start[at] >= need
    at, period, need = at[far], period[far], need[far]
    for k in range(1, 9):
        if not len(at):
            break
        same = (need < k) | (codes[np.maximum(at - k, 0)] == codes[np.maximum(at - k, 0) + period])
        at, period, need = at[same], period[same], need[same]
    by = np.lexsort((period, at + 2 * period))
    at, period, need = at[by], period[by], need[by]
    ends = at + 2 * period
    found = []
    cuts = np.r_[np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]), len(ends)] if len(ends) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        group = np.arange(a, b)
        while len(group):
            i, q = int(at[group[0]]), int(period[group[0]])
            first = _reach(codes, i, q, int(owner_start[i]))
            if i - first >= need[group[0]]:
                found.append((first, int(ends[a]) - first, q))
                again = (period[group] % q == 0) & (at[group] >= first)
                group = group[~again]
            else:
                group = group[1:]
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    out = np.array(sorted(found), np.int64)
    return out[:, 0], out[:, 1], out[:, 2]
