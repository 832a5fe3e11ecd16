"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from roughcut.llm.common import SHINGLE_WORDS

#: Texts are hashed together until they hold so many bytes (a longer one alone).
CHUNK_BYTES = 2 << 20

_U = np.uint64
_WORD = np.zeros(256, bool)
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyz":
    _WORD[_c] = True
_WORD[0x80:] = True
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the splitmix64 finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mix(np.arange(1, 257, dtype=_U))
_POWERS = np.cumprod(np.full(64, _BASE, _U))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(2 * n, _BASE, _U))
    return _POWERS


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and the number of the text it is in."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = _WORD[buf]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, _U), np.empty(0, np.int64)
    lengths = ends - starts
    at = np.repeat(starts, lengths)
    within = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = _VALUE[buf[at + within]] * _powers(int(lengths.max()))[within]
    hashes = mix(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(_U))
    text_end = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.searchsorted(text_end, starts, side="right")


def shingles(texts: list[str], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words, and the number of its text, in order.

    A text of fewer words gives one shingle of all its words; one without words
    gives none.
    """
    words, owner = word_hashes(texts)
    n = len(words)
    if not n:
        return words, owner
    first = np.searchsorted(owner, np.arange(len(texts)))
    count = np.searchsorted(owner, np.arange(len(texts)), side="right") - first
    total = np.zeros(n, _U)
    last = (first + count)[owner]  # where the word's text ends
    index = np.arange(n)
    for j in range(k):
        power = _powers(k)[j]
        if j == 0:
            total += words * power
        else:
            shifted = np.zeros(n, _U)
            shifted[:n - j] = words[j:] if j < n else words[:0]
            total += np.where(index + j < last, shifted, _U(0)) * power
    keep = (index + k <= last) | ((count[owner] < k) & (index == first[owner]))
    size = np.minimum(count[owner], k).astype(_U)
    return mix(total + size)[keep], owner[keep]


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(owner, hash)`` in order, with how often each occurs."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.empty(0, int)
    return h[new], o[new], np.diff(np.r_[new, len(h)])


def chunks(texts: Iterable[str], most: int = CHUNK_BYTES) -> Iterator[list[int]]:
    """Indices of consecutive texts that together hold about ``most`` characters."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(t)
    if held:
        yield held


def jaccard(ha: np.ndarray, ca: np.ndarray, hb: np.ndarray, cb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted hash arrays with counts."""
    total = int(ca.sum()) + int(cb.sum())
    if not total:
        return 0.0
    if len(ha) > len(hb):
        ha, ca, hb, cb = hb, cb, ha, ca
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[at] == ha
    both = int(np.minimum(ca[same], cb[at[same]]).sum())
    return both / (total - both)
