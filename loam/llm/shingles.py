"""Words and sets of word shingles as 64-bit hashes, straight from Arrow's text buffers, a block of documents at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multipliers of the mixer; fixed values of a published finalizer and of the golden ratio.
_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random 64-bit value for each byte; A-Z have those of a-z where letters are folded.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
#: Base of the word polynomial and its inverse modulo 2**64.
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[k] = p
    return _POWERS[0][:n], _POWERS[1][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column one after the other, and where each text begins and ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(texts) else np.zeros(1, np.int64)


def words_of(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and the bounds of each text's words.

    Words are runs without ASCII white space; `fold` reads A-Z as a-z. A hash is a polynomial over random values of
    the bytes, taken from one running sum of the whole block.
    """
    raw, at = text_bytes(texts)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(texts) + 1, np.int64)
    on = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at[(at < n)]] = True
    before = np.concatenate(([False], on[:-1]))
    starts = np.flatnonzero(on & (~before | edge[:n]))
    after = np.concatenate((on[1:], [False]))
    ends = np.flatnonzero(on & (~after | edge[1:])) + 1
    ends[-1:] = np.where(len(ends) and ends[-1] > n, n, ends[-1:])
    powers, back = _powers(n)
    total = np.concatenate(([np.uint64(0)], np.cumsum((_FOLDED if fold else _BYTE)[raw] * powers)))
    hashes = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All sets one after the other, each sorted, and the bounds of each.

    A set holds the distinct windows of `width` words; with fewer words the whole sequence is the one shingle; null
    texts and texts without words have the empty set.
    """
    h, _, _, bounds = words_of(texts)
    n = len(h)
    counts = np.diff(bounds)
    if not n:
        return h, np.zeros(len(counts) + 1, np.int64)
    left = np.repeat(bounds[1:], counts) - np.arange(n)  # words from here to the end of the text
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        step = np.full(n, _GOLD)
        if k < n:
            step[: n - k] = h[k:]
        step[left <= k] = _GOLD
        rolled = mix(rolled * _GOLD + step + np.uint64(k + 1))
    first = np.zeros(n, bool)
    first[bounds[:-1][counts > 0]] = True
    take = (left >= width) | (first & (left < width))
    docs = np.repeat(np.arange(len(counts)), counts)[take]
    rolled = rolled[take]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=len(counts)))))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rolled[a:b].sort()
    keep = np.ones(len(rolled), bool)
    keep[1:] = (rolled[1:] != rolled[:-1]) | (docs[1:] != docs[:-1])
    return rolled[keep], np.concatenate(([0], np.cumsum(np.bincount(docs[keep], minlength=len(counts)))))
