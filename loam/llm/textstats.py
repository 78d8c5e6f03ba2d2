"""Counts of character classes and repeats for documents or their lines, from Arrow's text buffers."""

from __future__ import annotations

import numpy as np

#: Symbols that the quality rules count, and the classes of bytes that statistics are made of.
SYMBOLS = b"#*$%&|<>"


def _table(members) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


WHITE = [0x20, *range(0x09, 0x0E)]
CLASSES = {
    "char": _table(b for b in range(256) if b & 0xC0 != 0x80),
    "word_char": _table(b for b in range(256) if b & 0xC0 != 0x80 and b not in WHITE),
    "upper": _table(range(65, 91)),
    "lower": _table(range(97, 123)),
    "digit": _table(range(48, 58)),
    "symbol": _table(SYMBOLS),
    "bar": _table(b"|"),
    "bang": _table(b"!?"),
    "stop": _table(b".,;:"),
    "line": _table(b"\n"),
}


def class_counts(raw: np.ndarray, cuts: np.ndarray, names=tuple(CLASSES)) -> dict[str, np.ndarray]:
    """How many bytes of each class stand between consecutive cuts."""
    out = {}
    for name in names:
        total = np.concatenate(([0], np.cumsum(CLASSES[name][raw], dtype=np.int64)))
        out[name] = np.diff(total[cuts])
    return out


def repeats(hashes: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Words equal to the one before them in the same group, for each group."""
    same = (hashes[1:] == hashes[:-1]) & (group[1:] == group[:-1])
    return np.bincount(group[1:][same], minlength=groups)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


#: Upper bounds of the bins of shares, of mean word lengths and of counts.
SHARES, LENGTHS, COUNTS = np.array([0.002, 0.01, 0.03, 0.07, 0.15, 0.3, 0.5, 0.8]), np.array([2, 3, 4, 5, 6, 7, 9, 12]), np.array([1, 3, 8, 20, 50, 200, 1000, 5000])
BINS = 9


def binned(counts: dict[str, np.ndarray], n_words: np.ndarray, again: np.ndarray) -> np.ndarray:
    """A bin from 0 to BINS - 1 for each row and statistic."""
    letters = counts["upper"] + counts["lower"]
    columns = [
        np.searchsorted(SHARES, ratio(counts["symbol"], n_words)),
        np.searchsorted(SHARES, ratio(counts["bar"], n_words)),
        np.searchsorted(SHARES, ratio(counts["bang"], n_words)),
        np.searchsorted(SHARES, ratio(counts["upper"], letters)),
        np.searchsorted(SHARES, ratio(counts["digit"], counts["char"])),
        np.searchsorted(SHARES, ratio(counts["stop"], n_words)),
        np.searchsorted(SHARES, ratio(again, n_words)),
        np.searchsorted(LENGTHS, ratio(counts["word_char"], n_words)),
        np.searchsorted(COUNTS, n_words),
    ]
    return np.stack(columns, 1)


STATISTICS = 9
