"""Quality rules: a linear-chain conditional random field labels every line content or boilerplate.

Each line has statistic bins and a few marks as indicator features; transitions weigh neighbouring labels. Viterbi
decoding gives the labels of all lines of a text, and a text stays if words on content lines have a large enough
share. The counts of the base rules stand beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.llm.common import bounded_batches, table, text_blocks
from loam.llm.sample import SAMPLE_BYTES, labelled_keys, labelled_texts
from loam.llm.shingles import _BYTE, _powers, mix, text_bytes, words_of
from loam.llm.textstats import BINS, CLASSES, STATISTICS, binned, class_counts, repeats

#: Labelled rows that a fit takes at most, passes, rate, and the share of words on content lines that keeps a text.
SAMPLE_ROWS, EPOCHS, RATE, CONTENT_SHARE = 2000, 200, 0.3, 0.5
#: Marks of a line beside the statistics: without words, seen before in its text, first line, last line.
MARKS = 4
FEATURES = STATISTICS * BINS + MARKS
CONTENT, BOILERPLATE = 0, 1


@dataclass
class Lines:
    """The lines of a block: bounds of each text's lines, words of each line, features, and which repeat."""

    bounds: np.ndarray
    words: np.ndarray
    ids: np.ndarray  # STATISTICS columns of feature ids
    marks: np.ndarray  # MARKS columns of 0 or 1
    again: np.ndarray  # has a word and equals an earlier line of its text


def _line_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, back = _powers(len(raw) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[raw] * powers[: len(raw)])))
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _seen_before(group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether an equal (group, hash) stands earlier."""
    order = np.lexsort((np.arange(len(group)), hashes, group))
    again = np.zeros(len(group), bool)
    again[order[1:]] = (group[order[1:]] == group[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    return again


def lines_of(texts: pa.Array, words: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None) -> Lines:
    """Cuts texts at line feeds; every text has a line at least."""
    raw, at = text_bytes(texts)
    hashes, word_at, _, _ = words or words_of(texts, fold=False)
    feeds = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate((at[:-1], feeds + 1)), kind="stable")
    # A feed that ends a text begins a last, empty line of it, before the next text's first one.
    text_of = np.concatenate((np.arange(len(at) - 1), np.searchsorted(at, feeds, side="right") - 1))
    order = np.lexsort((np.concatenate((at[:-1], feeds + 1)), text_of))
    starts, text_of = np.concatenate((at[:-1], feeds + 1))[order], text_of[order]
    last = np.concatenate((text_of[1:] != text_of[:-1], [True])) if len(text_of) else np.zeros(0, bool)
    ends = np.where(last, at[text_of + 1], np.concatenate((starts[1:] - 1, [0]))[: len(starts)])
    count = len(starts)
    line_of = np.searchsorted(starts, word_at, side="right") - 1
    n = np.bincount(line_of, minlength=count)
    # Counts between the starts of lines; a line's own feed is of no class that a statistic uses.
    totals = class_counts(raw, np.append(starts, len(raw)), tuple(k for k in CLASSES if k != "line"))
    stats = binned(totals, n, repeats(hashes, line_of, count))
    dup = _seen_before(text_of, _line_hashes(raw, starts, ends)) & (n > 0)
    first = np.concatenate(([True], text_of[1:] != text_of[:-1])) if count else last
    marks = np.stack((n == 0, dup, first, last), 1)
    return Lines(np.searchsorted(text_of, np.arange(len(at))), n, np.arange(STATISTICS) * BINS + stats, marks, dup)


@dataclass
class Chain:
    """weights: FEATURES x 2 labels; steps[i, j]: from label i to label j."""

    weights: np.ndarray
    steps: np.ndarray

    def emissions(self, lines: Lines) -> np.ndarray:
        return self.weights[lines.ids].sum(1) + lines.marks.astype(np.float64) @ self.weights[STATISTICS * BINS :]

    def decode(self, lines: Lines) -> np.ndarray:
        """The best label sequence of each text; all texts of a block advance line by line together."""
        e = self.emissions(lines)
        size = np.diff(lines.bounds)
        order = np.argsort(-size, kind="stable")
        begin, size = lines.bounds[:-1][order], size[order]
        best = np.zeros((len(size), 2))
        back = np.zeros((len(e), 2), np.int8)
        longest = int(size.max(initial=0))
        live = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more than t lines
        for t in range(longest):
            m = live[t]
            at = begin[:m] + t
            if t:
                paths = best[:m, :, None] + self.steps
                back[at] = paths.argmax(1)
                best[:m] = paths.max(1) + e[at]
            else:
                best[:m] = e[at]
        out = np.zeros(len(e), np.int8)
        now = best.argmax(1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            m = live[t]
            at = begin[:m] + t
            out[at] = now[:m]
            if t:
                now[:m] = back[at, now[:m]]
        return out


def fit(lines: Lines, labels: np.ndarray, epochs: int = EPOCHS) -> Chain:
    """Conditional log-likelihood of the label sequences by adaptive gradient steps over all rows."""
    chain = Chain(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    if not len(labels):
        return chain
    size = np.diff(lines.bounds)
    order = np.argsort(-size, kind="stable")
    begin, size = lines.bounds[:-1][order], size[order]
    longest = int(size.max())
    live = np.searchsorted(-size, -np.arange(longest), side="left")
    ids, marks = lines.ids, lines.marks.astype(np.float64)
    want = np.eye(2)[labels]
    real = np.zeros((2, 2))
    inner = np.ones(len(labels), bool)
    inner[lines.bounds[:-1]] = False
    np.add.at(real, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
    gw, gs = np.full(chain.weights.shape, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(epochs):
        e = np.exp(np.clip(chain.emissions(lines), -20, 20))
        s = np.exp(chain.steps)
        ahead, behind = np.zeros((len(e), 2)), np.ones((len(e), 2))
        for t in range(longest):
            at = begin[: live[t]] + t
            a = e[at] if not t else (ahead[at - 1] @ s) * e[at]
            ahead[at] = a / a.sum(1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            at = begin[: live[t + 1]] + t
            b = (behind[at + 1] * e[at + 1]) @ s.T
            behind[at] = b / b.sum(1, keepdims=True)
        p = ahead * behind
        p /= p.sum(1, keepdims=True)
        at = np.flatnonzero(inner)
        pairs = ahead[at - 1][:, :, None] * s[None] * (e[at] * behind[at])[:, None, :]
        pairs /= pairs.sum((1, 2), keepdims=True) if len(at) else 1
        slope = (p - want) / len(labels)
        dw = np.zeros(chain.weights.shape)
        for c in range(STATISTICS):
            for k in (0, 1):
                dw[:, k] += np.bincount(ids[:, c], slope[:, k], FEATURES)
        dw[STATISTICS * BINS :] += marks.T @ slope
        dw += 1e-5 * chain.weights
        ds = (pairs.sum(0) - real) / len(labels)
        gw, gs = gw + dw * dw, gs + ds * ds
        chain.weights -= RATE * dw / np.sqrt(gw)
        chain.steps -= RATE * ds / np.sqrt(gs)
    return chain


def spliced(lines: Lines, labels: np.ndarray) -> tuple[Lines, np.ndarray]:
    """Lines and their labels for a fit: every text with its own label, and texts of both labels spliced.

    A label of a text says nothing of where its lines change, so pairs of a good and a bad text, in the given order, are
    set one behind the other, by turns bad in front, bad behind, and bad in the middle of a good one. The label changes
    where the texts meet; the marks of first and last lines are those of the whole.
    """
    size = np.diff(lines.bounds)
    texts = [np.arange(a, b) for a, b in zip(lines.bounds[:-1], lines.bounds[1:], strict=True)]
    good, bad = ([t for t, y in zip(texts, labels, strict=True) if y == want and len(t)] for want in (CONTENT, BOILERPLATE))
    parts = [(t,) for t in texts]
    for k, (g, b) in enumerate(zip(good, bad, strict=False)):
        half = len(g) // 2
        parts.append(((b, g), (g, b), (g[:half], b, g[half:]))[k % 3 if half else k % 2])
    own = np.repeat(labels, size)
    rows = np.concatenate([x for p in parts for x in p]) if parts else np.zeros(0, np.int64)
    bounds = np.concatenate(([0], np.cumsum([sum(map(len, p)) for p in parts]))).astype(np.int64)
    marks = lines.marks[rows].copy()
    marks[:, 2:] = 0
    marks[bounds[:-1], 2] = 1
    marks[bounds[1:] - 1, 3] = 1
    return Lines(bounds, lines.words[rows], lines.ids[rows], marks, np.zeros(0)), own[rows]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """Fits on the lines of at most `sample_rows` labelled texts of `sample_bytes` bytes together, half of each label at
    most, those with the least hash of their key, and on splices of them.

    A text of good quality has content lines, one of bad quality boilerplate; blank lines go with their text; where
    labels change inside a text is learned from the splices. Of several rows of a key one counts. Rows that the classifier
    holds out are left out here too. Without labelled rows every line counts as content.
    """
    bounded_batches(docs.sparkSession)
    rows = labelled_texts(docs, labelled_keys(labels, sample_rows, True), sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            x = lines_of(block.column("text"))
            cut = pa.array(x.bounds, pa.int32())
            packed = np.concatenate((x.ids, x.marks), 1).astype(np.int16)
            flat = pa.ListArray.from_arrays(pa.array(x.bounds * packed.shape[1], pa.int32()), pa.array(packed.ravel()))
            yield pa.RecordBatch.from_arrays([block.column("_id"), block.column("label"), flat, pa.ListArray.from_arrays(cut, pa.array(x.words))], names=["id", "label", "features", "words"])

    got = rows.select("_id", "label", "text").mapInArrow(run, "id long, label int, features array<short>, words array<long>").toArrow().sort_by("id").combine_chunks()
    if not got.num_rows:
        return fit(Lines(np.zeros(1, np.int64), *[np.zeros(0)] * 4), np.zeros(0, np.int64))
    packed = np.concatenate([np.asarray(c.flatten()) for c in got.column("features").chunks]).reshape(-1, STATISTICS + MARKS).astype(np.int64)
    words = np.concatenate([np.asarray(c.flatten()) for c in got.column("words").chunks])
    size = np.concatenate([np.asarray(c.value_lengths()) for c in got.column("words").chunks])
    lines = Lines(np.concatenate(([0], np.cumsum(size))), words, packed[:, :STATISTICS], packed[:, STATISTICS:], np.zeros(0))
    return fit(*spliced(lines, np.where(np.asarray(got.column("label")) == 1, CONTENT, BOILERPLATE)))


def _repeat_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text in 3-word windows that occur there twice or more."""
    n = len(hashes)
    count = np.diff(bounds)
    if n < 3:
        return np.zeros(len(count), np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    whole = owner[2:] == owner[:-2]
    key = mix(mix(mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:])[whole]
    at, who = np.flatnonzero(whole), owner[:-2][whole]
    order = np.lexsort((key, who))
    k, w = key[order], who[order]
    same = (k[1:] == k[:-1]) & (w[1:] == w[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(n, bool)
    begin = at[order[twice]]
    for d in (0, 1, 2):
        hit[begin + d] = True
    total = np.concatenate(([0], np.cumsum(hit)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _judged(texts: pa.Array, chain: Chain, content_share: float) -> tuple[list[np.ndarray], np.ndarray, Lines]:
    """Columns from n_words to content_share, the label of each line, and the lines."""
    raw, at = text_bytes(texts)
    words = words_of(texts, fold=False)
    n = np.diff(words[3])
    counts = class_counts(raw, at, ("word_char", "symbol"))
    lines = lines_of(texts, words)
    label = chain.decode(lines)
    own = np.concatenate(([0], np.cumsum(lines.words * (label == CONTENT))))
    share = (own[lines.bounds[1:]] - own[lines.bounds[:-1]]) / np.maximum(n, 1)
    dup = np.concatenate(([0], np.cumsum(lines.again)))
    repeat = _repeat_words(words[0], words[3])
    failed = (n < 50) | (100 * repeat > 50 * n)
    return [n, counts["word_char"], counts["symbol"], dup[lines.bounds[1:]] - dup[lines.bounds[:-1]], repeat, failed, ~failed & (share >= content_share), share], label, lines


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(docs: DataFrame, chain: Chain, content_share: float = CONTENT_SHARE, with_lines: bool = False) -> DataFrame:
    """The counts of the base rules, base_failed, kept and content_share of every whole text; `with_lines` adds the
    label of every line (0 content, 1 boilerplate).

    A null or empty text has no words: it fails the base rules and its content share is 0. Equal texts are judged
    alike; every row gives one row, an empty table none; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            cols, label, lines = _judged(block.column("text"), chain, content_share)
            out = [block.column("doc_id"), *(pa.array(np.asarray(c)) for c in cols)]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            if with_lines:
                out.append(pa.ListArray.from_arrays(pa.array(lines.bounds, pa.int32()), pa.array(label)))
            yield pa.RecordBatch.from_arrays(out, names=names + ["lines"] * with_lines)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + ", lines array<tinyint>" * with_lines)


def keep_content(docs: DataFrame, chain: Chain, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever those are.

    Null and empty texts have no words and go; equal texts stay or go together; long ones are read whole; an empty table
    gives an empty one.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            yield block.filter(pa.array(_judged(block.column("text"), chain, content_share)[0][6]))

    return docs.mapInArrow(run, docs.schema)


def op6_crf_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
