"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): all pairs interact, in time that
is linear in the features of a text. Words have their share of the text as value; each statistic is one of BINS
indicator features, and so is the metadata column n_chars.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loam.llm.common import bounded_batches, table, text_blocks
from loam.llm.sample import SAMPLE_BYTES, held_out, labelled_keys, labelled_texts
from loam.llm.shingles import text_bytes, words_of
from loam.llm.textstats import BINS, COUNTS, STATISTICS, binned, class_counts, repeats

#: Buckets of words (a power of two), rank, labelled rows that a fit takes at most, passes, rate and decay.
WORD_BITS, RANK, SAMPLE_ROWS, EPOCHS, RATE, DECAY = 15, 8, 4000, 12, 0.1, 1e-4
FEATURES = (1 << WORD_BITS) + (STATISTICS + 1) * BINS


def features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature ids, their values, and the bounds of each row."""
    raw, at = text_bytes(texts)
    hashes, _, _, bounds = words_of(texts)
    n = np.diff(bounds)
    docs = np.repeat(np.arange(len(n)), n)
    keys, count = np.unique((docs << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    owner = keys >> WORD_BITS
    stats = binned(class_counts(raw, at), n, repeats(hashes, docs, len(n)))
    stats = np.column_stack((stats, np.searchsorted(COUNTS * 6, n_chars)))
    dense = (1 << WORD_BITS) + np.arange(STATISTICS + 1) * BINS + stats
    rows = np.concatenate((owner, np.repeat(np.arange(len(n)), STATISTICS + 1)))
    ids = np.concatenate((keys & ((1 << WORD_BITS) - 1), dense.ravel()))
    values = np.concatenate((count / np.maximum(n, 1)[owner], np.ones(dense.size)))
    order = np.argsort(rows, kind="stable")
    return ids[order].astype(np.int32), values[order].astype(np.float32), np.searchsorted(rows[order], np.arange(len(n) + 1))


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, ids: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of each factor; rows must not be empty."""
        x = values[:, None]
        vx = self.v[ids] * x
        sums = np.add.reduceat(vx, bounds[:-1], 0)
        squares = np.add.reduceat(vx * vx, bounds[:-1], 0)
        linear = np.add.reduceat(self.w[ids] * values, bounds[:-1])
        return self.w0 + linear + 0.5 * (sums * sums - squares).sum(1), sums

    def score(self, ids: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, values, bounds)[0].astype(np.float64), -30, 30)))


def fit(ids: np.ndarray, values: np.ndarray, bounds: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Machine:
    """Logistic loss by adaptive gradient steps over small batches; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32))
    gw, gv, g0 = np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, RANK), 1e-6, np.float32), 1e-6
    for _ in range(epochs if len(labels) else 0):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), 64):
            pick = order[k : k + 64]
            size = bounds[pick + 1] - bounds[pick]
            cut = np.concatenate(([0], np.cumsum(size)))
            flat = np.repeat(bounds[pick] - cut[:-1], size) + np.arange(cut[-1])
            i, x = ids[flat], values[flat]
            raw, sums = m.raw(i, x, cut)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]).astype(np.float32)
            e = np.repeat(slope, size)
            used, at = np.unique(i, return_inverse=True)
            dw = np.bincount(at, e * x, len(used)).astype(np.float32) / len(pick) + DECAY * m.w[used]
            part = (e * x)[:, None] * (np.repeat(sums, size, 0) - m.v[i] * x[:, None])
            dv = np.stack([np.bincount(at, part[:, f], len(used)) for f in range(RANK)], 1).astype(np.float32) / len(pick) + DECAY * m.v[used]
            d0 = float(slope.mean())
            g0 += d0 * d0
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.w0 -= RATE * d0 / np.sqrt(g0)
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
    return m


def _inputs(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns that a score is made of; n_chars is counted where the table has none."""
    bounded_batches(docs.sparkSession)
    given = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(given, F.length("text"), F.lit(0)).cast("long").alias("n_chars"), *more)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Machine:
    """Fits on at most `sample_rows` labelled texts of `sample_bytes` bytes together; held-out rows are left out.

    What comes to the driver is bounded by both: a word has two bytes at least and gives one feature of eight at most.
    Those with the least hash of their key are taken; of several rows of a key one counts, and of several labels the
    highest. Without labelled rows every score is 0.5.
    """
    bounded_batches(docs.sparkSession)
    rows = labelled_texts(docs, labelled_keys(labels, sample_rows), sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            ids, values, bounds = features(block.column("text"), np.asarray(block.column("n_chars")))
            cut = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays([block.column("_id"), block.column("label"), pa.ListArray.from_arrays(cut, pa.array(ids)), pa.ListArray.from_arrays(cut, pa.array(values))], names=["doc_id", "label", "ids", "x"])

    got = rows.select("_id", "label", "text", "n_chars").mapInArrow(run, "doc_id long, label int, ids array<int>, x array<float>").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0))
    ids = np.concatenate([np.asarray(c.flatten()) for c in got.column("ids").chunks])
    values = np.concatenate([np.asarray(c.flatten()) for c in got.column("x").chunks])
    size = np.concatenate([np.asarray(c.value_lengths()) for c in got.column("ids").chunks])
    return fit(ids, values, np.concatenate(([0], np.cumsum(size))), np.asarray(got.column("label")).astype(np.float32))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good quality likelier) and predicted of every whole text.

    Only text and n_chars go into a score; keys, labels, lang and source don't. Null texts count as empty ones, which
    have a score by their statistics. Equal texts with equal n_chars have equal scores. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            s = machine.score(*features(block.column("text"), np.asarray(block.column("n_chars"))))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return _inputs(docs, held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs that the machine predicts to be good, with all their columns, whatever those are.

    Null and empty texts are scored by their statistics; n_chars is counted where it is null or no column. Equal texts
    with equal n_chars stay or go together, long ones are read whole, and an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    with_size = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            texts = block.column("text")
            size = pc.cast(block.column("n_chars"), pa.int64()) if with_size else pa.nulls(block.num_rows, pa.int64())
            size = pc.fill_null(pc.coalesce(size, pc.cast(pc.utf8_length(texts), pa.int64())), 0)
            yield block.filter(pa.array(machine.score(*features(texts, np.asarray(size))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
