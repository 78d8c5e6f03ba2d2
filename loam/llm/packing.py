"""Packing: length buckets whose bounds make the least padding, and token-budget batches inside each bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loam.llm.bytebpe import ByteEncoder
from loam.llm.common import bounded_batches, materialize, table, text_blocks, tokenizer_path, with_slots

#: Buckets, tokens of a batch with its padding, and the binary digits of a length; those of longer ones are rounded up.
BUCKETS, BUDGET, EXACT_BITS = 16, 65536, 20


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS, totals: np.ndarray | None = None) -> list[int]:
    """Upper bounds of at most `buckets` buckets, ascending, with the least total of counts * (bound - length).

    lengths: distinct, ascending; where an item stands for several lengths, the greatest of them, and `totals` has the
    sums of their lengths, so that padding is exact. Layer by layer, f[k][j] = min over i < j of f[k-1][i] + padding of lengths i+1..j.
    That padding is size[j] * (count[j] - count[i]) - (total[j] - total[i]), so each i is a line in size[j], with slopes
    that fall as i goes up: the lower envelope of the lines gives a layer in linear time.
    """
    n = len(lengths)
    if not n:
        return []
    count = np.concatenate(([0], np.cumsum(counts))).tolist()
    total = np.concatenate(([0], np.cumsum(counts * lengths if totals is None else totals))).tolist()
    size = [0, *lengths.tolist()]
    f = [0, *(size[j] * count[j] - total[j] for j in range(1, n + 1))]
    came = []
    for _ in range(1, min(buckets, n)):
        g, at = f.copy(), [0] * (n + 1)
        hull: list[int] = []  # lines that are lowest somewhere, by falling slope
        first = 0
        for j in range(1, n + 1):
            i = j - 1
            b = f[i] + total[i]
            while len(hull) - first >= 2:  # the last line is nowhere below both its neighbours
                p, q = hull[-2], hull[-1]
                bp, bq = f[p] + total[p], f[q] + total[q]
                if (b - bp) * (count[q] - count[p]) <= (bq - bp) * (count[i] - count[p]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            x = size[j]
            while len(hull) - first >= 2 and f[hull[first + 1]] + total[hull[first + 1]] - x * count[hull[first + 1]] <= f[hull[first]] + total[hull[first]] - x * count[hull[first]]:
                first += 1
            i = hull[first]
            g[j], at[j] = f[i] + total[i] - x * count[i] + x * count[j] - total[j], i
        came.append(at)
        f = g
    out, j = [], n
    for at in reversed(came):
        out.append(int(lengths[j - 1]))
        j = int(at[j])
        if not j:
            return out[::-1]
    out.append(int(lengths[j - 1]))
    return out[::-1]


def rounded(length: Column, bits: int = EXACT_BITS) -> Column:
    """Lengths under 2**bits as they are, longer ones rounded up to `bits` binary digits: the histogram stays bounded by
    the lengths that occur and by 2**bits for each doubling of the longest."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(length.cast("double"))) - (bits - 1), F.lit(0)))
    return (F.ceil(length / step) * step).cast("long")


def token_lengths(docs: DataFrame, tokenizer: str, end_ids: int = 1) -> DataFrame:
    """doc_id, n_tokens (with the end id) of every whole text; a null text has its end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for block in text_blocks(batches):
            encoder = encoder or ByteEncoder(tokenizer)
            n = [len(encoder.encode(t or "")) + end_ids for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, place, padding of every row of (doc_id, n_tokens).

    The global histogram of lengths gives the bounds: lengths that occur, with the least padding of all cuts between its
    bins (single lengths below 2**EXACT_BITS). A row goes to the first bucket that holds it; a batch has
    budget // bucket_tokens rows of its bucket (one, if the bound is over the budget), all full but the last. Rows of
    equal length share a bucket; rows with equal keys each take a place, null keys too; an empty table gives none.
    """
    # At most 2**(EXACT_BITS - 1) lengths for each power of two.
    told = lengths.groupBy(rounded(F.col("n_tokens")).alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("most")).toPandas().sort_values("length")
    bounds = best_bounds(*(told[c].to_numpy(np.int64) for c in ("most", "n")), buckets, told["total"].to_numpy(np.int64))
    bucket, top = F.lit(0), F.lit(bounds[0] if bounds else 1)
    for k in range(len(bounds) - 1):
        over = F.col("n_tokens") > bounds[k]
        bucket, top = F.when(over, k + 1).otherwise(bucket), F.when(over, bounds[k + 1]).otherwise(top)
    rows = with_slots(lengths.withColumn("bucket", bucket.cast("int")).withColumn("bucket_tokens", top.cast("long")), "bucket", [F.col("doc_id"), F.col("n_tokens")], rows=int(told["n"].sum()))
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket_tokens")), F.lit(1)).cast("long")
    return rows.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("slot") / room).cast("long").alias("batch"), (F.col("slot") % room).cast("long").alias("place"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))


def pack_documents(docs: DataFrame, tokenizer: str, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """`pack` over the lengths of all documents in ids of a tokenizer; null and empty texts have their end id alone."""
    return pack(materialize(token_lengths(docs, tokenizer), "lengths"), buckets, budget)


def op8_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
