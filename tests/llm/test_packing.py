from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm.common import tokenizer_path
from loam.llm.packing import best_bounds, pack, pack_documents, rounded
from tests.llm.tables import empty_docs, odd_docs


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(60))
def test_bounds_are_the_best(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 9)), int(rng.integers(1, 6))
    lengths, counts = np.sort(rng.choice(60, n, replace=False) + 1), rng.integers(1, 9, n)
    got = best_bounds(lengths, counts, k)
    every = ([*c, lengths[-1]] for m in range(min(k, n)) for c in combinations(lengths[:-1], m))
    assert len(got) <= k and padding(lengths, counts, got) == min(padding(lengths, counts, b) for b in every)


def check(rows, buckets, budget):
    batches = defaultdict(list)
    for r in rows:
        assert 0 <= r.padding == r.bucket_tokens - r.n_tokens
        batches[r.bucket, r.batch].append(r)
    assert len({r.bucket for r in rows}) <= buckets
    for (bucket, batch), held in batches.items():
        room = max(1, budget // held[0].bucket_tokens)
        assert sorted(r.place for r in held) == list(range(len(held)))
        assert len(held) == room or batch == max(b for k, b in batches if k == bucket)


def test_batches(spark):
    rng = np.random.default_rng(1)
    lengths = [(int(i % 400), int(n)) for i, n in enumerate(np.minimum(rng.pareto(1.0, 1000) * 50 + 1, 90000))] + [(None, 3), (None, 3)]
    rows = pack(spark.createDataFrame(lengths, "doc_id long, n_tokens long"), 5, 2000).collect()
    assert sorted(str((r.doc_id, r.n_tokens)) for r in rows) == sorted(map(str, lengths))
    check(rows, 5, 2000)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 3, 4096).collect()
    assert len(rows) == docs.count() and min(r.n_tokens for r in rows) == 1
    check(rows, 3, 4096)
    assert pack_documents(empty_docs(spark), tokenizer_path("byte_bpe_50k.json")).collect() == []


def test_rounding_is_up_and_bounded(spark):
    rows = spark.range(1, 300000, 7).select(F.col("id"), rounded(F.col("id"), 12).alias("r")).collect()
    assert all(r.id <= r.r <= r.id * 1.001 + 1 for r in rows) and all(r.r == r.id for r in rows if r.id < 4096)


def test_long_lengths_are_counted_exactly(spark):
    lengths = [5001] * 3 + [8193, 8195, 8199, 9001] + [100003] * 2
    rows = pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long"), 3).collect()
    assert sorted({r.bucket_tokens for r in rows}) == [5001, 9001, 100003]
    assert sum(r.padding for r in rows) == 808 + 806 + 802
    assert padding([10, 20], [3, 1], best_bounds(np.array([10, 20]), np.array([3, 1]), 1, np.array([27, 20]))) == 30
    assert spark.range(1 << 20).where(rounded(F.col("id")) != F.col("id")).count() == 0
    one = pack(spark.createDataFrame([(1, 8193), (2, 8194), (3, 8201)], "doc_id long, n_tokens long"), 1).collect()
    assert sum(r.padding for r in one) == 8 + 7
