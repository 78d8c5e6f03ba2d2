import zlib
from collections import defaultdict

from loam.llm.sharding import shard
from tests.llm.tables import empty_docs, odd_docs


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_against_the_published_loop(spark):
    docs = odd_docs(spark, [(i, f"t{i}") for i in range(100, 900)])
    rows, texts = shard(docs, 13).collect(), docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.shard == jump(r.doc_id or 0, 13) and r.grown_shard == jump(r.doc_id or 0, 14)
        assert r.grown_shard in (r.shard, 13) and r.law == "key"
    want = sorted((str(t.doc_id), len((t.text or "").encode()) + 16, zlib.crc32((t.text or "").encode())) for t in texts)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty(spark):
    assert shard(empty_docs(spark)).collect() == []


def test_stays_native(spark):
    plan = shard(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
