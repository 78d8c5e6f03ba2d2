import itertools
import random

import numpy as np
import pytest

from loam.llm import common, ngram_join
from loam.llm.ngram_join import near_duplicates, one_of_each
from tests.llm.tables import empty_docs, odd_docs, words


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Sorted (doc_id, n, component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[top(i)] = min(groups.get(top(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = groups.get(top(i)) if sets[i] else d
        out.append((d, len(sets[i]), c))
    return sorted(out, key=str)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(rng):
    rows = []
    for size in (3, 6, 12, 18, 30, 60, 140, 300, 700):
        base = words(rng, size, 3000)
        rows += [base, base.upper(), edited(rng, base, 1), edited(rng, base, max(1, size // 60)), edited(rng, base, max(1, size // 45)), edited(rng, base, size // 20 + 1)]
    passage = words(rng, 60, 3000)
    rows += [f"{words(rng, rng.randrange(5, 60), 3000)} {passage} {words(rng, rng.randrange(5, 60), 3000)}" for _ in range(60)]
    near = words(rng, 150, 3000)
    rows += [edited(rng, near, rng.randrange(0, 5)) for _ in range(80)]
    chain = words(rng, 100, 3000)
    for _ in range(10):
        chain = edited(rng, chain, 1)
        rows.append(chain)
    return rows


@pytest.mark.parametrize("heavy", [2, 32, None])
def test_against_all_pairs(spark, heavy):
    rng = random.Random(heavy or 99)
    texts = corpus(rng)
    ids = rng.sample(range(10**6), len(texts))
    docs = odd_docs(spark, zip(ids, texts, strict=True))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = near_duplicates(docs, heavy=heavy).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_small_blocks_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 500)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rng = random.Random(11)
    rows = list(enumerate(corpus(rng)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), heavy=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_exactly_at_the_threshold(spark):
    w = [f"t{i}" for i in range(200)]
    at = " ".join(w[:13])  # 9 shingles
    rows = [(1, at), (2, " ".join(w[:14])), (3, " ".join(w[:12])), (4, " ".join(w[50:64])), (5, " ".join(w[50:62]))]  # 9/10, 8/9, 8/10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=str) == brute(rows)


def test_one_of_each(spark):
    docs = odd_docs(spark)
    got = one_of_each(docs)
    assert got.columns == docs.columns
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, 6, 9, 11, -7, None, None], key=str)


def test_empty(spark):
    assert near_duplicates(empty_docs(spark)).collect() == [] and one_of_each(empty_docs(spark)).collect() == []


def links(rows):
    """Sorted (doc_id, number of other rows that are similar) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    return sorted(((d, sum(1 for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 80 * len(a | b))) for i, (d, a) in enumerate(zip((d for d, _ in rows), sets, strict=True))), key=str)


@pytest.mark.parametrize(("heavy", "block", "size"), [(2, 1024, 10**6), (2, 8, 500), (32, 1024, 10**6)])
def test_number_of_links(spark, monkeypatch, heavy, block, size):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", size)
    rng = random.Random(17)
    texts = corpus(rng)
    docs = odd_docs(spark, zip(rng.sample(range(100, 10**6), len(texts)), texts, strict=True))
    got = near_duplicates(docs, heavy=heavy).collect()
    want = links([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == want and max(n for _, n in want) > 32


def test_one_key_on_different_texts(spark):
    rng = random.Random(3)
    x, y = words(rng, 60, 3000), words(rng, 60, 3000)
    near = y + " tail"
    rows = [(5, x), (5, y), (9, near), (5, y), (6, None), (6, ""), (6, "a b"), (6, "a b"), (7, x + " tail"), (None, y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=str) == brute(rows)
    assert sorted(((r.doc_id, r.n_links) for r in near_duplicates(docs).collect()), key=str) == links(rows)
    got = sorted(((r.doc_id, r.text) for r in one_of_each(docs).collect()), key=str)
    assert got == sorted([(5, x), (5, y), (6, None), (6, ""), (6, "a b"), (None, y)], key=str)


def test_allocation_reaches_the_sum_at_least_cost():
    """Against all allocations: the same cost, a sum over the spread, no second unit without the first."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, need = int(rng.integers(2, 7)), int(rng.integers(1, 6))
        two = rng.random(n) < 0.5
        own, more = rng.integers(0, 9, n) * 5, rng.integers(0, 9, n) * 5
        units = int(n + two.sum() + rng.integers(0, 2))
        if units < need:
            continue
        scheme = 20 << 21
        code = [scheme | (1 << 28 | i if two[i] else 0) for i in range(n)] + [scheme | 2 << 28 | i for i in range(n) if two[i]]
        one = [*own, *(more[i] // 2 for i in range(n) if two[i])]
        extra = [*(more[i] - more[i] // 2 if two[i] else 0 for i in range(n)), *(0 for i in range(n) if two[i])]
        facts = {"group": np.array([20]), "units": np.array([units]), "need": np.array([need])}
        mode, least, dense, asks, _ = ngram_join.allocate(np.zeros(len(code), np.int64), np.array(code, np.uint32), np.array(one), np.array(extra), facts)
        free = units - n - int(two.sum())
        assert asks[0] == (need > free) and not dense[0]
        v = [int(min(mode[i], 2)) if two[i] else int(mode[i] > 0) for i in range(n)]
        assert all(mode[n + k] == (3 if v[i] == 2 else 0) for k, i in enumerate(np.flatnonzero(two)))
        if not asks[0]:
            assert not any(v)
            continue
        assert free + sum(v) >= need and least[0] == free + sum(v) - need + 1
        # The dearest unit that is taken is as cheap as it can be.
        worth = lambda v: max((max(own[i], more[i]) if x == 2 else own[i] for i, x in enumerate(v) if x), default=0)  # noqa: B023, E731
        every = itertools.product(*(range(3 if t else 2) for t in two))
        assert max(worth(v), ngram_join.CHEAP) <= max(min(worth(w) for w in every if free + sum(w) >= need), ngram_join.CHEAP)


def test_batches_with_heavy_entries_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BATCH_ROWS", 300)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = random.Random(23)
    rows = list(enumerate(corpus(rng)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), heavy=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == links(rows)


@pytest.mark.parametrize("heavy", [2, 3])
def test_sets_that_go_to_further_levels(spark, heavy):
    """Segments so large that many sets, though not all, have too few subsets on levels 0 and 1."""
    rng = random.Random(heavy)
    fill = (3.4, 5)
    texts = []
    for _ in range(12):
        base = words(rng, rng.choice([24, 40, 90, 150, 165, 300, 322]), 4000)
        texts += [base, *(edited(rng, base, rng.randrange(1, 4)) for _ in range(5)), base + " " + words(rng, rng.randrange(1, 30), 4000)]
    rows = list(enumerate(texts))
    levels = {tuple(code % 4 for code, *_ in ngram_join.schemes(np.sort(np.array([hash(x) & (1 << 63) - 1 for x in shingles(t)], np.uint64)), 80, 100, fill)) for t in texts}
    assert len(levels) > 3 and any(len(x) != len(y) for x in levels for y in levels if x[0] == y[0])
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), heavy=heavy, fill=fill).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == links(rows)


def test_one_of_each_keeps_columns_of_any_name(spark):
    """Columns that are named as the function's own, and one doc_id that stands twice."""
    names = ["_root", "_node", "_doc", "_set", "_least", "_nth", "_key", "_row", "_text", "_again", "_gone", "node", "root"]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text + " z", "b"), (1, "another text of six words here", "c"), (2, text, "d"), (3, None, "e"), (None, text, "f")]
    docs = spark.createDataFrame([(i, t, *[f"{v}{n}" for n in names]) for i, t, v in rows], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    got = one_of_each(docs)
    assert got.columns == docs.columns
    left = {(r.doc_id, r.text) for r in got.collect()}
    assert {(1, rows[2][1]), (3, None), (None, text)} <= left and (2, text) not in left and len(left) == 4
    assert all({r[n][0] for n in names} == {v} for r in got.collect() for i, t, v in rows if (i, t) == (r.doc_id, r.text))


def test_a_common_passage_joins_no_clusters(spark, monkeypatch):
    rng = random.Random(11)
    passage = words(rng, 40, 3000)
    texts = [f"{words(rng, 160, 3000)} {passage}" for _ in range(8)]
    rows = [(100 * g + k, f"{t} copy{k}") for g, t in enumerate(texts) for k in range(6)]
    seen = []
    meet = ngram_join._cluster_links

    def told(members, sets, num, den):
        seen.extend((m.cluster, m.node) for m in members.collect())
        return meet(members, sets, num, den)

    monkeypatch.setattr(ngram_join, "_cluster_links", told)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), heavy=2).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute(rows)
    assert {r.n_links for r in got} == {5}
    many = {}
    for cluster, node in seen:
        many.setdefault(cluster, set()).add(node)
    assert sorted(map(len, many.values())) == [6] * 8
