import numpy as np
import pytest

import loam.llm.knn as knn


def brute(rows, k):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            held.setdefault(i, []).append(np.floor(256 * np.array(v, np.float64)))
    out = []
    for q, qs in held.items():
        if q % 50 == 0:
            dot = lambda a, b: min(max(sum(int(x) * int(y) for x, y in zip(a, b, strict=False)), -(2**63)), 2**63 - 1)
            best = sorted((-max(dot(a, b) for a in qs for b in vs), i) for i, vs in held.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("per", [(2000, 4096, 8192), (20, 16, 3)])
def test_against_all_pairs(spark, monkeypatch, per):
    for name, value in zip(("PER_PIVOT", "BLOCK", "QUERIES"), per, strict=True):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)] + [(i, [0.5] * 8) for i in range(700, 1000)]
    rows += [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (1200, [3.0] * 5), (1250, []), (50, rng.normal(size=8).tolist()), (700, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, vec string")
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = knn.knn_join(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted(tuple(r) for r in got) == brute(f32, 5)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.knn_join(df, df.where("vec_id % 50 = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    none = df.where("vec_id > 9")
    assert knn.knn_join(none, none).collect() == [] and knn.knn_join(df, none).collect() == []


def test_far_groups_are_not_replicated(spark, monkeypatch):
    """Tight clusters far apart: most pairs of groups are ruled out, and the result is that of all pairs."""
    monkeypatch.setattr(knn, "PER_PIVOT", 20)
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(16)[i % 16] * 40 + rng.normal(size=16) * 0.1).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.knn_join(df, df.where("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)
    pairs, met = got.group_pairs
    assert met < 0.5 * pairs


@pytest.mark.parametrize("size", [1e6, 1e10, 3e38])
def test_large_components_are_exact_and_beyond_a_long_count_as_its_ends(spark, monkeypatch, size):
    monkeypatch.setattr(knn, "PER_PIVOT", 20)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) * (size if i % 3 else 1)).tolist()) for i in range(300)]
    rows += [(300 + i, [size, -size, 1.0, float(i), 0.5, 0.25]) for i in range(40)] + [(350, [-size] * 6), (400, [1e308] * 6), (401, [size * 1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.knn_join(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted(tuple(r) for r in got) == brute([r for r in rows if r[0] != 400], 5)


def test_scores_are_exact():
    rng = np.random.default_rng(4)
    q, x = np.floor(rng.normal(size=(7, 9)) * 1e9), np.floor(rng.normal(size=(11, 9)) * 10.0 ** rng.integers(0, 30, (11, 1)))
    want = [[min(max(sum(int(a) * int(b) for a, b in zip(u, v, strict=True)), -(2**63)), 2**63 - 1) for v in x] for u in q]
    assert knn._scores(q, x).tolist() == want
