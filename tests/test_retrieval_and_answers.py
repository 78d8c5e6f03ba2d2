import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loam.operators.containment import contains_join
from loam.operators import answer, embed, retrieval
from loam.plans import catalogue, rag


def plain_score(query, text):
    return sum(w in text.lower() for w in query.lower().split(" "))


def test_keyword_scores(spark):
    texts = ["Alpha beta", "", None, "ALPHABET a  b", "beta beta", "xx", "alphabeta"]
    asked = ["alpha beta", "beta  beta?", "", "zzz", "b a b"]
    c = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = [(r.query, r.chunk, r.score, r["rank"]) for r in retrieval.keyword_top(c, q, 3).collect()]
    want = []
    for i, a in enumerate(asked):
        best = sorted((-plain_score(a, t or ""), j) for j, t in enumerate(texts))[:3]
        want += [(i, j, -s, r + 1) for r, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)
    column = c.crossJoin(q.select("query_id", F.col("text").alias("q"))).select("chunk_id", "query_id", retrieval.keyword_score(F.col("q"), F.coalesce("text", F.lit(""))).alias("s"))
    assert all(r.s == plain_score(asked[r.query_id], texts[r.chunk_id] or "") for r in column.collect())
    assert retrieval.keyword_top(c.where("false"), q, 3).collect() == [] and retrieval.keyword_top(c, q.where("false"), 3).collect() == []


def test_queries_in_blocks(spark, monkeypatch):
    c = spark.range(50).select(F.col("id").alias("chunk_id"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" v"), F.col("id") % 5).alias("text"))
    q = spark.range(9).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), "id", F.lit(" v"), "id").alias("text"))
    whole = sorted(map(tuple, retrieval.keyword_top(c, q, 4).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(retrieval, "GATHERED", 20)
    for kept in (0, 10):
        monkeypatch.setattr(retrieval, "KEPT_BLOCKS", kept)
        assert sorted(map(tuple, retrieval.keyword_top(c, q, 4).collect())) == whole
        plan = retrieval.keyword_top(c, q, 4)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
    assert retrieval.keyword_top(c, q.limit(0), 4).collect() == [] and retrieval.keyword_top(c.limit(0), q, 4).collect() == []


def test_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4 if i % 9 else 3).tolist() if i % 31 else None, "component" if i % 2 else "chunk", f"n{i % 7}") for i in range(200)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string, name string").withColumn("question", F.concat(F.lit("what of n"), F.col("vec_id") % 5))
    ask = lambda: sorted(map(str, retrieval.vector_top(items, items.where("vec_id % 4 = 0"), 6, kind="kind", name="name", question="question").collect()))
    whole = ask()
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 7)
    assert ask() == whole and len(whole) == 50 * 6


def test_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(40, [0.0] * 4), (41, None), (42, [1.0] * 3), (43, []), (44, [float("nan")] * 4)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query, r["rank"], r.item, r.score) for r in retrieval.vector_top(items, items.where("vec_id in (3, 5, 42)"), 50).collect())

    def cos(a, b):
        if a is None or b is None or len(a) != len(b) or not len(a):
            return None
        d = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        s = sum(x * y for x, y in zip(a, b, strict=True))
        return round(s / d, 6) if d and not math.isnan(s) else None

    held = dict(rows)
    want = []
    for q in (3, 5, 42):
        order = sorted(((cos(held[q], v), i) for i, v in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        want += [(q, r + 1, i, s) for r, (s, i) in enumerate(order)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] == w[3] or abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    pair = spark.createDataFrame([([1.0, 0.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    scores = [r[0] for r in pair.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(scores[0] - math.sqrt(0.5)) < 1e-12 and scores[1:] == [None] * 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=30), st.integers(1, 6))
def test_top_is_sort_and_cut(scores, k):
    ids = np.arange(len(scores))[::-1] * 3
    row, col = retrieval._top(np.array([scores]), ids, k)
    assert ids[col].tolist() == [i for _, i in sorted((-s, i) for s, i in zip(scores, ids.tolist(), strict=True))[:k]]


def test_boost_and_evaluation(spark):
    one = spark.createDataFrame([(0.5, "component", "Tree", "the tree"), (0.5, "chunk", "x", "y"), (0.5, "chunk", None, "y")], "s double, k string, n string, q string")
    assert [round(r[0], 6) for r in one.select(retrieval.boosted(F.col("s"), F.col("k"), F.col("n"), F.col("q"))).collect()] == [0.75, 0.5, 0.5]
    top = spark.createDataFrame([("a", 1, 2), ("a", 2, 0), ("b", 1, 1), ("b", 2, 3)], "strategy string, query long, score int")
    acc = retrieval.accuracy(top, ["strategy"])
    assert {r.strategy: (r.correct, r.total, r.accuracy) for r in acc.collect()} == {"a": (1, 2, 50.0), "b": (2, 2, 100.0)}
    assert retrieval.verdict(acc, "a", "b").first().verdict == "b chunking performed better"
    assert retrieval.verdict(acc.where("false"), "a", "b").first().verdict == "Both strategies performed equally"
    assert len(retrieval.QUESTIONS) == 10


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, None), (3, "a b c")], "id long, text string")
    got = {r.id: r.embedding for r in embed.embedded(rows).collect()}
    assert got[1] == got[3] and abs(sum(x * x for x in got[1]) - 1) < 1e-9 and not any(got[2])
    calls = []

    def flaky(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise OSError
        return [[1.0]] * len(texts)

    assert embed.with_retry(flaky, ["x"], wait=0) == [[1.0]] and len(calls) == 3
    with pytest.raises(ValueError):
        embed.with_retry(lambda t: [], ["x"], retries=1, wait=0)
    chunks = spark.createDataFrame([("T", "property", "d", "N[]", None, None, None), ("T", "render", None, None, None, None, "T renders N")], "component string, type string, name string, dataType string, description string, signature string, text string")
    texts = [r.text for r in embed.index(chunks, spark.createDataFrame([("T", "code"), ("U", "")], "component string, code string")).collect()]
    assert texts[0] == 'The T component has a property called "d".\n\nType: N[]\n\nDescription:\nNo description provided.\n\nCode:' and texts[1:] == ["T renders N", "This is the full implementation of the T component.\n\nCode:\ncode"]


def test_hash_embedding_top5(spark):
    """The registered query against a plain loop over all documents."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    vectors = dict(zip(docs, np.array(embed.HashProvider()(list(docs.values()))), strict=True))
    got = {}
    for r in catalogue.QUERIES["hash_embedding_top5"](spark, sf).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    for item in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        q = np.array(embed.HashProvider()([item.text])[0])
        best = sorted((-round(float(q @ v), 6), d) for d, v in vectors.items())[:5]
        held = sorted(got[item.item_id])
        assert [r for r, _, _ in held] == [1, 2, 3, 4, 5]
        assert all(abs(s + b) < 2e-6 for (_, _, s), (b, _) in zip(held, best, strict=True))
        assert {d for _, d, s in held if s > -best[4][0] + 2e-6} <= {d for _, d in best}


def test_paced_calls(spark):
    import time as clock

    rows = spark.createDataFrame([(i, "x") for i in range(6)], "id long, text string").repartition(3)
    began = clock.time()
    assert embed.embedded(rows, lambda t: [[1.0]] * len(t), batch=1, pause=0.05).count() == 6
    assert clock.time() - began > 6 * 0.05


def test_prompts(spark):
    ranked = spark.createDataFrame([(1, 2, "property", "Tree", "data", "N[]", None), (1, 1, "x", "Tree", None, None, "Tree {question} text"), (2, 1, "x", "Button", None, None, "no"), (3, 1, "x", None, None, None, "kept")], "question_id long, rank int, chunk_type string, component string, name string, dataType string, text string")
    asked = spark.createDataFrame([(1, "What is the tree?"), (2, "What is the tree?"), (3, "Create a PAGE"), (4, "nothing")], "question_id long, question string")
    got = {r.question_id: r for r in answer.prompts(ranked, asked).collect()}
    assert got[1].context == "Tree {question} text\nTree.data: N[]" and got[2].context == "" and got[3].context == "kept" and got[4].context == ""
    assert got[3].code and not got[1].code and got[3].prompt == answer.CODE_PROMPT.replace("{context}", "kept").replace("{question}", "Create a PAGE")
    assert got[1].prompt.count("What is the tree?") == 1
    said = answer.answered(answer.prompts(ranked, asked), lambda p: str(len(p))).collect()
    assert all(r.answer == str(len(r.prompt)) for r in said)


def test_from_folder_to_answer(spark, tmp_path):
    for name, text in {"Tree/Tree.tsx": 'import { TreeProps } from "./Tree.types";\nconst Tree: React.FC<TreeProps> = ({ data }) => <ul><Leaf /></ul>;', "Tree/Tree.types.ts": "export interface TreeProps { data: string[] }", "dist/No.tsx": "const No = 1;"}.items():
        path = tmp_path / "components" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    held = rag.build_index(spark, f"file://{tmp_path}/components")
    rows = {(r.item_type, r.chunk_type) for r in held.collect()}
    assert ("component", None) in rows and ("chunk", "property") in rows and ("chunk", "render") in rows
    asked = spark.createDataFrame([(1, "What data does the Tree have?")], "question_id long, question string")
    got = rag.ask(held, asked).first()
    assert "Tree" in got.context and got.question in got.prompt


def counting(path):
    """A provider that leaves a file for each text it gets."""

    def provider(texts):
        import uuid as ids

        for t in texts:
            with open(f"{path}/{ids.uuid4().hex}", "w") as f:
                f.write(t)
        return [[float(len(t)), 1.0] for t in texts]

    return provider


def test_each_text_is_embedded_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    asked = lambda: sorted(p.read_text() for p in (tmp_path / "calls").iterdir())
    provider, at = counting(str(tmp_path / "calls")), f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "digest long, text string")
    got = embed.embedded_once(rows.withColumnRenamed("digest", "id"), at, provider)
    assert sorted((r.id, r.embedding[0]) for r in got.collect()) == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 0.0), (5, 0.0)] and asked() == ["", "a", "b"]
    more = spark.createDataFrame([(1, "a"), (2, "cc")], "id long, text string")
    assert sorted((r.id, r.embedding[0]) for r in embed.embedded_once(more, at, provider).collect()) == [(1, 1.0), (2, 2.0)] and asked() == ["", "a", "b", "cc"]
    assert embed.embedded_once(more, at, provider).count() == 2 and len(asked()) == 4
    assert embed.embedded_once(more.where("id = 1"), at, provider, "other").count() == 1 and len(asked()) == 5
    with pytest.raises(Exception):
        embed.embedded_once(spark.createDataFrame([(1, "new")], "id long, text string"), at, lambda t: [], wait=0).count()
    assert embed.stored(spark, at).count() == 5


def test_search_asks_for_each_text_once(spark, tmp_path):
    items = spark.createDataFrame([(i, f"c{i}", None, "chunk", None, None, f"text {i}") for i in range(10)], "item_id long, component string, name string, item_type string, chunk_type string, dataType string, text string")
    index = embed.embedded(items, counting(str(tmp_path)))
    questions = spark.createDataFrame([(1, "what is c3?")], "question_id long, question string")
    assert rag.ask(index, questions, counting(str(tmp_path))).count() == 1
    assert len(list(tmp_path.iterdir())) == 11


def test_names_in_texts(spark):
    texts = [(1, "The TreeNode of a Tree"), (2, "a b"), (3, None), (4, ""), (5, "undefined İstanbul ab"), (1, "tree"), (6, "x" * 50_000 + "needle" + "y" * 50_000)]
    names = ["Tree", "TreeNode", "a", "AB", "", None, "zzz", "needle", "tree", "ode of a t", "İstanbul"]
    left, right = spark.createDataFrame(texts, "id long, question string"), spark.createDataFrame([(i, n) for i, n in enumerate(names)], "k long, name string")
    got = contains_join(left, right)
    want = sorted((i, k) for i, t in texts if t is not None for k, n in enumerate(names) if (n or ("" if n == "" else "undefined")).lower() in t.lower())
    assert sorted((r.id, r.k) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert contains_join(left, right.limit(0)).collect() == [] and contains_join(left.limit(0), right).collect() == []
    assert contains_join(left, right).columns == ["id", "question", "k", "name"]
