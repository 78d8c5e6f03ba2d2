import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from loam.llm import line_crf as crf
from loam.llm.sample import held_out
from tests.llm.tables import empty_docs, odd_docs

SF = "/root/testdata/sf0.01"


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + d for i in range(len(w) - 2) if c[(w[i], w[i + 1], w[i + 2])] > 1 for d in (0, 1, 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_counts_and_odd_rows(spark):
    rng = random.Random(2)
    more = [(100 + i, "".join(rng.choice(["ab", "ab ", "c", " ", "\n", "é", "#", "|", "\t", "x\n", "\x0b"]) for _ in range(rng.randrange(300)))) for i in range(300)]
    docs = odd_docs(spark, more)
    chain = crf.train(docs, spark.createDataFrame([(1, 1), (9, 0), (8, 0)], "doc_id long, quality int"))
    rows = crf.judge(docs, chain, with_lines=True).collect()
    texts = Counter((str(r.doc_id), base(r.text), len((r.text or "").split("\n"))) for r in docs.collect())
    assert Counter((str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), len(r.lines)) for r in rows) == texts
    assert not any(r.kept and r.base_failed for r in rows)
    kept = crf.keep_content(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert crf.judge(empty_docs(spark), chain).collect() == []


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(3)
    chain = crf.Chain(rng.normal(size=(crf.FEATURES, 2)), rng.normal(size=(2, 2)) * 2)
    lines = crf.lines_of(pa.array(["a\nB!!\n###\n\nc | d", "", "one line", "x\n" * 6, None]))
    e = chain.emissions(lines)
    got = chain.decode(lines)
    for a, b in zip(lines.bounds[:-1], lines.bounds[1:], strict=True):
        value = lambda s: sum(e[a + i, x] for i, x in enumerate(s)) + sum(chain.steps[x, y] for x, y in zip(s, s[1:], strict=False))  # noqa: B023, E731
        assert value(tuple(got[a:b])) >= max(map(value, itertools.product((0, 1), repeat=b - a))) - 1e-9


def test_held_out_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = crf.op6_crf_line_rules(spark, SF).join(labels, "doc_id").where(held_out()).collect()
    assert len(rows) > 50 and docs.count() == crf.op6_crf_line_rules(spark, SF).count()
    right = [r.kept == bool(r.quality) for r in rows if not r.base_failed]
    assert np.mean(right) > 0.97


def test_mixed_texts(spark):
    """Held-out texts of both qualities, spliced: lines are labelled by their own text, and the share tells how much."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = crf.train(docs, labels)
    held = docs.join(labels, "doc_id").where(held_out()).where("length(text) > 400").orderBy("doc_id").select("text", "quality").collect()
    good, bad = ([r.text for r in held if r.quality == q] for q in (1, 0))
    right, mixed, n = 0, 0, 0
    for k, (g, b) in enumerate(zip(good, bad, strict=False)):
        first, second = (g, b) if k % 2 else (b, g)
        want = [k % 2 == 0] * (first.count("\n") + 1) + [k % 2 == 1] * (second.count("\n") + 1)
        got = chain.decode(crf.lines_of(pa.array([f"{first}\n{second}"])))
        right += sum(bool(x) == y for x, y in zip(got, want, strict=True))
        n += len(want)
        mixed += len(set(got.tolist())) == 2
    pairs = min(len(good), len(bad))
    print("line accuracy", right / n, "mixed", mixed, "of", pairs)
    assert pairs > 10 and right / n > 0.95 and mixed >= 0.9 * pairs
