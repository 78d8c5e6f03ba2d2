import re
from collections import Counter
from itertools import permutations

from loam.llm.filter_audit import audit, flags, op12_filter_interaction_audit
from tests.llm.tables import empty_docs, odd_docs, words

LABELS = "doc_id long, quality int, toxic int, digest string, part string"


def labels(spark):
    rows = [(i, i % 2, i % 3 == 0, "x", "y") for i in range(0, 400)] + [(9, 1, 1, None, None), (None, 1, 1, None, None), (3, None, None, None, None)]
    return spark.createDataFrame([(a, b, None if c is None else int(c), d, e) for a, b, c, d, e in rows], LABELS)


def documents(spark):
    import random

    rng = random.Random(2)
    more = []
    for i in range(100, 330):
        text = words(rng, rng.choice([5, 150, 220]), rng.choice([20, 5000]))
        text = text.upper() if i % 5 == 0 else text
        text += rng.choice(["", " #", " | ", ""])
        more.append((i, text if i % 11 else "the same text in many rows"))
    docs = odd_docs(spark, more)
    from pyspark.sql import functions as F

    pick = F.pmod(F.coalesce("doc_id", F.lit(1)), F.lit(4))
    return docs.withColumn("lang", F.when(pick == 0, "en").when(pick == 1, "").when(pick == 2, F.lit(None).cast("string")).otherwise("de"))


def failing(rows):
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    out = []
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else "") + ("D" if re.search(r"[#$%&*|]", t) else "")
        out.append(fails + ("E" if r.doc_id is not None and r.doc_id > least[t] else ""))
    return out


def brute(rows, said):
    good = {s.doc_id for s in said if s.quality == 1} - {None}
    toxic = {s.doc_id for s in said if s.toxic == 1} - {None}
    out, shapley = {}, Counter()
    for r, fails in zip(rows, failing(rows), strict=True):
        part = r.lang or ""
        for order in map("".join, permutations("ABCDE")):
            gone = 0
            for step, f in enumerate(order, 1):
                x = out.setdefault((part, order, step), [0] * 6)
                now = not gone and f in fails
                x[2] += bool(gone) and f in fails
                gone = gone or (step if now else 0)
                x[0] += not gone
                x[1] += now
                x[3] += fails == f
                x[4] += now and r.doc_id in good
                x[5] += now and r.doc_id in toxic
                shapley[part, f] += now
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_against_replay(spark):
    docs, said = documents(spark), labels(spark)
    got = audit(flags(docs, said))
    want = brute(docs.collect(), said.collect())
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 3 * 600
    assert {f for fs in failing(docs.collect()) for f in fs} == set("ABCDE")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "partial_count" in plan


def test_null_flags_pass_and_other_numbers_of_filters(spark):
    held = spark.createDataFrame([("p", True, False, None, True, 5)], "part string, good boolean, toxic boolean, x boolean, y boolean, step int")
    rows = sorted(tuple(r) for r in audit(held, "XY").collect())
    assert rows == [("p", "XY", 1, 1, 0, 0, 0, 0, 0, 0), ("p", "XY", 2, 0, 1, 0, 1, 1, 0, 2), ("p", "YX", 1, 0, 1, 0, 1, 1, 0, 2), ("p", "YX", 2, 0, 0, 0, 0, 0, 0, 0)]


def test_empty(spark, tmp_path):
    empty_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert op12_filter_interaction_audit(spark, str(tmp_path)).collect() == []
