import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loam.llm.merkle import _levels, fold, leaf, manifest, op11_merkle_manifest, traverse
from tests.llm.tables import empty_docs, odd_docs


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """All levels of a ternary ragged tree."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at - at % 3
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        at //= 3
    return out


@pytest.mark.parametrize("height", [1, 2, 3])
def test_traversal_equals_the_whole_tree(height):
    for n in [*range(1, 40), 80, 81, 82, 242, 243]:
        leaves = [h(str(k)) for k in range(n)]
        whole = tree(leaves)
        assert list(traverse(leaves, _levels(n, 9), height)) == [path(whole, k) for k in range(n)], n


def test_traversal_keeps_two_subtrees_for_each_stratum():
    leaves, most = [h(str(k)) for k in range(729)], 0
    walk = traverse(leaves, 6, 2)
    for _ in walk:
        for now, coming, _ in walk.gi_frame.f_locals["held"]:
            most = max(most, *(sum(map(len, s.nodes)) + sum(map(len, s.stack)) for s in (now, coming)))
    assert most <= 3 + 9 + 2 * 6  # of 1092 nodes below the root


def said(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id, said(r.doc_id, r.source, r.lang, r.n_chars, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in names]
    top = tree([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, (s, t) in enumerate(zip(names, trees, strict=True)):
        for at, (_, _, node, r) in enumerate(sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))):
            proof = path(t, at) + path(top, k)
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = said(r.doc_id, r.source, r.lang, r.n_chars, text)
            for left, right in proof:
                folded = h(left + folded + right)
            out.append((r.doc_id, node, t[-1][0], top[-1][0], h("".join(a + b for a, b in proof)), folded, folded == top[-1][0]))
    return out


def table_of(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet").collect()


key = lambda r: tuple((x is not None, x) for x in r)


def mixed(spark):
    more = [(i, f"text {i % 7}\nline") for i in range(100, 420)]
    docs = odd_docs(spark, more)
    pick = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(9))
    return docs.withColumn("source", F.when(pick < 5, "hot").when(pick == 5, "").when(pick == 6, "é").when(pick == 7, "Z").otherwise(F.lit(None)))


def test_query_against_brute_force(spark, tmp_path):
    rows = table_of(spark, tmp_path, mixed(spark))
    got = sorted((tuple(r) for r in op11_merkle_manifest(spark, str(tmp_path)).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert got == want and {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_small_blocks_give_the_same_tree_in_more_rounds(spark, levels):
    docs = mixed(spark)
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    got = manifest(docs, F.col("source"), F.col("doc_id"), leaf(*own), levels=levels).withColumn("folded", fold(F.col("leaf"), F.col("proof"))).collect()
    want = brute(docs.collect())
    assert sorted((r.leaf, r.subroot, r.root) for r in got) == sorted(w[1:4] for w in want)
    assert all(r.folded == r.root for r in got)
    assert sorted(h("".join(p.left + p.right for p in r.proof)) for r in got) == sorted(w[4] for w in want)
    places = {}
    for r in got:
        places.setdefault(r.subroot, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_empty_and_single(spark, tmp_path):
    empty_docs(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert op11_merkle_manifest(spark, f"{tmp_path}/a").collect() == []
    odd_docs(spark).where("doc_id = 1").write.parquet(f"{tmp_path}/b/documents.parquet")
    (r,) = op11_merkle_manifest(spark, f"{tmp_path}/b").collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h("") and r.verified
