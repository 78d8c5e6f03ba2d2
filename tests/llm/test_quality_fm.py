import zlib

import numpy as np
import pyarrow as pa

from loam.llm import quality_fm as fm, sample
from tests.llm.tables import empty_docs, odd_docs

SF = "/root/testdata/sf0.01"


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    m = fm.Machine(0.3, rng.normal(size=fm.FEATURES), rng.normal(size=(fm.FEATURES, fm.RANK)))
    ids, x, bounds = fm.features(pa.array(["a b c a", "", "Zürich!! ###"]), np.array([7, 0, 12]))
    got = m.raw(ids, x.astype(np.float64), bounds)[0]
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        want = m.w0 + sum(m.w[ids[p]] * x[p] for p in range(a, b))
        want += sum(m.v[ids[p]] @ m.v[ids[q]] * x[p] * x[q] for p in range(a, b) for q in range(p + 1, b))
        assert abs(got[i] - want) < 1e-6


def test_held_out_accuracy(spark):
    rows = fm.op1_quality_fm(spark, SF).collect()
    told = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(told[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in told]
    assert np.mean([a == b for a, b in held]) > 0.97 and {a for a, _ in held} == {0, 1}


def test_labels_of_held_out_rows_and_names_play_no_part(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(fm.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fm.train(docs, labels), fm.train(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), turned)
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()


def test_odd_rows(spark):
    docs = odd_docs(spark)
    m = fm.train(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 1, 0), (7, 0, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    rows = fm.score(docs, m).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (9,)}) == 1
    kept = fm.keep_good(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert fm.score(empty_docs(spark), m).collect() == []
    none = fm.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 2) for r in fm.score(docs, none).collect()} == {0.5}


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(i % 20, f"text {i % 900} " * (1 + i % 7), 1) for i in range(20_000)]  # a thousand rows a key, some equal
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(0, 0)], "doc_id long, quality int")
    keys = sample.labelled_keys(labels, 3)
    got = sample.labelled_texts(docs, keys).collect()
    assert len(got) == keys.count() == 3 and len({r["_id"] for r in got}) == 3
    again = sample.labelled_texts(docs.repartition(7), keys).collect()
    assert sorted(got) == sorted(again)
    small = sample.labelled_texts(docs, keys, 60).collect()
    assert sum(len(r.text.encode()) for r in small) <= 60 and len(small) < 3
    assert sample.labelled_texts(empty_docs(spark), keys).collect() == []
    assert fm.train(docs, labels, 3).w0 == fm.train(docs.repartition(7), labels, 3).w0
