"""Labelled texts for a fit, bounded in rows and in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of all labelled texts that a fit takes at most.
SAMPLE_BYTES = 32 << 20


def held_out(key: str = "doc_id") -> Column:
    """Rows that no fit may learn from: crc32 of the key as text leaves 1 when divided by 3. Null keys are not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_keys(labels: DataFrame, rows: int, each: bool = False) -> DataFrame:
    """_id, label of at most `rows` keys with a label that are not held out, those with the least hash; the highest label
    of a key counts. With `each`, half of them have label 1 and half label 0 at most."""
    told = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("label"))
    first = lambda df, n: df.orderBy(F.xxhash64("_id"), "_id").limit(n)
    return first(told.where("label = 1"), rows // 2).unionByName(first(told.where("label = 0"), rows // 2)) if each else first(told, rows)


def labelled_texts(docs: DataFrame, keys: DataFrame, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """_id, label, text, n_chars: one row of `docs` for each key of `keys`, whose number is bounded, with no more than
    `most_bytes` bytes of text together.

    Of several rows of a key, the one whose text and n_chars have the least hash is taken. Keys are taken by hash; one
    whose text no longer fits is passed over.
    """
    spark = docs.sparkSession
    given = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text"), F.coalesce(given, F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    rows = rows.withColumn("_mark", F.xxhash64("text", "n_chars"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    # A broadcast of as many rows as `keys` may have, 12 bytes each; as many come back.
    found = rows.join(F.broadcast(keys), "_id").groupBy("_id", "label").agg(F.min(F.struct("_mark", size.alias("size"))).alias("m"))
    told = found.select("_id", "label", "m._mark", "m.size", F.xxhash64("_id").alias("order")).toPandas().sort_values(["order", "_id"])
    taken, left = [], most_bytes
    for key, label, mark, n in zip(told["_id"], told["label"], told["_mark"], told["size"], strict=True):
        if n <= left:
            taken.append((int(key), int(label), int(mark)))
            left -= int(n)
    kept = spark.createDataFrame(taken, "_id long, label int, _mark long")
    # Equal rows of a key have one mark; each task passes on one of them.
    return rows.join(F.broadcast(kept), ["_id", "_mark"]).groupBy("_id", "label", "_mark").agg(F.first("text").alias("text"), F.first("n_chars").alias("n_chars")).drop("_mark")
