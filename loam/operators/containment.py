"""Join by containment: which names stand in which texts, with both sides large and no nested loop."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loam.functions.js import text as shown
from loam.functions.spread import spread
from loam.sources.stores import kept

#: Letters of a gram; a shorter name is one gram by itself.
GRAM = 3


def grams(value: str, sizes: tuple[int, ...]) -> set[str]:
    """Every piece of these lengths; "" for a length of 0."""
    return {value[i : i + n] for n in sizes for i in range(len(value) - n + 1 if n else 1)}


def _grams(rows: DataFrame, sizes: tuple[int, ...] | None) -> DataFrame:
    """id, gram of each row of (id, low): the distinct pieces of its text; with sizes None, those that a name is found by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for key, value in zip(batch.column("id").to_pylist(), batch.column("low").to_pylist(), strict=True):
                held = grams(value, sizes or (min(GRAM, len(value)),))
                ids += [key] * len(held)
                out += held
                if len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "gram"])
                    ids, out = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "gram"])

    return spread(rows.select("id", "low")).mapInArrow(run, "id long, gram string")


def contains_join(texts: DataFrame, names: DataFrame, text: str = "question", name: str = "name") -> DataFrame:
    """The columns of texts and of names for each pair of a text and a name that stands in it, whatever the case.

    A name is looked for by its rarest gram alone: how often grams stand in the texts is counted first, names with a gram
    that no text has are gone, and texts meet names by equal grams; pairs that meet are then compared whole. A null text
    holds nothing; a null name counts as `undefined`; an empty name stands in every text. Repeated rows each count;
    columns of one name on both sides stay two, as in any join.
    """
    left = kept(texts.withColumn("_id", F.monotonically_increasing_id()).where(F.col(text).isNotNull()), "texts")
    right = kept(names.withColumn("_key", F.monotonically_increasing_id()), "names")
    low = F.lower(shown(F.col(name)))
    sought = kept(_grams(right.select(F.col("_key").alias("id"), low.alias("low")), None), "grams")
    # At most the lengths 0 to GRAM.
    sizes = tuple(r[0] for r in sought.select(F.length("gram")).distinct().collect())
    if not sizes:
        return left.drop("_id").crossJoin(right.drop("_key").limit(0))
    there = _grams(left.select(F.col("_id").alias("id"), F.lower(text).alias("low")), sizes).withColumnRenamed("id", "_id")
    there = kept(there.join(sought.select("gram").distinct(), "gram", "left_semi"), "there")
    many = there.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rated = sought.join(many, "gram", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = rated.where("r.n > 0").select(F.col("id").alias("_key"), "r.gram")
    pairs = there.join(rarest, "gram").select("_id", "_key")
    met = left.join(pairs, "_id").join(right.withColumn("_low", low), "_key")
    return met.where(F.contains(F.lower(left[text]), F.col("_low"))).drop("_id", "_key", "_low")
