"""Interaction of filters: every order of them is replayed over all documents' flags, as plain relational work."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loam.llm.common import join_keyed, materialize, table

WORD = r"[^\x20\x09-\x0D]+"

#: The counts of a row, in the order of the result's columns.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure condition of each filter that looks at one text alone; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def repeats(rows: DataFrame, digest: str = "digest", key: str = "doc_id") -> DataFrame:
    """rows with `repeat`: whether a row of a smaller key has the same digest.

    Rows meet by digest only where a digest has several rows; digests with many rows are dealt to pieces. A null key is
    neither smaller nor larger than another, so rows without a key repeat nothing and are repeated by nobody.
    """
    several = rows.groupBy(digest).agg(F.min(key).alias("_least"), F.count(F.lit(1)).alias("_many")).where("_many > 1")
    return join_keyed(rows, materialize(several, "repeats"), [digest], "_many", F.col(key)).withColumn("repeat", F.coalesce(F.col(key) > F.col("_least"), F.lit(False))).drop("_least", "_many")


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, a to e: a row for each document, which is written once (some 20 bytes a row).

    `labels` may have several rows of a document: it is good, or toxic, if one of them says so. Documents without a key
    have no label. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        *(c.alias(name.lower()) for name, c in text_failures(F.col("text")).items()),
    )
    # Rows without a key find no label anyway; the salt deals them to all tasks.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    rows = repeats(materialize(own.withColumn("_salt", salt), "flags")).withColumnRenamed("repeat", "e")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("_salt")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    held = rows.join(said, ["doc_id", "_salt"], "left")
    return held.select("part", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), "a", "b", "c", "d", "e")


def orders(spark: SparkSession, filters: str = "ABCDE") -> DataFrame:
    """A row for each permutation of the filters: filter_order, the place of each filter in it (a column named by the
    filter's letter), and `bits`, the bit of the filter at each step."""
    rows = [("".join(p), [1 << filters.index(f) for f in p], *(p.index(f) + 1 for f in filters)) for p in permutations(filters)]
    return spark.createDataFrame(rows, ", ".join(["filter_order string", "bits array<int>", *(f"place_{f} int" for f in filters)]))


def audit(held: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    held: part, good, toxic and a boolean column for each filter (its letter in lower case): true if a row fails it. Each
    row meets each order (n! rows, broadcast: 120 for five filters), the first failing place is computed, and a row for
    each step goes straight into the partial aggregate of its task: a task sends one row for each part, order and step at
    most. Null flags count as passed. Every part has a row for each order and step; an empty table gives no part.
    """
    n = len(filters)
    fails = [F.coalesce(F.col(f.lower()), F.lit(False)) for f in filters]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    own = held.select("part", "good", "toxic", mask.alias("mask"))
    first = F.least(*(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col(f"place_{f}")).otherwise(n + 1) for k, f in enumerate(filters)))
    met = own.crossJoin(F.broadcast(orders(held.sparkSession, filters))).select("part", "good", "toxic", "mask", "filter_order", first.alias("first"), "bits")
    steps = met.select("part", "good", "toxic", "mask", "filter_order", "first", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    failing, removed = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("first") == F.col("step")
    told = {
        "kept": F.col("first") > F.col("step"), "removed": removed, "redundant": failing & (F.col("first") < F.col("step")),
        "unique_fails": F.col("mask") == F.col("bit"), "good_lost": removed & F.col("good"), "toxic_lost": removed & F.col("toxic"),
    }
    counts = steps.groupBy("part", "filter_order", "step").agg(*(F.count_if(told[c]).alias(c) for c in COUNTS))
    each = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(each)).select("part", "filter_order", "step", *COUNTS, "shapley")


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over whole texts, for each language.

    Null and empty texts fail A, and E if one of a smaller doc_id stands before them; of repeated rows of one doc_id none
    repeats the other; documents without a doc_id count, without a label; a null language is the part "".
    """
    return audit(flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
