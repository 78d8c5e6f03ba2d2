"""Jump consistent hashing: stable keys to shards without a ring table (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loam.llm.common import materialize, table, with_slots

#: Fixed values of the published generator: its multiplier, 2^64, 2^33 and 2^31.
MULTIPLIER, WORD, HIGH, RANGE = "2862933555777941757", "18446744073709551616", "8589934592", "2147483648"


def jump_shards(key: str, shards: int) -> Column:
    """struct<b, g>: the shard of a 64-bit key among `shards`, and among `shards + 1`.

    One walk gives both: the jumps of a key are the same for every shard count, and the shard is the last jump
    below it. The walk ends at the first jump past the end; there are about ln(shards) + 1 of them and `shards + 1`
    at most, hence the bound of the fold. A null key counts as 0; negative keys are read as unsigned.
    """
    start = f"cast(coalesce({key}, 0L) as decimal(20,0)) + if(coalesce({key}, 0L) < 0, {WORD}BD, 0BD)"
    step = (
        f"transform(array(cast((cast(s.k as decimal(20,0)) * {MULTIPLIER}BD + 1BD) % {WORD}BD as decimal(20,0))), "
        f"k -> named_struct('k', k, 'b', if(s.j < {shards}L, s.j, s.b), 'g', s.j, "
        f"'j', cast(floor(cast(s.j + 1L as double) * ({RANGE}D / cast(k div {HIGH}BD + 1L as double))) as bigint)))[0]"
    )
    return F.expr(
        f"aggregate(sequence(0, {shards}), named_struct('k', cast({start} as decimal(20,0)), 'b', 0L, 'g', 0L, 'j', 0L), "
        f"(s, i) -> if(s.j <= {shards}L, {step}, s), s -> named_struct('b', cast(s.b as int), 'g', cast(s.g as int)))"
    )


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is `key`: the key and the number of shards alone decide, and one more shard takes rows only into
    itself; equal texts of different keys are not kept together. Slots number the rows of a shard from 0 without gaps. Null texts have size 16 and the crc32 of an empty
    text; a null key counts as key 0; repeated rows each take a slot; an empty table gives an empty result; other
    columns are not carried along, whatever their names.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("_at", jump_shards("doc_id", shards)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_at.b").alias("shard"), F.col("_at.g").alias("grown_shard"))
    # Written once (some 40 bytes a row): counts and numbers both read it, and the walk is taken once a row.
    rows = materialize(rows, "shards")
    out = with_slots(rows, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], rows=rows.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
