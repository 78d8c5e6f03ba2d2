"""Token files: ids of all documents in key order, in blocks of a static range asymmetric numeral system.

A set of files is a folder with `blocks` (a row holds whole documents: their keys and lengths, the ids before the
block, the coded block) and `frequencies` (the one table that all blocks share). Both are Parquet containers, so any
store that Spark reaches will do and a task that is run again leaves nothing twice; `part` and `block` give the order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loam.llm.bytebpe import ByteEncoder
from loam.llm.common import bounded_batches, drop_table, held_folder, materialize, table, text_blocks, tokenizer_path
from loam.llm.rans import Coder, scale_frequencies

#: Ids of a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 19
#: Partitions whose counts are summed in one task at once.
TALLY = 64

RAW = "part int, block int, before long, doc_ids array<long>, lengths array<long>, ids binary, counts array<long>"
CODED = "part int, block int, start long, doc_ids array<long>, lengths array<long>, payload binary"


def _raw_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int) -> DataFrame:
    """Blocks of plain ids in key order, and for each partition a last row with how often each id occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, block, before, n = None, 0, 0, 0
        keys, lengths, parts = [], [], []
        end = np.array([end_id], np.uint32)
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("counts", pa.list_(pa.int64()))])
        counts = None

        def row(ids: bytes | None, tally: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, block, before, keys, lengths, ids, tally), schema, strict=True)], schema=schema)

        for cut in text_blocks(batches):
            if encoder is None:
                encoder = ByteEncoder(tokenizer)
                counts = np.zeros(max(encoder.size, end_id + 1), np.int64)
            for key, text in zip(cut.column("doc_id").to_pylist(), cut.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text or "")
                size = len(ids) + 1
                if n and n + size > block_ids:
                    flat = np.concatenate(parts)
                    counts += np.bincount(flat, minlength=len(counts))
                    yield row(flat.astype("<u2" if len(counts) <= 65536 else "<u4").tobytes(), None)
                    block, before, n, keys, lengths, parts = block + 1, before + n, 0, [], [], []
                keys.append(key)
                lengths.append(size)
                parts += [ids, end]
                n += size
        if n:
            flat = np.concatenate(parts)
            counts += np.bincount(flat, minlength=len(counts))
            yield row(flat.astype("<u2" if len(counts) <= 65536 else "<u4").tobytes(), None)
            block, before, keys, lengths = block + 1, before + n, [], []
            yield row(None, counts.tolist())

    # Rows of one key are told apart by their text, so a key with many rows can be dealt to several partitions.
    apart = F.xxhash64("text")
    return docs.repartitionByRange(F.col("doc_id"), apart).sortWithinPartitions("doc_id", apart).mapInArrow(run, RAW)


def _tally(raw: DataFrame) -> np.ndarray:
    """How often each id occurs: the partitions' counts are summed TALLY at a time, then id by id."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.asarray(c.values) for c in t.column("counts")) if t.num_rows else np.zeros(0, np.int64)
        return pa.table([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["counts"])

    each = raw.where("counts is not null").select("part", "counts")
    groups = max(1, -(-each.count() // TALLY))
    sums = each.groupBy(F.pmod("part", F.lit(groups)).alias("group")).applyInArrow(add, "counts array<long>")
    total = sums.select(F.posexplode("counts").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    return total.toPandas().sort_values("id")["n"].to_numpy(np.int64)  # a row for each id of the vocabulary


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = BLOCK_IDS, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text, adds the end id, and writes all ids in ascending key order.

    A null text counts as an empty one: its end id alone. Rows with equal keys stand in the order of a hash of their
    texts, null keys come first; an empty table gives files without blocks. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    raw = materialize(_raw_blocks(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), tokenizer, end_id, block_ids), "ids")
    counts = _tally(raw)
    freq = scale_frequencies(counts)
    wide = len(freq) > 65536
    spark.createDataFrame(pa.table({"id": pa.array(range(len(freq)), pa.int32()), "freq": pa.array(freq, pa.int64())})).coalesce(1).write.parquet(f"{path}/frequencies")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for i in range(batch.num_rows):
                coder = coder or Coder(freq)
                one = batch.slice(i, 1)
                ids = np.frombuffer(one.column("ids")[0].as_py(), "<u4" if wide else "<u2")
                yield pa.RecordBatch.from_arrays([one.column(c) for c in ("part", "block", "start", "doc_ids", "lengths")] + [pa.array([coder.encode(ids)], pa.binary())], names=["part", "block", "start", "doc_ids", "lengths", "payload"])

    # One row for each partition of the raw ids: where it starts.
    totals = raw.where("counts is not null").select(F.col("part").alias("_part"), "before")
    starts = totals.select("_part", F.coalesce(F.sum("before").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    blocks = raw.where("counts is null").join(F.broadcast(starts), F.col("part") == F.col("_part"))
    blocks = blocks.select("part", "block", (F.col("before") + F.col("_first")).alias("start"), "doc_ids", "lengths", "ids")
    blocks.mapInArrow(code, CODED).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_table(raw)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with `with_ids`, ids of every document.

    Blocks are decoded by themselves and checked against their checksums; ids_crc32 is over the ids as little-endian
    unsigned 32-bit integers.
    """
    bounded_batches(spark)
    rows = spark.read.parquet(f"{path}/frequencies").orderBy("id").toPandas()  # a row for each id of the vocabulary
    freq = rows["freq"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for i in range(batch.num_rows):
                coder = coder or Coder(freq)
                one = batch.slice(i, 1).to_pylist()[0]
                ids = coder.decode(one["payload"]).astype("<u4")
                lengths = np.array(one["lengths"], np.int64)
                ends = np.cumsum(lengths)
                own = np.split(ids, ends[:-1])
                cols = [pa.array(one["doc_ids"], pa.int64()), pa.array(ends - lengths + one["start"]), pa.array(lengths), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.read.schema(CODED).parquet(f"{path}/blocks").select("start", "doc_ids", "lengths", "payload").mapInArrow(run, schema)


def op5_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = held_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(spark, path, with_ids=False)
