"""What the operators of this subpackage share: tables, shared storage, batches of text, gapless slots, components."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Folder of the public tokenizer files; only a default, every operator takes the path as a parameter.
TOKENIZER_DIR = os.environ.get("LOAM_TOKENIZERS", "/opt/tokenizers")

#: Text bytes that a Python worker takes apart at once.
BLOCK_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    return os.path.join(TOKENIZER_DIR, name)


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, as the session or its context has it.

    Where it is unset, a local session, as in tests, gets a folder of this machine; any other fails, since each executor
    would write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/loam"
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Tables of materialize() that nobody has removed yet, by application.
_TABLES: dict[str, list[str]] = {}


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the lineage ends there, and it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loam_path = path
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


def held_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder for files that a result reads; remove_tables() removes it."""
    path = f"{shared_dir(spark)}/loam-{tag}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over now; else they stay until the driver happens to collect
    its garbage, which is what tells Spark that nothing refers to them."""
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_table(df: DataFrame) -> None:
    """Removes a table of materialize(); plans that still read it fail from then on."""
    if path := getattr(df, "_loam_path", None):
        _delete(df.sparkSession, path)
        if path in (held := _TABLES.get(df.sparkSession.sparkContext.applicationId, [])):
            held.remove(path)


def remove_tables(spark: SparkSession) -> int:
    """Removes every intermediate table that this application's operators have left in the shared folder; their number.

    The result of an operator is lazy and may read some, so they can only go when the caller has written the result.
    """
    held = _TABLES.pop(spark.sparkContext.applicationId, [])
    for path in held:
        _delete(spark, path)
    return len(held)


# ---------------------------------------------------------------- batches of text

#: Bytes of an Arrow batch between the JVM and a Python worker; Spark's own default is 64 MiB for each side and task.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES, so that long texts don't add up; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of about `limit` text bytes (a longer text makes a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        texts = batch.column(at)
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


# ---------------------------------------------------------------- joins with hot keys

#: Rows of a key from which it counts as hot, and the pieces that it is cut into.
HOT_ROWS, HOT_PIECES = 200, 64


def join_keyed(rows: DataFrame, keyed: DataFrame, keys: list[str], many: str, apart: Column) -> DataFrame:
    """rows left-joined with a table of one row a key that says in `many` how many rows the key has.

    A hot key's rows are dealt to HOT_PIECES pieces by a hash of `apart`, and its row in `keyed` is repeated for each of
    them, which is a third of the rows at most; the others join as they are. So no key meets in one task.
    """
    hot = keyed.where(F.col(many) > HOT_ROWS)
    if not hot.limit(1).count():
        return rows.join(keyed, keys, "left")
    hot = hot.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(HOT_PIECES - 1))))
    dealt = rows.withColumn("_piece", F.pmod(F.xxhash64(apart), F.lit(HOT_PIECES)).cast("int")).join(hot, [*keys, "_piece"], "left").drop("_piece")
    rest = dealt.where(F.col(many).isNull()).select(*rows.columns).join(keyed.where(F.col(many) <= HOT_ROWS), keys, "left")
    return dealt.where(F.col(many).isNotNull()).unionByName(rest)


# ---------------------------------------------------------------- gapless slots

#: Sub-groups that each group is cut into for numbering, at least, and rows of one, about, if one group holds them all.
SLOT_PARTS, SLOT_ROWS = 64, 500_000


def with_slots(df: DataFrame, group: str, order: list[Column], out: str = "slot", rows: int = 0) -> DataFrame:
    """Numbers the rows of each group 0, 1, 2, ... without a task that holds a whole group.

    A group is cut into pieces by a hash of the order columns, the more the more `rows` there are in all; rows are
    numbered inside a piece, and each piece begins where the ones before it end. The offsets are an aggregate of (group,
    piece). `order` must tell rows apart up to rows that are equal in every selected column.
    """
    parts = max(SLOT_PARTS, -(-rows // SLOT_ROWS))
    piece = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    rows = df.withColumn("_piece", piece)
    counts = rows.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(*order)) - 1
    return (
        rows.withColumn("_in", inside)
        .join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_piece") == F.col("_p")))
        .withColumn(out, (F.col("_start") + F.col("_in")).cast("long"))
        .drop("_g", "_p", "_piece", "_start", "_in")
    )
