"""JSON documents as sources and sinks: chunk sets, vector stores, component records, and files for each component."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: What the readers expect; fields that a file lacks are null, others are ignored.
AST_CHUNK = "id string, file string, type string, text string"
RAG_CHUNK = "type string, text string, component string"
EMBEDDED = "component string, name string, type string, dataType string, description string, text string, embedding array<double>"
RECORD = (
    "component string, file string, schema map<string,string>, dependencies array<struct<name:string,schema:string>>, jsxUsage array<string>, "
    "internalComponents array<string>, state array<struct<code:string>>, functions array<struct<name:string,code:string>>"
)
LEGACY = "id string, name string, component string, file string, properties array<struct<name:string,type:string>>, element string"


def json_rows(spark: SparkSession, path: str, schema: str, pattern: str | None = None, lines: bool = False) -> DataFrame:
    """Rows of JSON files below a folder; a file is one object or an array of them, or with `lines` an object a line, as
    save_json writes them."""
    reader = spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).json(path)


def json_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file_path and whole text of JSON files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select(F.regexp_replace("path", "^file:/*/", "/").alias("file_path"), F.col("content").cast("string").alias("content"))


def vector_store(spark: SparkSession, path: str) -> DataFrame:
    """All embedded chunks and components below a folder, in one table."""
    chunks = json_rows(spark, path, EMBEDDED, "*embedded*.json").withColumn("item_type", F.lit("chunk"))
    parts = json_rows(spark, path, EMBEDDED, "component.*.json").unionByName(json_rows(spark, path, EMBEDDED, "*.component.json"))
    return chunks.unionByName(parts.withColumn("item_type", F.lit("component")))


def save_rows(df: DataFrame, path: str) -> None:
    """One combined set, written over what is there."""
    df.write.mode("overwrite").parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    """One combined set as JSON, an object a line."""
    df.write.mode("overwrite").json(path)


def save_by(df: DataFrame, path: str, *keys: str) -> None:
    """A folder for each component (or other key); only the keys that are written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def array_documents(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, document: the rows of each key as one JSON array in the given order; null fields are left out."""
    rest = [c for c in df.columns if c != key and c not in order]
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(key, *rest).alias("row"))))
    return df.groupBy(key).agg(F.to_json(F.transform(rows, lambda r: r["row"])).alias("document"))


# ---------------------------------------------------------------- intermediate tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, as the session or its context has it.

    Where it is unset, a local session, as in tests, gets a folder of this machine; any other fails, since each executor
    would write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/loam"
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Tables of kept() that nobody has removed yet, by application.
_TABLES: dict[str, list[str]] = {}


def kept_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which remove_kept() removes with the tables."""
    path = f"{shared_dir(spark)}/loam-{tag}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def kept(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: what is dear to make is made once, however often it is read."""
    return kept_at(df, kept_path(df.sparkSession, tag))


def kept_at(df: DataFrame, path: str) -> DataFrame:
    """kept() at a path of kept_path(), for tables that their maker removes itself."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reaches."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The folders right below a path, in order; none if it isn't there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in store.listStatus(hadoop) if f.isDirectory()) if store.exists(hadoop) else []


def written(df: DataFrame, tag: str) -> DataFrame:
    """df itself if reading it runs no Python, else a table of it: what a provider or a parser made is made once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return kept(df, tag) if re.search("InArrow|InPandas|Python|UDF", plan) else df


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any store that Spark reaches."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def remove_kept(spark: SparkSession) -> int:
    """Removes the tables of kept() that this application has left; their number. Results that read them are lazy, so
    this is for when they have been written."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)
