"""Embedding: texts of chunks and components, and providers that turn texts into vectors."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loam.functions.js import or_else, text, trimmed
from loam.functions.spread import spread
from loam.sources.stores import subfolders, there

#: Tries after the first, and seconds before each of them.
RETRIES, WAIT = 3, 1.5

Provider = Callable[[list[str]], list[list[float]]]


def chunk_text(component: Column, name: Column, data_type: Column, description: Column, signature: Column) -> Column:
    """The sentence form of a property chunk; a chunk without a name prints undefined."""
    parts = (
        F.lit("The "), text(component), F.lit(' component has a property called "'), text(name), F.lit('".\n\nType: '), or_else(data_type, "unknown"),
        F.lit("\n\nDescription:\n"), or_else(description, "No description provided."), F.lit("\n\nCode:\n"), F.coalesce(signature, F.lit("")),
    )
    return trimmed(F.concat(*parts))


def component_text(component: Column, code: Column) -> Column:
    return trimmed(F.concat(F.lit("This is the full implementation of the "), text(component), F.lit(" component.\n\nCode:\n"), text(code)))


class HashProvider:
    """Vectors of unit length from hashed words and their pairs; offline, and the same everywhere."""

    def __init__(self, size: int = 256):
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            words = t.lower().split()
            for term in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = xxhash.xxh64_intdigest(term)
                out[i, h % self.size] += 1 if h >> 63 else -1
            n = np.sqrt((out[i] ** 2).sum())
            out[i] /= n if n else 1
        return out.tolist()


def with_retry(provider: Provider, texts: list[str], retries: int = RETRIES, wait: float = WAIT) -> list[list[float]]:
    """Calls a provider until it gives a vector for each text; the last failure is raised."""
    for left in range(retries, -1, -1):
        try:
            got = provider(texts)
            if len(got) != len(texts) or not all(got):
                raise ValueError("the provider's answer has no vector for each text")
            return got
        except Exception:
            if not left:
                raise
            time.sleep(wait)
    raise AssertionError


def embedded(rows: DataFrame, provider: Provider | None = None, column: str = "text", out: str = "embedding", batch: int = 64, pause: float = 0.0, wait: float = WAIT, callers: int = 8) -> DataFrame:
    """rows with a vector of `column`; batches of texts go to the provider from the executors.

    With `pause`, no more than one call in so many seconds is made by all tasks together, however many executors come
    and go: there are `callers` tasks at most, and each waits that long for all of them. A null text counts as an empty one.
    """
    wait_each = pause * callers
    provider = provider or HashProvider()
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                time.sleep(wait_each)
                vectors = with_retry(provider, [t or "" for t in part.column(column).to_pylist()], wait=wait)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*part.schema.names, out])

    return (rows.coalesce(callers) if pause else spread(rows)).mapInArrow(run, schema)


# ---------------------------------------------------------------- each text once

#: A row of the store: what was embedded (sha256 of the text), by which model, in which run, and the vector.
STORE = "digest string, model string, run long, embedding array<double>"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store; none if there is no store yet. Each run is a folder, which counts once it is whole; as a plan
    names the folders that it reads, plans over a store before and after a run are never taken for one another."""
    runs = [at for at in subfolders(spark, path) if there(spark, f"{at}/_SUCCESS")]
    return spark.read.schema(STORE).parquet(*runs) if runs else spark.createDataFrame([], STORE)


def embedded_once(rows: DataFrame, path: str, provider: Provider | None = None, model: str = "hash", column: str = "text", out: str = "embedding", **how) -> DataFrame:
    """rows with a vector of `column`, of which only texts that the store at `path` lacks go to the provider, each distinct one once.

    The store is keyed by content: a run adds what is new of its texts, in one commit, and nothing else is embedded or
    written; so a run that failed and is run again asks for the same texts. Models have vectors of their own. A null text
    counts as an empty one. Texts that many rows share meet the store by digest as any others; Spark splits such keys.
    """
    spark = rows.sparkSession
    digest = F.sha2(F.coalesce(F.col(column), F.lit("")), 256)
    old = stored(spark, path).where(F.col("model") == model)
    run = old.agg(F.coalesce(F.max("run"), F.lit(0)) + 1).first()[0]
    texts = rows.select(digest.alias("digest"), F.coalesce(F.col(column), F.lit("")).alias("_text"))
    new = texts.groupBy("digest").agg(F.first("_text").alias("_text")).join(old.select("digest"), "digest", "left_anti")
    made = embedded(new, provider, "_text", "embedding", **how)
    made.select("digest", F.lit(model).alias("model"), F.lit(run).cast("long").alias("run"), "embedding").write.parquet(f"{path}/run-{run:06d}-{uuid.uuid4().hex}")
    # Two runs at a time may have added one text twice.
    held = stored(spark, path).where(F.col("model") == model).groupBy("digest").agg(F.min_by("embedding", "run").alias(out))
    return rows.withColumn("digest", digest).join(held, "digest", "left").drop("digest")


def index(chunks: DataFrame, components: DataFrame, provider: Provider | None = None, keep_text: bool = True, store: str | None = None, **how) -> DataFrame:
    """component, name, chunk_type, item_type, dataType, text, embedding of all chunks and of each component with code.
    With `store`, a path, each distinct text is embedded once over all runs (embedded_once).

    chunks: component, type, name, dataType, description, signature, text; components: component, code. The text of a
    chunk is its own if it has one (`keep_text`), else the sentence of its property.
    """
    sentence = chunk_text(*(F.col(c) for c in ("component", "name", "dataType", "description", "signature")))
    said = F.coalesce("text", sentence) if keep_text else sentence
    one = chunks.select("component", "name", F.col("type").alias("chunk_type"), F.lit("chunk").alias("item_type"), "dataType", said.alias("text"))
    none = F.lit(None).cast("string")
    two = components.where(F.nullif(F.col("code"), F.lit("")).isNotNull()).select("component", none.alias("name"), none.alias("chunk_type"), F.lit("component").alias("item_type"), none.alias("dataType"), component_text(F.col("component"), F.col("code")).alias("text"))
    every = one.unionByName(two)
    return embedded_once(every, store, provider, **how) if store else embedded(every, provider, **how)
