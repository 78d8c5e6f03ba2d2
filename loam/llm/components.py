"""Connected components of an edge table: alternating large-star and small-star rounds, each written to shared storage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loam.llm.common import drop_table, join_keyed, materialize

#: Edges (16 bytes each) that one task solves by itself; more are contracted in rounds until they are so few or done.
LOCAL_EDGES = 400_000


def _star(edges: DataFrame, large: bool, spare: list[DataFrame]) -> DataFrame:
    """One round. The least neighbour of a node is an aggregate joined back; hubs are cut into pieces for that, so their
    edges don't meet in a task. The aggregate is written, since it is read up to three times; `spare` gets it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_many")), "least")
    spare.append(least)
    seen = join_keyed(both, least, ["u"], "_many", F.col("v"))
    if large:
        out = seen.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a partition's edges with the smallest node that its edges reach."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = top(x), top(y)
            root[max(x, y)] = min(x, y)
    pairs = [(x, t) for x in root if (t := top(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component for every node with an edge; the component is the smallest node that can be reached.

    Loops and edges with a null end are left out. The edge table never leaves the cluster; a round keeps at most as
    many edges as it had, and the number of rounds grows with the logarithm of the longest path. As soon as no more than
    LOCAL_EDGES are left, by count, one task finishes them, which gives what further rounds would.
    """
    now = materialize(edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.max("b").alias("m")).first()
        if not seen["n"] or tuple(seen) == mark:
            break
        mark = tuple(seen)
        if seen["n"] <= LOCAL_EDGES:
            step = materialize(now.coalesce(1).mapInArrow(_solve, "a long, b long"), "edges")
            drop_table(now)
            now = step
            break
        spare = [now]
        half = materialize(_star(now, True, spare), "edges")
        now = materialize(_star(half, False, spare), "edges")
        for t in (*spare, half):
            drop_table(t)
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
    whole._loam_path = now._loam_path
    return whole
