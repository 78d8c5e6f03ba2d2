"""Exact top-k search by inner product: a Voronoi kNN join.

Queries and data go to their nearest pivot each. The summary of a group is its pivot, size and radius. A query group
(pivot p, radius r) and a data group (pivot s, radius t) score p.s + |p| t + |s| r + r t at most by Cauchy-Schwarz, and a
single query q in a data group q.s + |q| t. Each query group is solved in the data group of its own pivot first, which
gives every query a k-th score and the group its least one; a data group is then replicated only to those query groups
whose bound with it reaches that, and a query goes only where its own bound reaches its own. Data groups are cut into
blocks by a hash of the id, query groups into packs of bounded size, so no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loam.llm.common import bounded_batches, drop_table, materialize, table

#: Vectors for each pivot, the least and most pivots (groups beyond that are cut into more blocks), vectors of a block,
#: queries of a pack, which is what meets a block at once.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS, BLOCK, QUERIES = 2000, 8, 1024, 4096, 8192
GRID = 256


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as rows, with zeros up to `width`; those of one length are taken as they lie."""
    n = len(column)
    if n and width and pc.min_max(pc.binary_length(column)).as_py() == {"min": 8 * width, "max": 8 * width}:
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view(np.float64).reshape(n, width)
    out = np.zeros((len(column), width))
    for i, b in enumerate(column):
        v = np.frombuffer(b.as_buffer(), np.float64)
        out[i, : len(v)] = v
    return out


def quantized(vectors: DataFrame, grid: int = GRID, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, vec (packed doubles): floor(grid * x) of each component; rows that take no part are gone, and so are those
    with a component beyond all doubles once it is scaled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            valid = np.asarray(lists.is_valid()) & np.asarray(batch.column("vec_id").is_valid())
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(grid * np.asarray(lists.flatten().fill_null(np.nan), np.float64))
            ends = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))))
            wrong = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            valid &= wrong[ends[1:]] == wrong[ends[:-1]]
            vecs = [values[ends[i] : ends[i + 1]].tobytes() for i in np.flatnonzero(valid)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(valid)), pa.array(vecs, pa.binary())], names=["vec_id", "vec"])

    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, vec binary")


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers as longs; those beyond a long are its least or greatest.

    Products whose sums stay under 2^53 are exact as doubles; only pairs of rows that may go beyond are multiplied as
    integers of any size.
    """
    width = max(1, q.shape[1])
    high = lambda m: np.abs(m).max(1, initial=0.0)
    large, wide = high(q), high(x)
    beyond = np.multiply.outer(large, wide) * width >= 2.0**53
    if not beyond.any():
        return (q @ x.T).astype(np.int64)
    out = np.where(beyond, 0, q @ x.T).astype(np.int64)
    rows, cols = np.flatnonzero(beyond.any(1)), np.flatnonzero(beyond.any(0))
    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
    exact = np.clip(whole(q[rows]).dot(whole(x[cols]).T), _LEAST, _MOST).astype(np.int64)
    at = np.ix_(rows, cols)
    out[at] = np.where(beyond[at], exact, out[at])
    return out


def _solve(t: pa.Table, q: pa.Table, k: int, width: int) -> pa.Table:
    """The k best rows of a block for each of its queries, ties to the smaller id; rows of one id count once."""
    names = ["query_id", "vec_id", "score"]
    if not t.num_rows or not q.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names=names)
    t = t.sort_by("vec_id").combine_chunks()
    ids = np.asarray(t.column("vec_id"))
    x = _matrix(t.column("vec").combine_chunks(), width)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    asked, vecs = np.asarray(q.column("query_id")), _matrix(q.column("vec").combine_chunks(), width)
    own = ids[first]
    out = []
    for lo in range(0, len(asked), 256):
        s = _scores(vecs[lo : lo + 256], x)
        if len(first) < len(ids):
            s = np.maximum.reduceat(s, first, 1)
        self = asked[lo : lo + 256, None] == own[None, :]
        s[self] = _LEAST
        least = np.partition(s, -k, 1)[:, -k] if s.shape[1] > k else np.full(len(s), _LEAST)
        row, col = np.nonzero((s >= least[:, None]) & ~self)
        order = np.lexsort((own[col], ~s[row, col], row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[rank < k], col[rank < k]
        out.append((asked[lo + row], own[col], s[row, col]))
    return pa.table([pa.array(np.concatenate([o[c] for o in out])).cast(pa.int64()) for c in range(3)], names=names)


def _packs(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first pack of each query group and the number of its packs: a large group has several, small ones share one."""
    parts = np.maximum(1, -(-many // QUERIES))
    first, at, room = np.zeros(len(many), np.int64), -1, 0
    for g, n in enumerate(many.tolist()):
        if parts[g] > 1 or n > room or at < 0:
            first[g], at, room = at + 1, at + int(parts[g]), 0 if parts[g] > 1 else QUERIES - n
        else:
            first[g], room = at, room - n
    return first, parts


def knn_join(vectors: DataFrame, queries: DataFrame, k: int = 5, grid: int = GRID) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest integer inner product for each query, ties to smaller
    ids; fewer where there are fewer. vectors and queries: vec_id, embedding.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Scores are exact
    integers; one beyond a long counts as the least or greatest long, and ties of those go to smaller ids as all do. A query is
    never its own candidate; repeated rows of an id count once, with the best score where their vectors differ.
    Vectors of different length meet in their common components. Empty tables give none.
    """
    bounded_batches(vectors.sparkSession)
    held = materialize(quantized(vectors, grid), "vectors")
    asked = materialize(quantized(queries, grid).select(F.col("vec_id").alias("query_id"), "vec"), "queries")
    facts = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.octet_length("vec")), F.lit(0)).alias("w")).first()
    n, width = facts["n"], max(facts["w"], asked.agg(F.coalesce(F.max(F.octet_length("vec")), F.lit(0))).first()[0]) // 8
    pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, n // PER_PIVOT))
    # At most MOST_PIVOTS rows.
    picked = held.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(pivots).toArrow()
    p = np.unique(_matrix(picked.column("vec").combine_chunks(), width), axis=0) if picked.num_rows else np.zeros((1, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"), width)
                cell = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None]).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(((x - p[cell]) ** 2).sum(1)))], names=[*batch.schema.names, "cell", "r"])

    def summary(cells: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Size and radius of each group; a row for each pivot comes to the driver."""
        got = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).toPandas()
        size, radius = np.zeros(len(p), np.int64), np.zeros(len(p))
        size[got["cell"]], radius[got["cell"]] = got["n"], got["r"]
        return size, radius

    cells = held.mapInArrow(assign, "vec_id long, vec binary, cell int, r double")
    asking = asked.mapInArrow(assign, "query_id long, vec binary, cell int, r double")
    (size, radius), (many, reach) = summary(cells), summary(asking)
    blocks = np.maximum(1, -(-size // BLOCK))
    first, parts = _packs(many)
    norm = np.sqrt((p * p).sum(1))
    most = p @ p.T + norm[:, None] * radius[None] + reach[:, None] * norm[None] + reach[:, None] * radius[None]
    most = np.where((many[:, None] > 0) & (size[None] > 0), most + 1 + 1e-9 * np.abs(most), -np.inf)  # query group, data group

    def route(own: bool):
        """Rows of queries for the blocks that they meet: those of their own group, or of the others that can hold as high a
        score as `least`."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, home = _matrix(batch.column("vec"), width), np.asarray(batch.column("cell"))
                if own:
                    row, cell = np.arange(len(home)), home
                    row, cell = row[size[cell] > 0], cell[size[cell] > 0]
                else:
                    bound = x @ p.T + np.sqrt((x * x).sum(1))[:, None] * radius[None]
                    go = (bound + 1 + 1e-9 * np.abs(bound) >= np.asarray(batch.column("least").fill_null(-np.inf), np.float64)[:, None]) & (size[None] > 0)
                    go[np.arange(len(home)), home] = False
                    row, cell = np.nonzero(go)
                times = blocks[cell]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                cols = [batch.column(c).take(pa.array(row)) for c in ("query_id", "vec", "pack")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32))], names=["query_id", "vec", "pack", "cell", "block"])

        return run

    def by_cell(values: np.ndarray, at: Column) -> Column:
        return F.array(*(F.lit(int(v)) for v in values))[at]

    data = cells.select("vec_id", "vec", "cell", F.pmod(F.xxhash64("vec_id"), by_cell(blocks, F.col("cell"))).cast("int").alias("block"))
    asking = asking.withColumn("pack", (by_cell(first, F.col("cell")) + F.pmod(F.xxhash64("query_id"), by_cell(parts, F.col("cell")))).cast("int"))
    key = ["cell", "block", "pack"]

    def solve(routed: DataFrame, pairs: np.ndarray, at_home: bool) -> DataFrame:
        """pairs: which query groups (rows) need which data groups; the data go to the packs of those alone."""
        needs = [sorted({int(x) for g in np.flatnonzero(pairs[:, c]) for x in range(first[g], first[g] + parts[g])}) for c in range(len(p))]
        # A row for each pivot, with its packs.
        packs = vectors.sparkSession.createDataFrame([(c, own_packs) for c, own_packs in enumerate(needs) if own_packs], "cell int, packs array<int>")
        dealt = routed.mapInArrow(route(at_home), "query_id long, vec binary, pack int, cell int, block int")
        spread = data.join(F.broadcast(packs), "cell").select("vec_id", "vec", "cell", "block", F.explode("packs").alias("pack"))
        return spread.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(lambda t, q: _solve(t, q, k, width), "query_id long, vec_id long, score long")

    near = materialize(solve(asking, np.eye(len(p), dtype=bool) & (most > -np.inf), True), "near")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
    kth = top(near).where(f"rank = {k}").select("query_id", F.when(F.col("score") > F.lit(_LEAST), F.col("score")).cast("double").alias("least"))
    asking = materialize(asking.join(kth, "query_id", "left"), "asking")
    told = asking.groupBy("cell").agg(F.min(F.coalesce("least", F.lit(float("-inf")))).alias("least")).toPandas()  # a row for each pivot
    least = np.full(len(p), -np.inf)
    least[told["cell"]] = told["least"]
    pairs = (most >= least[:, None]) & (most > -np.inf) & ~np.eye(len(p), dtype=bool)
    found = materialize(top(near.unionByName(solve(asking, pairs, False))).where(f"rank <= {k}"), "best")
    for t in (held, asked, near, asking):
        drop_table(t)
    out = found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    #: Pairs of a query group and a data group that isn't its own, and those of them that had to meet.
    out.group_pairs = int((most > -np.inf).sum() - (np.diag(most) > -np.inf).sum()), int(pairs.sum())
    return out


def op10_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn_join(rows, rows.where(F.col("vec_id") % 50 == 0))
