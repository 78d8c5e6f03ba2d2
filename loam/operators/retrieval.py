"""Ranking: keyword and cosine scores, boosts, top-k, and the comparison of chunkings.

Chunks are the large side and are read once where they lie: each task scores its rows against all queries, block by block,
and passes on no more than k rows a query for some ten thousand chunks, so nothing but those is shuffled. Queries beyond
one block are written to the shared folder, and tasks read a block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.functions.spread import spread
from loam.sources.stores import kept_path

#: Rows and characters of a block of queries at most; blocks that a task keeps prepared if there are no more; rows and
#: bytes of chunks that meet the blocks together if there are.
BLOCK_QUERIES, BLOCK_CHARS, KEPT_BLOCKS, GATHERED, GATHERED_BYTES = 2048, 4_000_000, 4, 50_000, 64 << 20


#: Weights of kinds of items (others count once), and what an item gains that the question names.
WEIGHTS, NAMED = {"component": 1.1}, 0.2


# ---------------------------------------------------------------- scalar scores


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order; null where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different length, without direction, or null."""
    score = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) == F.size(b), F.nanvl(score, F.lit(None).cast("double")))


def boosted(score: Column, kind: Column, name: Column, query: Column) -> Column:
    """Components count 1.1 times; 0.2 more where the query names the item."""
    return score * F.when(kind == "component", F.lit(WEIGHTS["component"])).otherwise(F.lit(1.0)) + F.when(F.contains(F.lower(query), F.lower(name)), F.lit(NAMED)).otherwise(F.lit(0.0))


def keyword_score(query: Column, text: Column) -> Column:
    """Words of the query, split at single spaces, that stand anywhere in the text; each time they are asked for counts,
    case does not, and the empty word of a double space always stands."""
    low = F.lower(text)
    return F.size(F.filter(F.split(F.lower(query), " "), lambda w: F.contains(low, w)))


def best(scored: DataFrame, k: int, by: list[str], score: str = "score", ties: tuple[str, ...] = ()) -> DataFrame:
    """The first k rows of each group by descending score, nulls last, then by the tie columns; adds rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), *ties)
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


# ---------------------------------------------------------------- blocks of queries


class Blocks:
    """Queries in blocks of bounded rows and characters. One block travels with the code that needs it; several lie as files
    in the shared folder, where tasks read them one at a time: queries never meet on the driver."""

    def __init__(self, queries: DataFrame, key: str, value: str, chars: Column, words: str | None = None):
        sized = queries.select(F.col(key).alias("q"), F.col(value).alias("v"), chars.cast("long").alias("n"), (F.lower(words) if words else F.lit("")).alias("w"))
        facts = sized.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars")).first()
        self.count = max(1, -(-facts["rows"] // BLOCK_QUERIES), -(-facts["chars"] // BLOCK_CHARS))
        self.one = self.path = None
        if self.count == 1:
            self.one = sized.select("q", "v", "w").toArrow().sort_by("q").combine_chunks()
        else:
            self.path = kept_path(queries.sparkSession, "queries")
            block = F.pmod(F.xxhash64("q"), F.lit(self.count)).cast("int")
            sized.select("q", "v", "w", block.alias("block")).repartition("block").write.partitionBy("block").parquet(self.path)

    def __iter__(self) -> Iterator[pa.Table]:
        if self.path is None:
            yield from [self.one] if self.one.num_rows else []
            return
        store, root = pafs.FileSystem.from_uri(self.path)
        for info in store.get_file_info(pafs.FileSelector(root)):
            if info.base_name.startswith("block="):
                yield pq.read_table(info.path, filesystem=store, partitioning=None).sort_by("q").combine_chunks()


def _against(held: Blocks, prepare: Callable, score: Callable, k: int, rows: int, value: pa.DataType) -> Callable:
    """What a task does: its rows, some ten thousand at a time, meet every block of queries, and the k best rows of each query
    go on. score: scores of a slice of `rows` rows, a matrix with a row for each query of a prepared block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = [prepare(b) for b in held] if held.count <= KEPT_BLOCKS else None
        for whole in _gathered(batches, GATHERED if few is None else 1):
            for ready in few if few is not None else map(prepare, held):
                ids, found = ready[0], []
                for lo in range(0, whole.num_rows, rows):
                    part = whole.slice(lo, rows)
                    s, at = score(ready, part), np.asarray(part.column(0))
                    row, col = _top(s, at, k)
                    found.append((row, at[col], s[row, col]))
                row, at, s = (np.concatenate([f[c] for f in found]) for c in range(3))
                order = np.lexsort((at, -s, row))
                row, at, s = row[order], at[order], s[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[first]]), pa.array(at[first]), pa.array(s[first], value, mask=np.isneginf(s[first]))], names=["query", "found", "score"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches put together until there are `least` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if held and (sum(b.num_rows for b in held) >= least or sum(b.nbytes for b in held) >= GATHERED_BYTES):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    s = score[:, order]
    if s.shape[1] > k:
        least = np.partition(s, -k, 1)[:, -k]
        row, col = np.nonzero(s >= least[:, None])
    else:
        row, col = np.nonzero(np.ones(s.shape, bool))
    again = np.lexsort((col, -s[row, col], row))
    row, col = row[again], col[again]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], order[col[first]]


def keyword_top(chunks: DataFrame, queries: DataFrame, k: int = 3, key: str = "chunk_id", text: str = "text", query_key: str = "query_id", query_text: str = "text") -> DataFrame:
    """query, chunk, score, rank: the k best chunks of every query by keyword score, ties to the smaller chunk id.

    One automaton over all distinct words of a block of queries finds the words of a chunk in one reading of it, whatever
    their number. Chunks are read once, however many queries there are. Chunks that no word stands in take part with
    score 0. Null chunk texts count as empty. Ids are integers.
    """

    def prepare(block: pa.Table) -> tuple:
        words = [(t or "").lower().split(" ") for t in block.column("v").to_pylist()]
        terms = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws} - {""}))}
        always = np.array([ws.count("") for ws in words], np.float64)
        owner = np.repeat(np.arange(len(words)), [len(ws) - int(a) for ws, a in zip(words, always, strict=True)])
        flat = np.array([terms[w] for ws in words for w in ws if w], np.int64)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        finder = ahocorasick.Automaton()
        for w, i in terms.items():
            finder.add_word(w, i)
        finder.make_automaton()
        return np.asarray(block.column("q")), finder if terms else None, owner, np.searchsorted(flat, np.arange(len(terms) + 1)), always

    def score(ready: tuple, part: pa.Table) -> np.ndarray:
        _, finder, owner, cuts, always = ready
        out = np.repeat(always[:, None], part.num_rows, 1)
        for c, t in enumerate(part.column("text").to_pylist() if finder else ()):
            # A word that ends where a longer one does is found too: the automaton reports suffixes.
            if t and (hit := {i for _, i in finder.iter(t)}):
                who = np.concatenate([owner[cuts[i] : cuts[i + 1]] for i in hit])
                out[:, c] += np.bincount(who, minlength=len(always))
        return out

    held = Blocks(queries, query_key, query_text, F.length(query_text))
    rows = chunks.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("chunk"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    found = spread(rows).mapInArrow(_against(held, prepare, score, k, 2048, pa.float64()), "query long, found long, score double")
    return best(found.select("query", F.col("found").alias("chunk"), F.col("score").cast("int").alias("score")), k, ["query"], ties=("chunk",))


def vector_top(items: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", digits: int = 6, kind: str | None = None, name: str | None = None, question: str | None = None) -> DataFrame:
    """query, item, score, rank: the k items of the highest score for every query, scores rounded to `digits`.

    The score is the cosine; with the items' columns `kind` and `name` and the queries' column `question` it is boosted
    as by `boosted`.

    Items without direction, of another length than the query's, or null have a null score and come last; ties go to
    the smaller id. Exact: every item is scored, and read once, however many queries there are.
    """

    def prepare(block: pa.Table) -> tuple:
        vectors = [np.array(v if v is not None else [], np.float64) for v in block.column("v").to_pylist()]
        lengths = np.array([len(v) for v in vectors])
        alike = {n: (q := np.flatnonzero(lengths == n), np.stack([vectors[i] for i in q])) for n in np.unique(lengths[lengths > 0])}
        return np.asarray(block.column("q")), alike, [w or "" for w in block.column("w").to_pylist()]

    def score(ready: tuple, part: pa.Table) -> np.ndarray:
        ids, alike, said = ready
        lists = part.column("v").combine_chunks()
        size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        flat = np.asarray(lists.flatten().fill_null(np.nan), np.float64)
        begin = np.cumsum(size) - size
        out = np.full((len(ids), part.num_rows), -np.inf)
        for n, (q, a) in alike.items():
            c = np.flatnonzero(size == n)
            if len(c):
                b = flat[begin[c][:, None] + np.arange(n)]
                with np.errstate(all="ignore"):
                    s = (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None])
                out[np.ix_(q, c)] = np.where(np.isfinite(s), s, -np.inf)
        if kind:
            out *= np.array([WEIGHTS.get(x, 1.0) for x in part.column("kind").to_pylist()])[None]
        if question:
            names = part.column("name").to_pylist()
            at = {x: np.array([x in w for w in said]) * NAMED for x in set(names) - {None}}
            out += np.stack([at.get(x, np.zeros(len(said))) for x in names], 1)
        return np.where(np.isfinite(out), np.round(out, digits), -np.inf)

    held = Blocks(queries, key, vector, F.size(vector) * 8, question)
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item"), F.col(vector).cast("array<double>").alias("v"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("kind"), (F.lower(name) if name else F.lit(None).cast("string")).alias("name"))
    found = rows.mapInArrow(_against(held, prepare, score, k, 1024, pa.float64()), "query long, found long, score double")
    return best(found.withColumnRenamed("found", "item"), k, ["query"], ties=("item",))


# ---------------------------------------------------------------- evaluation


def accuracy(top: DataFrame, by: list[str], query: str = "query", least: int = 0) -> DataFrame:
    """by, correct, total, accuracy (percent): queries whose best score is over `least`; no chunks give 0 correct."""
    each = top.groupBy(*by, query).agg(F.max("score").alias("s"))
    out = each.groupBy(*by).agg(F.count_if(F.col("s") > least).cast("long").alias("correct"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("accuracy", F.round(F.try_divide(F.lit(100.0) * F.col("correct"), F.col("total")), 2))


def verdict(scores: DataFrame, first: str, second: str, strategy: str = "strategy", correct: str = "correct") -> DataFrame:
    """One row: the correct counts of two strategies and which performed better."""
    of = lambda s: F.coalesce(F.max(F.when(F.col(strategy) == s, F.col(correct))), F.lit(0))
    said = F.when(F.col(first) > F.col(second), f"{first} chunking performed better").when(F.col(second) > F.col(first), f"{second} chunking performed better")
    return scores.agg(of(first).alias(first), of(second).alias(second)).withColumn("verdict", said.otherwise("Both strategies performed equally"))


#: The questions of the evaluation.
QUESTIONS = (
    "What props does the Button component support?",
    "What variants does the Button component have?",
    "How does the Button handle click events?",
    "What does the Tree component render?",
    "How does the Tree component receive its data?",
    "How does TreeNode render child nodes?",
    "How does recursion work in the TreeNode component?",
    "What interface defines the Tree node structure?",
    "How are children nodes represented in TreeNodeData?",
    "How does the Tree component iterate through nodes?",
)
