"""Source texts as a table of syntax nodes: a DataFrame operator and a table function for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.functions.spread import spread
from loam.syntax.parser import SyntaxProblem, nodes_of

SCHEMA = (
    "file string, node_id int, parent_id int, kind string, name string, pos int, start int, end int, text string, init_kind string, callee string, "
    "identifier boolean, statement string, owner string, type string, optional boolean, top boolean, extends array<string>, doc string, imported string, module string, error string"
)
FIELDS = tuple(f.split()[0] for f in SCHEMA.split(", "))


def node_rows(file: str, text: str | None, without: str | None = None) -> list[tuple]:
    """Rows of one file in pre-order: SourceFile (id 0, without text) and the nodes below it, with ids from 1; a text that
    can't be parsed gives one row of kind Error with the reason. So every file has a row, empty and null ones too.

    without: a pattern that is taken out of a text that can't be parsed, which then is tried once more.
    """
    text = text or ""
    try:
        nodes = nodes_of(text, not file.endswith((".ts", ".js", ".mts", ".cts")))
    except (SyntaxProblem, IndexError, RecursionError) as e:
        if without and (less := re.sub(without, "", text)) != text:
            return node_rows(file, less)
        return [(file, 0, None, "Error", None, 0, 0, 0, None, *[None] * 12, f"{type(e).__name__}: {e}")]
    out, stack = [(file, 0, None, "SourceFile", None, 0, 0, len(text), None, *[None] * 12, None)], []
    for k, n in enumerate(nodes, 1):
        while stack and stack[-1][1] < n.end:
            stack.pop()
        x = n.extra
        statement = text[slice(*x["statement"])] if "statement" in x and x["statement"][1] is not None else None
        out.append((
            file, k, stack[-1][0] if stack else 0, n.kind, n.name, n.pos, n.start, n.end, text[n.start : n.end], x.get("init_kind"), x.get("callee"),
            x.get("identifier"), statement, x.get("owner"), x.get("type"), x.get("optional"), x.get("top"), x.get("extends"), x.get("doc"), x.get("imported"), x.get("module"), None,
        ))
        stack.append((k, n.end))
    return out


def node_batches(files: Iterable[str | None], texts: Iterable[str | None], without: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of files as Arrow batches of some thousand rows."""
    rows: list[tuple] = []
    for file, text in zip(files, texts, strict=True):
        rows += node_rows(file or "", text, without)
        if len(rows) > 5000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def ts_nodes(files: DataFrame, path: str = "file_path", content: str = "content", without: str | None = None) -> DataFrame:
    """The syntax nodes of every file; Arrow batches go through the parser on the executors; only small inputs are dealt out
    anew. without: as of node_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from node_batches(batch.column("file").to_pylist(), batch.column("content").to_pylist(), without)

    return spread(files.select(F.col(path).alias("file"), F.col(content).alias("content"))).mapInArrow(run, SCHEMA)


_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in SCHEMA.split(", ")])


def register(spark: SparkSession, name: str = "ts_nodes") -> None:
    """Registers two table functions for SQL: `name` for a row at a time (select n.* from files, lateral
    ts_nodes(file_path, content) n), and `name`_of for a whole table in Arrow batches, whose first two columns are the
    path and the text (select * from ts_nodes_of(table(files) partition by file_path))."""

    class TsNodes:
        def eval(self, file: str, text: str):
            yield from node_rows(file or "", text)

    class TsNodesOf:
        def eval(self, files: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for batch in node_batches(files.column(0).to_pylist(), files.column(1).to_pylist()):
                yield pa.Table.from_batches([batch])

    spark.udtf.register(name, F.udtf(TsNodes, returnType=SCHEMA))
    spark.udtf.register(f"{name}_of", F.arrow_udtf(TsNodesOf, returnType=SCHEMA))


def component_name(file):
    """Name of a file without folders and .tsx."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), "[.]tsx$", "")


