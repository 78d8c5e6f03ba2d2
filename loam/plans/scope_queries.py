"""Registered queries over types by scope: some files for each supplier, every folder with names that others have too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loam.operators import scopes
from loam.plans.registry import query
from loam.plans.tables import read
from loam.syntax.nodes import ts_nodes

#: By the supplier's key modulo four: barrels and names of other files, diamonds of heads, circles, ambiguous names.
FOLDERS = (
    {
        "Props.types.ts": 'import { Link, Missing } from "./barrel/a";\nimport type { Other as O } from "./other";\nimport { Pkg } from "pkg";\nexport interface Props { link: Link; o: O[]; own: Other; gone: Missing; pkg: Pkg }\ninterface Other { w{k}: number; up: Props }\n',
        "other.ts": "export interface Other { z: string; deep: { d: Inner } }\ninterface Inner { n: number }\n",
        "barrel/a.ts": 'export * from "./b";\n',
        "barrel/b/index.ts": 'export * from "../c";\nexport { Extra } from "../c";\n',
        "barrel/c.tsx": 'export { Deep as Link } from "./deep";\nexport default function X() { return <i />; }\n',
        "barrel/deep.d.ts": "export interface Deep { href: string; back: Deep }\n",
    },
    {
        "Props.types.ts": 'import Base, { Mixed as M } from "./lib";\nexport interface Props extends M, Base { id: string; size: Sized }\ninterface Sized { px: number }\n',
        "lib.ts": 'import { Root } from "./root";\nexport default interface Base extends Root { size: string; b{k}: Sized }\nexport interface Mixed extends Left, Right { m: number }\ninterface Left extends Root { x: "left" }\ninterface Right extends Root { x: "right"; r: 1 }\ninterface Sized { em: number }\n',
        "root.ts": "export interface Root extends Top { id: number; root: boolean }\ninterface Top { top: string }\n",
    },
    {
        "Props.types.ts": 'import { Loop } from "./loop";\nexport interface Props extends Loop { p: Ring }\ntype Ring = Chain & Link;\ninterface Chain { c{k}: string }\ninterface Link { l: Props }\n',
        "loop.ts": 'import { Props } from "./Props.types";\nexport * from "./loop2";\nexport interface Loop extends Props { q: number }\nexport interface Again extends Again { a: 1 }\n',
        "loop2.ts": 'export * from "./loop";\nexport interface Own { o: 1 }\n',
    },
    {
        "Props.types.ts": 'import { Twin, Named } from "./both";\nimport { Props as Theirs } from "./there";\nexport interface Props { twin: Twin; named: Named; t: Theirs }\n',
        "both.ts": 'export * from "./one";\nexport * from "./two";\nexport { Named } from "./two";\n',
        "one.ts": "export interface Twin { a: 1 }\nexport interface Named { n: 1 }\n",
        "two.ts": "export interface Twin { b: 2 }\nexport interface Named { n{k}: 2 }\n",
        "there.ts": "export interface Props { there: string }\n",
    },
)


def scoped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, content: the files of each supplier's folder."""
    k = F.col("s_suppkey")
    held = [F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in folder.items())) for folder in FOLDERS]
    shape = F.when(k % 4 == 0, held[0]).when(k % 4 == 1, held[1]).when(k % 4 == 2, held[2]).otherwise(held[3])
    rows = read(spark, sf_dir, "supplier").select(k, F.explode(shape).alias("f"))
    return rows.select(F.concat(F.lit("src/s"), k, F.lit("/"), F.col("f.name")).alias("file_path"), F.replace("f.text", F.lit("{k}"), k.cast("string")).alias("content"))


def _supplier(file: str = "file") -> Column:
    return F.regexp_extract(file, r"^src/s(\d+)/", 1).cast("long").alias("k")


def _expected(columns: str, rows: list[tuple]) -> str:
    """Rows of expected values for each supplier; the first value is the shape, # is the key."""
    names = columns.split()
    said = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)
    texts = {i for i, v in enumerate(rows[0]) if isinstance(v, str)}
    out = ", ".join(f"replace({c}, '#', s_suppkey::VARCHAR) AS {c}" if i in texts else f"{c}::INT AS {c}" for i, c in enumerate(names, 1))
    return f"SELECT s_suppkey::BIGINT AS k, {out} FROM supplier JOIN (VALUES {said}) v(m, {', '.join(names)}) ON s_suppkey % 4 = m"


@query(_expected("path depth said", [
    (0, "link", 1, "Link"), (0, "link.href", 2, "string"), (0, "link.back", 2, "Deep"), (0, "o", 1, "O[]"), (0, "o.z", 2, "string"), (0, "o.deep", 2, "{ d: Inner }"), (0, "o.deep.d", 3, "Inner"), (0, "o.deep.d.n", 4, "number"),
    (0, "own", 1, "Other"), (0, "own.w#", 2, "number"), (0, "own.up", 2, "Props"), (0, "gone", 1, "Missing"), (0, "pkg", 1, "Pkg"),
    (1, "id", 1, "string"), (1, "size", 1, "Sized"), (1, "size.px", 2, "number"), (1, "m", 1, "number"), (1, "x", 1, '"left"'), (1, "r", 1, "1"), (1, "root", 1, "boolean"), (1, "top", 1, "string"), (1, "b#", 1, "Sized"), (1, "b#.em", 2, "number"),
    (2, "p", 1, "Ring"), (2, "p.c#", 2, "string"), (2, "p.l", 2, "Props"), (2, "q", 1, "number"),
    (3, "twin", 1, "Twin"), (3, "named", 1, "Named"), (3, "named.n#", 2, "2"), (3, "t", 1, "Theirs"), (3, "t.there", 2, "string"),
]))
def scoped_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[recursive types by file, imports, default imports, re-exports, barrels, inherited members] The tree of each
    folder's own Props."""
    held = scopes.symbols(ts_nodes(scoped_files(spark, sf_dir)))
    tops = held.where("kind = 'InterfaceDeclaration' and name = 'Props' and file like '%/Props.types.ts'").select("file", F.col("name").alias("interface"))
    return scopes.trees(held, tops).select(_supplier(), "path", "depth", "said")


@query(_expected("owner place name said in_file in_owner", [
    (1, "Props", 0, "id", "string", "Props.types.ts", "Props"), (1, "Props", 1, "size", "Sized", "Props.types.ts", "Props"), (1, "Props", 2, "m", "number", "lib.ts", "Mixed"), (1, "Props", 3, "x", '"left"', "lib.ts", "Left"),
    (1, "Props", 4, "root", "boolean", "root.ts", "Root"), (1, "Props", 5, "top", "string", "root.ts", "Top"), (1, "Props", 6, "r", "1", "lib.ts", "Right"), (1, "Props", 7, "b#", "Sized", "lib.ts", "Base"),
    (1, "Base", 0, "size", "string", "lib.ts", "Base"), (1, "Base", 1, "b#", "Sized", "lib.ts", "Base"), (1, "Base", 2, "id", "number", "root.ts", "Root"), (1, "Base", 3, "root", "boolean", "root.ts", "Root"), (1, "Base", 4, "top", "string", "root.ts", "Top"),
    (2, "Props", 0, "p", "Ring", "Props.types.ts", "Props"), (2, "Props", 1, "q", "number", "loop.ts", "Loop"), (2, "Ring", 0, "c#", "string", "Props.types.ts", "Chain"), (2, "Ring", 1, "l", "Props", "Props.types.ts", "Link"),
    (2, "Loop", 0, "q", "number", "loop.ts", "Loop"), (2, "Loop", 1, "p", "Ring", "Props.types.ts", "Props"), (2, "Again", 0, "a", "1", "loop.ts", "Again"),
]))
def inherited_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[members inherited across files] Four levels, diamonds, circles, aliases of other types."""
    held = scopes.symbols(ts_nodes(scoped_files(spark, sf_dir)))
    rows = scopes.properties(held, scopes.scope(held)).where("owner in ('Props', 'Base', 'Ring', 'Loop', 'Again')")
    return rows.select(_supplier(), "owner", "place", "name", "said", F.regexp_extract("in_file", r"^src/s\d+/(.*)$", 1).alias("in_file"), "in_owner").where("k % 4 in (1, 2)")


@query(_expected("file name to_file to_name", [
    (0, "Props.types.ts", "Link", "barrel/deep.d.ts", "Deep"), (0, "Props.types.ts", "O", "other.ts", "Other"),
    (1, "Props.types.ts", "Base", "lib.ts", "Base"), (1, "Props.types.ts", "M", "lib.ts", "Mixed"), (1, "lib.ts", "Root", "root.ts", "Root"),
    (2, "Props.types.ts", "Loop", "loop.ts", "Loop"), (2, "loop.ts", "Props", "Props.types.ts", "Props"),
    (3, "Props.types.ts", "Named", "two.ts", "Named"), (3, "Props.types.ts", "Theirs", "there.ts", "Props"),
]))
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[imports followed to declarations] Through three barrels and a renamed re-export; ambiguous and absent names have no row."""
    held = scopes.symbols(ts_nodes(scoped_files(spark, sf_dir)))
    short = lambda c: F.regexp_extract(c, r"^src/s\d+/(.*)$", 1).alias(c)
    rows = scopes.scope(held).where("file <> to_file")
    return rows.select(_supplier(), short("file"), "name", short("to_file"), "to_name")
