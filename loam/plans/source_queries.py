"""Registered queries over source files and schemas: shapes of files, folders and stores that they write first."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loam.functions import js
from loam.operators import chunks, extract, schema, scopes
from loam.plans import rag
from loam.plans.registry import query
from loam.plans.shapes import SHAPES, by_shape, filled, shape_files, sql_by_shape, sql_filled, sql_lists_by_shape, sql_text
from loam.plans.tables import read
from loam.sources import files, folders, stores
from loam.streaming import streams
from loam.syntax.nodes import register, ts_nodes

_FILE = "'src/components/S' || p_partkey || '/S' || p_partkey || '.tsx'"
_LISTS = ("dependencies", "tags", "internal", "state", "functions")


def _strict(field: str) -> str:
    return sql_by_shape([getattr(s, field) for s in SHAPES])


def _loose(field: str) -> str:
    return sql_by_shape([(s.loose or {}).get(field, getattr(s, field)) for s in SHAPES])


def _flat(rows: DataFrame) -> DataFrame:
    """Records with their lists as texts."""
    return rows.select(
        "component", "file", js.joined(F.col("dependencies"), ",").alias("dependencies"), js.joined(F.col("jsxUsage"), ",").alias("tags"), js.joined(F.col("internalComponents"), ",").alias("internal"),
        js.joined(F.transform("state", lambda s: s["code"]), "#").alias("state"), js.joined(F.transform("functions", lambda f: F.concat(f["name"], F.lit("|"), f["code"])), "#").alias("functions"),
    )


# ---------------------------------------------------------------- extraction from files of many shapes


@query(f"SELECT 'S' || p_partkey AS component, {_FILE} AS file, {', '.join(f'{_strict(f)} AS {f}' for f in _LISTS)} FROM part")
def record_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[imports, state, functions, internal components, tags; a record for every file] Twelve shapes of files."""
    return _flat(extract.records(ts_nodes(shape_files(spark, sf_dir))))


@query(f"SELECT 'S' || p_partkey AS component, {_FILE} AS file, {', '.join(f'{_loose(f)} AS {f}' for f in _LISTS)} FROM part")
def loose_record_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[the loose rules] The same files."""
    return _flat(extract.loose_records(ts_nodes(shape_files(spark, sf_dir))))


@query(f"""WITH s AS (SELECT {_FILE} AS file, {sql_by_shape([s.last for s in SHAPES])} AS component, {sql_by_shape([s.interface for s in SHAPES])} AS last FROM part)
    SELECT 'babel' AS parser, component, last AS props_interface, file FROM s WHERE component IS NOT NULL
    UNION ALL SELECT 'typescript', component, CASE WHEN component = 'Über' THEN 'ÜberProps' ELSE '' END, file FROM s WHERE component IS NOT NULL
    UNION ALL SELECT 'tree-sitter', component, NULL, file FROM s WHERE component IS NOT NULL""")
def front_end_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[three front ends] The last component and interface of files of many shapes."""
    return extract.front_ends(ts_nodes(shape_files(spark, sf_dir))).withColumnRenamed("propsInterface", "props_interface")


@query(f"SELECT {_FILE} AS file, {sql_lists_by_shape([s.chunks for s in SHAPES])} AS text FROM part")
def ast_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[syntax chunks] Functions and variable statements at any depth of files of many shapes."""
    return extract.ast_chunks(ts_nodes(shape_files(spark, sf_dir))).select("file", "text")


_SHAPED = f"""s AS (SELECT 'S' || p_partkey AS c, {', '.join(f"{_strict(f)} AS {f}" for f in _LISTS)} FROM part),
    f AS (SELECT c, unnest(l) AS f, generate_subscripts(l, 1) AS i FROM (SELECT c, CASE WHEN functions = '' THEN [] ELSE string_split(functions, '#') END AS l FROM s)),
    g AS (SELECT c, i, regexp_extract(f, '^([^|]*)[|]', 1) AS name, regexp_extract(f, '(?s)^[^|]*[|](.*)$', 1) AS code FROM f),
    t AS (SELECT c, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT c, CASE WHEN tags = '' THEN [] ELSE string_split(tags, ',') END AS l FROM s)),
    d AS (SELECT c, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT c, CASE WHEN dependencies = '' THEN [] ELSE string_split(dependencies, ',') END AS l FROM s)),
    z AS (SELECT c, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT c, CASE WHEN state = '' THEN [] ELSE string_split(state, '#') END AS l FROM s))"""


@query(f"""WITH {_SHAPED},
    b AS (SELECT 1 AS b, 0 AS i, c, 'overview' AS type, c || ' is a UI component' || CASE WHEN internal <> '' THEN ' composed of ' || replace(internal, ',', ', ') ELSE '' END || CASE WHEN state <> '' THEN ' that manages state' ELSE '' END || '.' AS text FROM s
        UNION ALL SELECT 3, 0, c, 'dependencies', c || ' depends on: ' || replace(dependencies, ',', ', ') FROM s WHERE dependencies <> ''
        UNION ALL SELECT 4, 0, c, 'composition', c || ' is composed of: ' || replace(internal, ',', ', ') FROM s WHERE internal <> ''
        UNION ALL SELECT 5, 0, c, 'render_flow', c || ' renders ' || string_agg(x, ', ' ORDER BY i) FROM t WHERE i <= 5 GROUP BY c
        UNION ALL SELECT 6, i, c, 'state', c || ' manages state: ' || CASE WHEN length(x) > 200 THEN left(x, 200) || '...' ELSE x END FROM z
        UNION ALL SELECT 7, i, c, CASE WHEN left(name, 1) = upper(left(name, 1)) THEN 'subcomponent' ELSE 'function_summary' END, name || CASE WHEN left(name, 1) = upper(left(name, 1)) THEN ' is a reusable UI subcomponent' ELSE ' is a helper logic function' END FROM g
        UNION ALL SELECT 8, i, c, 'example', '<' || name || ' />' FROM g WHERE left(name, 1) = upper(left(name, 1))
        UNION ALL SELECT 9, 0, c, 'example', '<' || c || ' />' FROM s)
    SELECT c AS component, (row_number() OVER (PARTITION BY c ORDER BY b, i) - 1)::INT AS ord, type, text FROM b""")
def rag_chunk_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[retrieval chunks] From files of many shapes, without schemas."""
    records = extract.records(ts_nodes(shape_files(spark, sf_dir)))
    none = F.lit(None)
    records = records.withColumn("schema", none.cast("map<string,string>")).withColumn("dependencies", F.transform("dependencies", lambda n: F.struct(n.alias("name"))))
    return chunks.rag_chunks(records)


@query(f"""WITH {_SHAPED},
    b AS (SELECT 1 AS b, 0 AS i, c, 'behavior' AS type, NULL AS name, c || ' uses React useState hook for internal state management.' AS text FROM s WHERE state <> ''
        UNION ALL SELECT 2, i, c, 'dependency', NULL, c || ' imports and uses ' || x || ' component.' FROM d
        UNION ALL SELECT 3, i, c, 'render', NULL, c || ' renders ' || x || ' component in JSX.' FROM t
        UNION ALL SELECT 4, i, c, 'function', name, c || ' contains function ' || name || ': ' || left(code, 100) FROM g)
    SELECT c AS component, (row_number() OVER (PARTITION BY c ORDER BY b, i) - 1)::INT AS ord, type, name, text FROM b""")
def knowledge_chunk_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[knowledge chunks] From the same files; the code of one function is cut at a hundred characters."""
    return chunks.knowledge_chunks(extract.records(ts_nodes(shape_files(spark, sf_dir))))


_TYPED = (
    "const A{k}: React.FC<P{z}> = ({ a }) => { return a; };\nconst B{k} : React.FC = () => {t};",
    "function none() { return {z}; }",
    "const C{k}: React.FC<{ x: {z} }> = (p) => { if (p) { return 1; } };",
)


@query(f"""WITH s AS (SELECT p_partkey, p_size, p_type, p_partkey % 3 AS m FROM part),
    c AS (SELECT p_partkey, p_size, p_type, unnest(CASE m WHEN 0 THEN [{{'o': 0, 'i': 'A{{k}}', 't': 'const A{{k}}: React.FC<P{{z}}> = ({{ a }}'}}]
        WHEN 2 THEN [{{'o': 0, 'i': 'C{{k}}', 't': 'const C{{k}}: React.FC<{{ x: {{z}} }}'}}] ELSE [] END) AS r FROM s)
    SELECT p_partkey, r.o::INT AS ord, {sql_filled("r.i")} AS id, 'function' AS type, {sql_filled("r.t")} AS text FROM c""".replace("{{", "{").replace("}}", "}"))
def function_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[pattern chunks with the pattern of typed constant components] A chunk ends at the first closing brace."""
    return extract.pattern_chunks(read(spark, sf_dir, "part").select("p_partkey", by_shape(list(_TYPED)).alias("content")), key="p_partkey")


@query("SELECT p_partkey AS k, unnest(['FunctionDeclaration', 'JsxSelfClosing', 'SourceFile', 'VariableDeclaration']) AS kind, 1 AS n FROM part")
def table_function_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[the SQL table function] Nodes of each kind in a file for each part."""
    register(spark)
    text = filled(F.lit("function F{k}() { for (const x of {z}) { } return <G{k} />; }"))
    source = read(spark, sf_dir, "part").select("p_partkey", text.alias("content"))
    return spark.sql("SELECT p_partkey AS k, n.kind, cast(count(*) AS int) AS n FROM {source}, LATERAL ts_nodes('f.tsx', content) n GROUP BY ALL", source=source)


@query("""SELECT p_partkey % 10 AS part, kind, count(*) AS n FROM part, (VALUES ('FunctionDeclaration'), ('JsxSelfClosing'), ('SourceFile'), ('VariableDeclaration')) v(kind) GROUP BY ALL
    UNION ALL SELECT p_partkey % 10, 'ImportSpecifier', sum(p_size % 3 + 1)::BIGINT FROM part GROUP BY ALL""")
def table_argument_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[the SQL table function over a table] Nodes of each kind, from a table that goes through in Arrow batches."""
    register(spark)
    names = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda i: F.concat(F.lit("N"), i)), ", ")
    text = F.concat(F.lit("import { "), names, filled(F.lit(' } from "./n";\nfunction F{k}() { for (const x of {z}) { } return <G{k} />; }')))
    source = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey") % 10, F.lit("/"), "p_partkey", F.lit(".tsx")).alias("file_path"), text.alias("content"))
    return spark.sql("SELECT cast(regexp_extract(file, '^p([0-9])/', 1) AS bigint) AS part, kind, count(*) AS n FROM ts_nodes_of(TABLE({source}) PARTITION BY file_path) GROUP BY ALL", source=source)


_OWN = ("export const V{k}: React.FC<Props> = ({ a }) => <i />;\n", "interface Props { a{z}: string; b?: number }\n", 'import { Props } from "./types";\n', 'import { Given as Props } from "../shared/{k}";\n', "")


@query("""WITH s AS (SELECT p_partkey, p_size, p_partkey % 4 AS m FROM part)
    SELECT 'docgen' AS parser, 'V' || p_partkey AS "componentName", 'src/' || p_partkey || '/V.tsx' AS file, CASE m
        WHEN 0 THEN '{"displayName":"V' || p_partkey || '","props":[{"name":"a' || p_size || '","type":"string","optional":false},{"name":"b","type":"number","optional":true}]}'
        WHEN 1 THEN '{"displayName":"V' || p_partkey || '","props":[{"name":"t' || p_partkey || '","type":"Date","optional":false}]}'
        WHEN 2 THEN '{"displayName":"V' || p_partkey || '","props":[{"name":"s","type":"boolean","optional":false,"doc":"Shared ' || p_size || '."}]}'
        ELSE '{"displayName":"V' || p_partkey || '"}' END AS doc FROM s""")
def documented_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[documented components] Every file has its own Props, or imports them by name or under another, or has none."""
    part = read(spark, sf_dir, "part")
    m = F.col("p_partkey") % 4
    head = F.when(m == 0, F.lit(_OWN[1])).when(m == 1, F.lit(_OWN[2])).when(m == 2, F.lit(_OWN[3])).otherwise(F.lit(""))
    view = part.select(filled(F.lit("src/{k}/V.tsx")).alias("file_path"), filled(F.concat(head, F.lit(_OWN[0]))).alias("content"))
    types = part.where(m != 3).select(filled(F.lit("src/{k}/types.ts")).alias("file_path"), filled(F.lit("export interface Props { t{k}: Date }")).alias("content"))
    shared = part.select(filled(F.lit("src/shared/{k}.ts")).alias("file_path"), filled(F.lit("export interface Given { /** Shared {z}. */ s: boolean }\ninterface Props { no: string }")).alias("content"))
    return extract.documented_components(ts_nodes(view.unionByName(types).unionByName(shared))).drop("node_id")


# ---------------------------------------------------------------- schemas from source

_TYPES = (
    ("export interface A{k} extends Base, Omit<X, \"y\"> { /** Doc {z}. */ a?: string | number; f(x: number): void; [key: string]: {z} }\ninterface Item{z} { id: string; next?: Item{z}[] }",
     {"A{k}": '{"type":"object","properties":{"a":{"type": ["string", "number"], "description": "Doc {z}."},"f":{"$comment": "(x: number): void"}},"required":["f"],"additionalProperties":{"type": "number", "enum": [{z}]},"allOf":[{"$ref":"#/definitions/Base"}]}',
      "Item{z}": '{"type":"object","properties":{"id":{"type": "string"},"next":{"type": "array", "items": {"$ref": "#/definitions/Item{z}"}}},"required":["id"]}'}),
    ("export type Kind{k} = \"a\" | \"b{z}\";\ntype Both = A & { c: boolean };\ntype Map{z} = Record<string, (string | null)[]>;",
     {"Kind{k}": '{"type": "string", "enum": ["a", "b{z}"]}', "Both": '{"allOf": [{"$ref": "#/definitions/A"}, {"type": "object", "properties": {"c": {"type": "boolean"}}, "required": ["c"]}]}',
      "Map{z}": '{"type": "object", "additionalProperties": {"type": "array", "items": {"type": ["string", "null"]}}}'}),
    ("export enum Level{k} { Low = {z}, High, Top = \"t\" }\nconst enum Bit { Off, On }",
     {"Level{k}": None, "Bit": '{"type": "number", "enum": [0, 1]}'}),
    ("interface D{k} { deep: { z: {z}; w?: Q[] }; go: () => void; either: A | (() => void) }\ninterface D{k} { more: unknown }",
     {"D{k}": '{"type":"object","properties":{"deep":{"type": "object", "properties": {"z": {"type": "number", "enum": [{z}]}, "w": {"type": "array", "items": {"$ref": "#/definitions/Q"}}}, "required": ["z"]},"go":{"$comment": "() => void"},"either":{"anyOf": [{"$ref": "#/definitions/A"}, {"$comment": "() => void"}]},"more":{}},"required":["deep","go","either","more"]}'}),
)
_LEVEL = """'{"type": ["string", "number"], "enum": ["t", ' || p_size || ', ' || (p_size + 1) || ']}'"""


def _type_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(filled(F.lit("src/T{k}.types.ts")).alias("file_path"), by_shape([t for t, _ in _TYPES]).alias("content"))


@query("\nUNION ALL ".join(f"SELECT 'src/T' || p_partkey || '.types.ts' AS file, {sql_filled(sql_text(name))} AS name, {sql_filled(sql_text(body)) if body else _LEVEL} AS definition FROM part WHERE p_partkey % 4 = {m}" for m, (_, held) in enumerate(_TYPES) for name, body in held.items()))
def type_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[schemas of all types] Interfaces, aliases, enumerations, intersections, index signatures and inline objects."""
    return schema.definitions(ts_nodes(_type_files(spark, sf_dir))).select("file", "name", "definition")


@query("""SELECT 'src/T' || p_partkey || '.types.ts' AS file, unnest(CASE p_partkey % 4 WHEN 0 THEN ['A' || p_partkey, 'Item' || p_size] WHEN 3 THEN ['D' || p_partkey, 'D' || p_partkey] ELSE [] END) AS interface,
    unnest(CASE p_partkey % 4 WHEN 0 THEN [0, 1] WHEN 3 THEN [0, 1] ELSE [] END)::INT AS ord FROM part""")
def interface_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[interfaces at the top of each file]"""
    return extract.interfaces(ts_nodes(_type_files(spark, sf_dir))).withColumn("ord", F.col("ord").cast("int"))


_TREES = "interface R{k} { a: B{k} | C{k}[]; f: () => B{k}; x: { y: C{k} }; self: R{k} }\ninterface B{k} { s{z}: string; c: C{k} }\ntype C{k} = { n: number }"


@query("""WITH w AS (SELECT p_partkey AS k, p_size AS z, unnest([
        {'p': 'a', 'd': 1, 's': 'B# | C#[]'}, {'p': 'f', 'd': 1, 's': '() => B#'}, {'p': 'x', 'd': 1, 's': '{ y: C# }'}, {'p': 'self', 'd': 1, 's': 'R#'}, {'p': 'a.s~', 'd': 2, 's': 'string'}, {'p': 'a.c', 'd': 2, 's': 'C#'},
        {'p': 'a.n', 'd': 2, 's': 'number'}, {'p': 'a.c.n', 'd': 3, 's': 'number'}, {'p': 'x.y', 'd': 2, 's': 'C#'}, {'p': 'x.y.n', 'd': 3, 's': 'number'},
        {'p': '.x:y', 'd': 1, 's': 'C#'}, {'p': '.x:y.n', 'd': 2, 's': 'number'}, {'p': 'B:s~', 'd': 1, 's': 'string'}, {'p': 'B:c', 'd': 1, 's': 'C#'}, {'p': 'B:c.n', 'd': 2, 's': 'number'}, {'p': 'C:n', 'd': 1, 's': 'number'}]) AS r FROM part),
    e AS (SELECT k, z, CASE WHEN r.p LIKE '.x:%' THEN 'R' || k || '.x' WHEN r.p LIKE '_:%' THEN left(r.p, 1) || k ELSE 'R' || k END AS root, {'p': regexp_replace(r.p, '^[^:]*:', ''), 'd': r.d, 's': r.s} AS r FROM w)
    SELECT root, replace(r.p, '~', z::VARCHAR) AS path, r.d::INT AS depth, list_extract(string_split(replace(r.p, '~', z::VARCHAR), '.'), -1) AS name, replace(r.s, '#', k::VARCHAR) AS said FROM e""")
def interface_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[recursive types] Unions, arrays, inline objects and aliases are followed, functions and cycles are not."""
    source = read(spark, sf_dir, "part").select(filled(F.lit("src/{k}.types.ts")).alias("file_path"), filled(F.lit(_TREES)).alias("content"))
    return scopes.trees(scopes.symbols(ts_nodes(source))).drop("file")


@query("""SELECT 'B' || p_partkey AS root, CASE n WHEN 0 THEN 's' || p_size WHEN 1 THEN 'c' ELSE 'c.n' END AS path FROM part, range(3) t(n)""")
def last_interface_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[the last interface of a file]"""
    nodes = ts_nodes(read(spark, sf_dir, "part").select(filled(F.lit("src/{k}.types.ts")).alias("file_path"), filled(F.lit(_TREES)).alias("content")))
    return scopes.last_trees(scopes.symbols(nodes)).select("root", "path")


# ---------------------------------------------------------------- cleaning

_DIRTY = (
    'import React, { M } from "react";\nexport interface A{k} extends B {\n x: MouseEvent<H{z}>; a?: A{k}[] }\nexport interface A{k} { p: Partial<B> }\nexport interface B { y: A{k}; z: B }',
    "export interface Q{k} extends R<{z}>, S { y: Q{k} }",
)
_CLEAN = (
    "\nexport interface A{k}1 extends B1 {\n x: any; a?: A{k}1[] }\nexport interface A{k}2 { p: Partial<B1> }\nexport interface B1 { y: A{k}1; z: B1 }",
    _DIRTY[1],
)


@query(f"""SELECT p_partkey, {sql_by_shape(list(_CLEAN))} AS content, p_partkey % 2 = 0 AS repeats, {sql_by_shape([_DIRTY[0].replace('extends B {', '{'), 'export interface Q{k} { y: Q{k} }'])} AS bare FROM part""")
def numbered_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[duplicate test, renaming, reference repair, heads taken out]"""
    rows = read(spark, sf_dir, "part").select("p_partkey", by_shape(list(_DIRTY)).alias("content"))
    told = rows.select("p_partkey", schema.repeats_interface(F.col("content")).alias("repeats"), schema.without_heads(F.col("content")).alias("bare"))
    return schema.cleaned(rows).join(told, "p_partkey")


@query("""WITH s AS (SELECT p_partkey AS k, p_partkey % 3 AS m FROM part)
    SELECT k || '.ts' AS file, 'SourceFile' AS kind, NULL AS name FROM s WHERE m < 2 UNION ALL SELECT k || '.ts', 'InterfaceDeclaration', 'A' || k FROM s WHERE m < 2
    UNION ALL SELECT k || '.ts', 'PropertySignature', 'x' FROM s WHERE m < 2 UNION ALL SELECT k || '.ts', 'Error', NULL FROM s WHERE m = 2""")
def retried_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[retry without heads, errors kept apart] One in three files parses at once, one without its heads, one not at all."""
    text = by_shape(["export interface A{k} extends B { x: string }", "export interface A{k} extends B<`> { x: string }", "const A{k} = ("])
    return schema.nodes_or_retry(read(spark, sf_dir, "part").select(filled(F.lit("{k}.ts")).alias("file_path"), text.alias("content"))).select("file", "kind", "name")


# ---------------------------------------------------------------- rules on schema values

_VALUES = (
    ('{"type":"array","items":{"$ref":"#/definitions/N{k}"}}', "N{k}[]", "N{k}", "{n} property of C component."), ('{"type":"array","items":{"type":["string","null"]}}', "string,null[]", None, "{n} property of C component."),
    ('{"type":"array"}', "array", None, "{n} property of C component."), ('{"type":"string","enum":["{t}","b"]}', "string", None, "{n} can be one of: {t}, b."), ('{"type":["string","number"]}', "string,number", None, "{n} property of C component."),
    ('{"$ref":"#/definitions/O{z}"}', "O{z}", "O{z}", "{n} property of C component."), ("{}", "any", None, "{n} property of C component."), ('{"type":"boolean","description":""}', "boolean", None, "Boolean flag to control {n} behavior in C."),
    ('{"description":"Said {t}.","$comment":"() => void"}', "any", None, "Said {t}."),
)


@query(f"""SELECT p_partkey, {sql_by_shape([v[1] for v in _VALUES])} AS said, {sql_by_shape([v[2] for v in _VALUES])} AS link FROM part""")
def type_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[property types]"""
    said, link = schema.resolved_type(F.col("held"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.from_json(by_shape([v[0] for v in _VALUES]), schema.PROPERTY).alias("held"))
    return rows.select("p_partkey", said.alias("said"), link.alias("link"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_partkey % 9 <> 8 THEN 'Callback function triggered when pick' || p_size || ' occurs in C.'
    ELSE replace({sql_by_shape([v[3] for v in _VALUES])}, '{{n}}', CASE WHEN p_size % 4 = 0 THEN 'onPick' || p_size ELSE 'name' || p_size END) END AS said FROM part""")
def describe_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[property descriptions]"""
    name = F.concat(F.when(F.col("p_size") % 4 == 0, "onPick").otherwise("name"), "p_size")
    rows = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.from_json(by_shape([v[0] for v in _VALUES]), schema.PROPERTY).alias("held"))
    return rows.select("p_partkey", schema.described(F.col("name"), F.col("held"), F.lit("C")).alias("said"))


_BODIES = (
    '{"properties":{"b":{"type":"string"},"a{z}":{}},"allOf":[{"$ref":"#/x"},{"properties":{"c":{"type":"number"},"b":{"type":"{k}"}}}]}', '{"allOf":[{"properties":{"q{k}":{}}},{"properties":{"q{k}":{"x":{z}}}}]}', '{"type":"object"}', '{"properties":{"only":{"y":[1, 2]}}}',
)


@query("""WITH b AS (SELECT p_partkey AS k, unnest(CASE p_partkey % 4
        WHEN 0 THEN [{'i': 0, 'n': 'b', 'v': '{"type":"' || p_partkey || '"}'}, {'i': 1, 'n': 'a' || p_size, 'v': '{}'}, {'i': 2, 'n': 'c', 'v': '{"type":"number"}'}]
        WHEN 1 THEN [{'i': 0, 'n': 'q' || p_partkey, 'v': '{"x":' || p_size || '}'}] WHEN 3 THEN [{'i': 0, 'n': 'only', 'v': '{"y":[1,2]}'}] ELSE [] END) AS r FROM part)
    SELECT k AS p_partkey, r.i::INT AS place, r.n AS name, r.v AS value FROM b""")
def inherited_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[own and inherited properties] A later value takes the place of an earlier one."""
    rows = read(spark, sf_dir, "part").select("p_partkey", by_shape(list(_BODIES)).alias("body"))
    return schema.own_and_inherited(rows, keys=("p_partkey",))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x' || p_size || ' ' || p_type || ';y' WHEN 2 THEN '' ELSE 't' END AS props FROM part WHERE p_partkey % 4 <> 1  -- those are objects""")
def array_schema_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[only array schemas count]"""
    text = by_shape([' [{"name":"x{z}","type":"{t}"}, {"name":"y"}]', '{"definitions":{}}', "[]", '[{"type":"t"}]'])
    rows = chunks.array_schemas(read(spark, sf_dir, "part").select("p_partkey", text.alias("content")))
    held = F.from_json("content", "array<struct<name:string,type:string>>")
    return rows.select("p_partkey", js.joined(F.transform(held, lambda p: F.concat_ws(" ", p["name"], p["type"])), ";").alias("props"))


@query("""SELECT p_partkey, replace(p_name, ' ', '.') AS dots, CASE WHEN contains(p_name, ' ') THEN regexp_replace(p_name, ' ', '_') ELSE p_name END AS once FROM part""")
def first_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[replacement of the first occurrence]"""
    return read(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("dots"), js.replaced_once(F.col("p_name"), " ", "_").alias("once"))


# ---------------------------------------------------------------- folders and stores


def _new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one, and its removal with the other kept tables."""
    path = f"{stores.shared_dir(spark)}/loam-{tag}-{uuid.uuid4().hex}"
    stores._TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Files of each supplier, by path: what it depends on, and the text; {n} is the key and {s} the name of the supplier.
_FILES = (
    ("true", "components/N{n}/{types}", "export interface N{n}Props { data: string; on{n}: () => void }\r\n"),
    ("n % 3 > 0", "components/N{n}/{code}", "const N{n}: React.FC<N{n}Props> = () => <Leaf{n} />; // {s}"),
    ("true", "components/N{n}/N{n}.schema.json", "{}"), ("true", "components/N{n}/chunks.N{n}.json", "[]"), ("true", "components/N{n}/N{n}.full.json", "{}"),
    ("true", "dist/N{n}.tsx", "no"), ("true", "components/node_modules/N{n}/x.ts", "no"), ("true", "components/N{n}/__pycache__/y.ts", "no"),
    ("true", "components/flat{n}.js", "f"), ("true", "other/{n}.md", "m"),
)


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of components, some files for each supplier, written by tasks to the shared folder."""
    root = _new_folder(spark, "source")
    n = F.col("s_suppkey")
    named = {"{n}": n.cast("string"), "{s}": F.col("s_name"), "{types}": F.concat(F.lit("N"), n, F.when(n % 2 == 1, ".types.ts").otherwise(".ts")), "{code}": F.when(n % 3 == 1, F.concat(F.lit("N"), n, F.lit(".tsx"))).otherwise("index.tsx")}

    def said(text: str) -> Column:
        out = F.lit(text)
        for mark, value in named.items():
            out = F.replace(out, F.lit(mark), value) if mark in text else out
        return out

    each = [F.when(F.expr(w.replace("n ", "s_suppkey ")), F.struct(said(p).alias("path"), said(t).cast("binary").alias("document"))) for w, p, t in _FILES]
    each.append(F.when(n % 5 == 0, F.struct(said("components/N{n}/Bad.ts").alias("path"), F.lit(b"\xff\xfe\xfa").alias("document"))))
    folders.save_documents(read(spark, sf_dir, "supplier").select(F.explode(F.array_compact(F.array(*each))).alias("f")).select("f.*"), root)
    return root


_SCAN = """WITH n AS (SELECT s_suppkey AS n, 'N' || s_suppkey AS c, s_name AS n_name FROM supplier),
    f AS (SELECT n, c, c AS comp, CASE WHEN n % 2 = 1 THEN c || '.types.ts' ELSE c || '.ts' END AS name, '.ts' AS ext, 'export interface ' || c || 'Props { data: string; on' || n || ': () => void }' || chr(10) AS body FROM n
        UNION ALL SELECT n, c, c, CASE WHEN n % 3 = 1 THEN c || '.tsx' ELSE 'index.tsx' END, '.tsx', 'const ' || c || ': React.FC<' || c || 'Props> = () => <Leaf' || n || ' />; // ' || n_name FROM n WHERE n % 3 > 0
        UNION ALL SELECT n, '', 'flat' || n || '.js', 'flat' || n || '.js', '.js', 'f' FROM n
        UNION ALL SELECT n, c, c, c || '.schema.json', '.json', '{}' FROM n UNION ALL SELECT n, c, c, 'chunks.' || c || '.json', '.json', '[]' FROM n UNION ALL SELECT n, c, c, c || '.full.json', '.json', '{}' FROM n
        UNION ALL SELECT n, '-', 'unknown', n || '.md', '.md', 'm' FROM n)"""
_WALKS = {
    "code": "ext IN ('.ts', '.tsx', '.js')", "flow": "ext IN ('.ts', '.tsx', '.md', '.json')", "tsx": "ext = '.tsx'", "typescript": "ext IN ('.ts', '.tsx')", "types": "name LIKE '%.types.ts'",
    "schema": "name LIKE '%.schema.json'", "full": "name LIKE '%.full.json'", "chunks": "name LIKE 'chunks%'",
}


@query(_SCAN + "\nUNION ALL ".join(f" SELECT '{k}' AS pattern, name AS file_name, comp AS component, ext AS extension, body AS content FROM f WHERE {w}" for k, w in _WALKS.items()))
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[code scan, declarative source, walks by suffix and prefix, pruned folders, paths] A folder that is written first."""
    every = files.scan(spark, _folder(spark, sf_dir), "*")
    kinds = F.array(*(F.when(files.fits(F.col("file_name"), k), F.lit(k)) for k in _WALKS))
    return every.select(F.explode(F.array_compact(kinds)).alias("pattern"), "file_name", "component", "extension", "content")


@query(_SCAN + f""" SELECT 'N' || n || '/Bad.ts' AS file, 'the file is no UTF-8' AS said, (SELECT count(*) FROM f WHERE {_WALKS['code']}) AS good, (SELECT count(*) FROM n WHERE n % 5 = 0) AS bad FROM n WHERE n % 5 = 0""")
def scan_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[files that can't be read are reported beside the good ones, with counts of both, in one pass]"""
    _, bad, n = files.reported(files.scan_all(spark, _folder(spark, sf_dir)), _new_folder(spark, "reported"))
    return bad.select(F.regexp_extract("file_path", "([^/]+/[^/]+)$", 1).alias("file"), F.col("error").alias("said"), F.lit(n["good"]).cast("long").alias("good"), F.lit(n["bad"]).cast("long").alias("bad"))


@query(_SCAN + """, d AS (SELECT DISTINCT n, c FROM f WHERE c LIKE 'N%')
    SELECT d.c AS component, 'export interface ' || d.c || 'Props { data: string; on' || n || ': () => void }' || chr(10) AS types,
        CASE WHEN n % 3 = 0 AND n % 2 = 1 THEN NULL WHEN n % 3 = 1 OR n % 2 = 1 THEN (SELECT body FROM f WHERE f.c = d.c AND ext = '.tsx') ELSE (SELECT body FROM f WHERE f.c = d.c AND ext = '.ts') END AS code FROM d""")
def component_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[component folders, first existing candidate of types and code]"""
    found = files.scan(spark, _folder(spark, sf_dir), "typescript")
    owners = files.component_folders(found)
    one = lambda names, at: files.first_existing(found, owners, names).select("component", F.col("content").alias(at))
    return one(files.TYPES_CANDIDATES, "types").join(one(files.CODE_CANDIDATES, "code"), "component")


@query(_SCAN + " SELECT name AS file_name FROM f WHERE ext IN ('.ts', '.tsx', '.js') AND (n % 2 = 0 OR name LIKE 'flat%')")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[increments by content] Files of odd suppliers were seen before, flat ones with another content."""
    found = files.scan(spark, _folder(spark, sf_dir))
    n = F.regexp_extract("file_path", r"(?:/N|flat)(\d+)", 1).cast("int")
    seen = found.where(n % 2 == 1).select("file_path", F.sha2(F.when(F.startswith("file_name", F.lit("flat")), F.lit("old")).otherwise(F.col("content")), 256).alias("digest"))
    return files.incremental(found, seen).select("file_name")


@query("""WITH n AS (SELECT s_suppkey AS n, 'N' || s_suppkey AS c FROM supplier), s AS (SELECT n, c, n % 3 = 1 OR (n % 3 = 2 AND n % 2 = 1) AS tsx, n % 2 = 0 AS ts FROM n)
    SELECT c AS component, 'property' AS type, 'data' AS name, 'data property of ' || c || ' component.' AS said FROM s
    UNION ALL SELECT c, 'event', 'on' || n, 'Callback function triggered when ' || n || ' occurs in ' || c || '.' FROM s
    UNION ALL SELECT CASE WHEN n % 3 = 1 THEN c ELSE 'index' END, 'render', NULL, CASE WHEN n % 3 = 1 THEN c ELSE 'index' END || ' renders Leaf' || n || ' component in JSX.' FROM s WHERE tsx
    UNION ALL SELECT 'index', 'function', c, 'index contains function ' || c || ': ' || left('const ' || c || ': React.FC<' || c || 'Props> = () => <Leaf' || n || ' />;', 100) FROM s WHERE tsx AND n % 3 = 2""")
def folder_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[schemas and syntax of each component of a folder]"""
    found, _ = rag.component_chunks(spark, _folder(spark, sf_dir))
    return found.select("component", "type", "name", F.coalesce("text", "description").alias("said"))


@query("""SELECT how, p_brand AS component, p_partkey::BIGINT AS ord, p_name AS text FROM part, (VALUES ('rows'), ('json'), ('by component')) v(how)
    UNION ALL SELECT 'array', p_brand, NULL, '[' || string_agg('{"component":"' || p_brand || '","text":"' || p_name || '"}', ',' ORDER BY p_partkey) || ']' FROM part GROUP BY p_brand""")
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[sinks: combined set, JSON, a folder for each component, array documents; JSON sources] Written and read again."""
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("component"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"))
    root = _new_folder(spark, "stores")
    stores.save_rows(rows, f"{root}/rows")
    stores.save_json(rows, f"{root}/json")
    stores.save_by(rows.withColumn("text", F.lit("old")), f"{root}/by", "component")
    stores.save_by(rows, f"{root}/by", "component")
    kinds = {"rows": spark.read.parquet(f"{root}/rows"), "json": stores.json_rows(spark, f"{root}/json", "component string, ord long, text string", lines=True), "by component": spark.read.parquet(f"{root}/by")}
    kinds["array"] = stores.array_documents(rows, "component", ["ord"]).select("component", F.lit(None).cast("long").alias("ord"), F.col("document").alias("text"))
    out = None
    for how, df in kinds.items():
        df = df.select(F.lit(how).alias("how"), "component", "ord", "text")
        out = df if out is None else out.unionByName(df)
    return out


@query("""SELECT 'N' || s_suppkey AS component, 'chunk' AS item_type, 'c' || i || ' ' || s_name AS text, 1.5::DOUBLE + i AS first FROM supplier, range(2) t(i)
    UNION ALL SELECT 'N' || s_suppkey, 'component', 'whole ' || s_name, s_suppkey::DOUBLE FROM supplier""")
def vector_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[vector store of chunk files, each an array, and component files, each an object; chunk-set JSON]"""
    root, n = _new_folder(spark, "vectors"), F.col("s_suppkey")
    name = F.concat(F.lit("N"), n)
    chunk = lambda i: F.struct(name.alias("component"), F.lit("chunk").alias("type"), F.concat(F.lit(f"c{i} "), "s_name").alias("text"), F.array(F.lit(1.5 + i), F.lit(2.0)).alias("embedding"))
    whole = F.struct(name.alias("component"), F.concat(F.lit("whole "), "s_name").alias("text"), F.array(n).alias("embedding"))
    at = lambda odd, even: F.when(n % 2 == 1, F.format_string(odd, n)).otherwise(F.format_string(even, n))
    files_ = F.array(F.struct(at("a/embedded.N%s.json", "b/N%s.embedded.json").alias("path"), F.to_json(F.array(chunk(0), chunk(1))).alias("document")), F.struct(at("a/component.N%s.json", "b/N%s.component.json").alias("path"), F.to_json(whole).alias("document")))
    folders.save_documents(read(spark, sf_dir, "supplier").select(F.explode(files_).alias("f")).select("f.*"), root)
    return stores.vector_store(spark, root).select("component", "item_type", "text", F.element_at("embedding", 1).alias("first"))


@query(_SCAN + """ SELECT c AS component, 'components/' || c || '/' || CASE WHEN n % 3 = 1 THEN c ELSE 'index' END || '.full.json' AS path, '["Leaf' || n || '"]' AS tags FROM n WHERE n % 3 > 0""")
def component_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[a document for each component, beside its source, all or nothing] The record of each TSX file, written and read again."""
    root = _folder(spark, sf_dir)
    found = files.scan(spark, root, "tsx")
    records = extract.records(ts_nodes(found))
    below = F.substring("file", len(files.plain_path(root)) + 2, 1 << 20)
    folders.save_documents(records.select(F.regexp_replace(below, "[.]tsx$", ".full.json").alias("path"), F.to_json(F.struct(*records.columns)).alias("document")), root)
    written = files.scan(spark, root, "full").where("content <> '{}'").withColumn("held", F.from_json("content", "jsxUsage array<string>"))
    return written.select("component", F.regexp_extract("file_path", "(components/.*)$", 1).alias("path"), F.to_json("held.jsxUsage").alias("tags"))


# ---------------------------------------------------------------- streams


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[windows of a stream] The events as a stream of files, all that is there now, its last state written as a table."""
    events = read(spark, sf_dir, "events")
    root = _new_folder(spark, "windows")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet" + ("" if _is_folder(spark, f"{sf_dir}/events.parquet") else "*"))
    live = streams.windowed_counts(stream, watermark=None)
    live.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


@query(_SCAN + " SELECT comp AS component, name AS file_name, CASE WHEN n = 1 AND name = 'N1.tsx' THEN 'later' ELSE replace(body, chr(10), chr(13) || chr(10)) END AS content FROM f WHERE ext IN ('.ts', '.tsx', '.js')")
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[source files that arrive, merged by name] One file comes again with another content."""
    root, out = _folder(spark, sf_dir), _new_folder(spark, "arrived")
    for again in (False, True):
        if again:
            folders.save_documents(spark.createDataFrame([("new/components/N1/N1.tsx", "later")], "path string, document string"), root)
        arriving = streams.arriving_files(spark, root).where(~F.col("file_path").rlike("/(dist|node_modules|__pycache__)/"))
        streams.keep_latest(arriving, f"{out}/table", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("component", "file_name", "content")


@query(_SCAN + " SELECT comp AS component, name AS file_name, CASE WHEN name = 'N1.tsx' THEN 'Later' ELSE 'Leaf' || n END AS tags FROM f WHERE ext = '.tsx'")
def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[records that follow their files] Components of files that arrive; the query is started again when one has changed."""
    root, out = _folder(spark, sf_dir), _new_folder(spark, "records")
    for again in (False, True):
        if again:
            folders.save_documents(spark.createDataFrame([("new/components/N1/N1.tsx", "const N1 = () => <Later />;")], "path string, document string"), root)
        arriving = streams.arriving_files(spark, root, "tsx").where(~F.col("file_path").rlike("/(dist|node_modules|__pycache__)/"))
        streams.keep_latest(arriving, f"{out}/table", f"{out}/state", make=streams.component_rows).awaitTermination()
    return spark.read.parquet(f"{out}/table").select("component", "file_name", js.joined(F.col("jsxUsage"), ",").alias("tags"))
