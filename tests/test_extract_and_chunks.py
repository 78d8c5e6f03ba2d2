from pyspark.sql import functions as F

from loam.operators import chunks, extract, schema, scopes
from loam.plans import catalogue
from loam.syntax.nodes import ts_nodes

PANEL = """import React, { useState } from "react";
import Card from "./Card";
import { IPanelProps, Button as Push } from "./kit";

/** Panel. 🔥 */
export const Panel: React.FC<IPanelProps> = ({ title }) => {
    const [open, setOpen] = useState<boolean>(false);
    const [n, setN] = React.useState(0);
    const toggle = () => setOpen(!open);
    return <section><Title text={title} /><Push onClick={toggle}>x</Push><Title /><Card /></section>;
};
const Title = ({ text }) => <h1>{text}</h1>;
const _low = () => 1;
export default Panel;
"""
NODE = """interface Props { node: Item; onToggle: (id: string) => void }
const Node: React.FC<Props> = ({ node }) => <li><Node node={node} /></li>;"""
FILES = [("r/components/Panel/Panel.tsx", PANEL), ("r/components/Node/Node.tsx", NODE), ("r/components/Panel/Panel.types.ts", "export interface NodeProps { a: string }")]


def nodes(spark, rows=FILES):
    return ts_nodes(spark.createDataFrame(rows, "file_path string, content string"))


def test_records(spark):
    got = {r.component: r for r in extract.records(nodes(spark)).collect()}
    p = got["Panel"]
    assert p.dependencies == ["IPanelProps", "Push"] and p.jsxUsage == ["Title", "Push", "Card"] and p.internalComponents == ["Title", "_low"]
    assert [s.code for s in p.state] == ["[open, setOpen] = useState<boolean>(false)"]
    assert [f.name for f in p.functions] == ["toggle", "Title", "_low"] and p.functions[2].code == "const _low = () => 1;"
    assert got["Node"].jsxUsage == ["Node"] and got["Node"].functions == [] and got["Panel.types.ts"].dependencies == []


def test_loose_records(spark):
    got = {r.component: r for r in extract.loose_records(nodes(spark)).collect()}
    assert got["Panel"].dependencies == ["Push"] and len(got["Panel"].state) == 3 and [f.name for f in got["Panel"].functions] == ["toggle", "Title", "_low"]


def test_front_ends(spark):
    n = nodes(spark)
    of = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert of(extract.front_ends(n), "parser", "component", "propsInterface")[:4] == [("babel", "Node", "Props"), ("babel", "_low", ""), ("tree-sitter", "Node", None), ("tree-sitter", "_low", None)]
    assert of(extract.front_ends(n).where("parser = 'typescript'"), "component", "propsInterface") == [("Node", "NodeProps"), ("_low", "")]
    assert of(extract.interfaces(n), "interface", "ord") == [("NodeProps", 0), ("Props", 0)]
    docs = {r.componentName: r.doc for r in extract.documented_components(n).collect()}
    assert '"name":"onToggle"' in docs["Node"] and "Panel" in docs


def test_props_of_each_file_are_its_own(spark):
    view = 'const {0}: React.FC<Props> = () => <i />;'
    rows = [("r/A.tsx", "interface Props { x: string }\n" + view.format("A")), ("r/B.tsx", "interface Props { y: string }\n" + view.format("B")), ("r/C.tsx", view.format("C"))]
    rows += [("r/u/D.tsx", 'import { Q as Props } from "../t";\n' + view.format("D")), ("r/t/index.ts", "export interface Q { z: string }"), ("r/E.tsx", 'import { Props } from "react";\n' + view.format("E"))]
    got = {r.componentName: r.doc for r in extract.documented_components(nodes(spark, rows)).collect()}
    assert "x" in got["A"] and '"y"' not in got["A"] and '"y"' in got["B"] and '"z"' in got["D"]
    assert got["C"] == '{"displayName":"C"}' and got["E"] == '{"displayName":"E"}'
    empty = extract.records(nodes(spark, [("r/X.tsx", ""), ("r/Y.tsx", "// c"), ("r/Z.tsx", "foo();"), ("r/W.tsx", None)])).collect()
    assert sorted(r.component for r in empty) == ["W", "X", "Y", "Z"] and all(r.functions == [] and r.dependencies == [] for r in empty)


def test_chunks_of_source(spark):
    rows = extract.ast_chunks(nodes(spark)).where("file like '%Node.tsx'").orderBy("node_id").collect()
    assert [(r.id, r.text[:10]) for r in rows] == [("Node.tsx_62", "const Node"), ("Node.tsx_92", "({ node })")]
    found = extract.pattern_chunks(spark.createDataFrame(FILES, "file_path string, content string")).collect()
    assert sorted((r.id, r.text[-8:]) for r in found) == [("Node", "{ node }"), ("Panel", " title }")]


RECORD = "component string, file string, schema map<string,string>, dependencies array<struct<name:string,schema:string>>, jsxUsage array<string>, internalComponents array<string>, state array<struct<code:string>>, functions array<struct<name:string,code:string>>"


def test_rag_chunks(spark):
    props = '{"properties":{"a":{"type":["string","number"]},"onChange":{"type":"x"},"b":{"$ref":"#/d/B"},"c":{},' + ",".join(f'"p{i}":{{}}' for i in range(12)) + "}}"
    rows = [("X", "f", {"D": props}, [("A", None), ("", None), (None, None)], ["div", "T", "_u", "V", "W", "Y", "Z"], ["T"], [("s" * 201,), ("🔥" * 200,)], [("T", ""), ("go", "")]), ("E", None, None, [], [], [], [], []), ("N",) + (None,) * 7]
    got = {}
    for r in chunks.rag_chunks(spark.createDataFrame(rows, RECORD)).orderBy("component", "ord").collect():
        got.setdefault(r.component, []).append((r.type, r.text))
    assert got["X"] == [
        ("overview", "X is a UI component composed of T that manages state."), ("props", "X accepts props: a (string,number), b (ref), c, p0, p1, p2, p3, p4, p5, p6"), ("dependencies", "X depends on: A"),
        ("composition", "X is composed of: T"), ("render_flow", "X renders T, _u, V, W, Y"), ("state", "X manages state: " + "s" * 200 + "..."), ("state", "X manages state: " + "🔥" * 200),
        ("subcomponent", "T is a reusable UI subcomponent"), ("function_summary", "go is a helper logic function"), ("example", "<T />"), ("example", "<X />"),
    ]
    assert got["E"] == got["N"][:0] + [("overview", "E is a UI component."), ("example", "<E />")] and len(got["N"]) == 2


def test_knowledge_and_props(spark):
    rec = extract.records(nodes(spark)).where("component = 'Node'")
    assert [(r.type, r.text) for r in chunks.knowledge_chunks(rec).collect()] == [("render", "Node renders Node component in JSX.")]
    entries = spark.createDataFrame([("B", 0, [("x", "string"), ("y", "enum")]), ("B", 1, None), ("B", 2, [("z", None)]), ("C", 0, None)], "component string, ord int, properties array<struct<name:string,type:string>>")
    assert [r.text for r in chunks.component_props(entries).collect()] == ["B component props x string y enum z"]
    texts = spark.createDataFrame([(" [1]",), ("{}",), (None,)], "content string")
    assert chunks.array_schemas(texts).count() == 1


def test_cleaning(spark):
    text = 'import React, { M } from "react";\nexport interface A extends B {\n x: MouseEvent<H>; a?: A[]; p: Partial<A> }\nexport interface A { }\nexport interface B { y: A; z: B }'
    rows = schema.cleaned(spark.createDataFrame([(text,), ("export interface Q { y: Q }",), (None,)], "content string")).collect()
    assert rows[0].content == "\nexport interface A1 extends B1 {\n x: any; a?: A1[]; p: Partial<A1> }\nexport interface A2 { }\nexport interface B1 { y: A1; z: B1 }"
    assert rows[1].content == "export interface Q { y: Q }" and rows[2].content is None
    assert spark.range(1).select(schema.without_heads(F.lit("interface A extends B<C>, D { x }"))).first()[0] == "interface A { x }"


def test_retry_without_heads(spark):
    files = spark.createDataFrame([("a.ts", "export interface A extends B<`> { x: string }"), ("b.ts", "export interface B extends C { y: A }"), ("c.ts", "const (")], "file_path string, content string")
    got = sorted((r.file, r.kind, r.name) for r in schema.nodes_or_retry(files).where("kind <> 'SourceFile'").collect())
    assert got == [("a.ts", "InterfaceDeclaration", "A"), ("a.ts", "PropertySignature", "x"), ("b.ts", "InterfaceDeclaration", "B"), ("b.ts", "PropertySignature", "y"), ("c.ts", "Error", None)]


def test_schemas_from_source(spark):
    text = 'export interface TProps extends Base, Omit<X, "y"> { /** Doc "q". */ data: Item[]; kind?: "a" | "b"; either: string | number; onGo: () => void; deep: { z: 1 } }\ninterface Item { id: string; children?: Item[] }'
    n = nodes(spark, [("T.types.ts", text)])
    docs = schema.schema_documents(n).select(F.lit("T").alias("component"), "schema")
    rows = {(r.definition, r.name): r for r in schema.schema_chunks(docs).collect()}
    assert rows["TProps", "data"].dataType == "Item[]" and rows["TProps", "data"].linksTo == "Item" and rows["TProps", "data"].description == 'Doc "q".'
    assert rows["TProps", "kind"].enum == ["a", "b"] and rows["TProps", "either"].dataType == "string,number" and rows["TProps", "onGo"].signature == "() => void"
    assert rows["Item", "children"].isSubType and not rows["TProps", "data"].isSubType and len(rows) == 7
    one = schema.selected(schema.exploded_definitions(docs)).collect()
    assert [(r.component, r.definition) for r in one] == [("T", "TProps")]
    held = scopes.symbols(n)
    tree = {(r.root, r.path) for r in scopes.trees(held).collect()}
    assert ("TProps", "data.children") in tree and ("TProps", "data.children.id") not in tree and ("Item", "children") in tree
    last = scopes.last_trees(held).select("root").distinct().collect()
    assert [r.root for r in last] == ["Item"]


def test_records_with_schemas(spark):
    rec = extract.records(nodes(spark))
    got = {r.component: r for r in schema.with_schemas(rec, spark.createDataFrame([("Panel", "{P}"), ("Push", "{B}")], "component string, schema string")).collect()}
    assert got["Panel"].schema == "{P}" and [(d.name, d.schema) for d in got["Panel"].dependencies] == [("IPanelProps", None), ("Push", "{B}")]
    assert got["Node"].schema is None and got["Node"].dependencies == []


def test_documents_without_definitions(spark):
    docs = spark.createDataFrame([("A", "{}"), ("B", None), ("C", "nonsense"), ("D", '{"definitions":{"X":{}}}')], "component string, schema string")
    assert schema.schema_chunks(docs).collect() == []


def test_records_meet_their_schemas_by_shuffles(spark):
    plan = catalogue.QUERIES["merged_rag_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
