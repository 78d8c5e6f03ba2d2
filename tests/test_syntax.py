import os
import subprocess
import sys

import pytest
from hypothesis import given, settings, strategies as st

from loam.syntax.nodes import node_rows, register, ts_nodes
from loam.syntax.parser import SyntaxProblem, nodes_of


def found(text, *kinds, jsx=True):
    return [n.name for n in nodes_of(text, jsx) if n.kind in kinds]


def test_imports():
    text = 'import D, { A as B, type T, useState } from "x"; import * as N from "n"; import "side"; import type { Q } from "q"\nconst a = import("y");'
    assert found(text, "ImportSpecifier") == ["B", "T", "useState", "Q"]


def test_declarations_and_functions():
    text = """export default function Main<T>(p: { f: (x: number) => void }): (y: string) => void { return (y) => { } }
const a = 1, b = (x: number): x is 5 => x, c = async <T,>(y: T) => await y, d = function named() { const inner = () => 1; };
let e: (z: number) => string = useThing<Array<() => void>>(1);
const f = React.useState(2)
const g = useState<string[]>([])[0]
for (const h of list) { }
const [i, setI] = useState(() => 3)
class K { m() { const j = () => 4 } n = () => 5 }
const k = cond ? (x) : y => y;
"""
    assert found(text, "FunctionDeclaration") == ["Main"]
    kinds = {n.name: (n.extra["init_kind"], n.extra["callee"]) for n in nodes_of(text) if n.kind == "VariableDeclaration"}
    assert kinds["a"] == ("Other", None) and kinds["b"][0] == kinds["c"][0] == kinds["inner"][0] == kinds["j"][0] == "ArrowFunction"
    assert kinds["d"] == ("FunctionExpression", None) and kinds["e"] == ("CallExpression", "useThing") and kinds["f"] == ("CallExpression", "React.useState")
    assert kinds["g"] == ("Other", None) and kinds["h"] == ("None", None) and kinds["[i, setI]"] == ("CallExpression", "useState")


def test_statement_texts_and_offsets():
    text = "// lead\nexport const A = () => 1, B = 2;\n\n/* c */ let C\nconst D = 4\n"
    statements = [n for n in nodes_of(text) if n.kind == "VariableStatement"]
    assert [text[n.start : n.end] for n in statements] == ["export const A = () => 1, B = 2;", "let C", "const D = 4"]
    assert [n.pos for n in statements] == [0, 40, 55]


def test_jsx_strings_templates_and_regular_expressions():
    text = """const a = <A.B c="}" d={`x${<E f={() => '<G />'} />}`}>it's // no comment {/* <No /> */} {x < y && <H />} <>t<I></I></></A.B>;
const r = /<J \\/>[/]/g.test(s) ? a / b / c : "<K />"; // <L />
const t = x as Array<string>; const u = <T extends object>(v: T) => v; const w = a < b;"""
    assert found(text, "JsxOpening", "JsxSelfClosing") == ["A.B", "E", "H", "I"]
    assert found(text, "VariableDeclaration") == ["a", "r", "t", "u", "w"]
    assert found("const x = <string>y; const z = <T>(a: T) => a;", "VariableDeclaration", jsx=False) == ["x", "z"]


def test_interfaces():
    text = """/** Doc of it.
 * More. @x no */
export interface A<T> extends B, C<D> { /** one */ readonly a?: string | number; f(x: number): void; g: () => Array<T>
  [key: string]: any; "q-r": { s: 1 }, readonly: boolean }
namespace N { interface Inner { z: 1 } }"""
    nodes = nodes_of(text)
    heads = [(n.name, n.extra["extends"], n.extra["top"]) for n in nodes if n.kind == "InterfaceDeclaration"]
    assert heads == [("A", ["B", "C<D>"], True), ("Inner", [], False)]
    members = [(n.name, n.extra["type"], n.extra["optional"], n.extra["doc"]) for n in nodes if n.kind == "PropertySignature"]
    assert members[:3] == [("a", "string | number", True, "one"), ("f", "(x: number): void", False, None), ("g", "() => Array<T>", False, None)]
    assert [m[0] for m in members[3:]] == ["q-r", "s", "readonly", "z"]
    owners = {n.name: n.extra["owner"] for n in nodes if n.kind == "PropertySignature"}
    assert owners["s"] == "A.q-r" and owners["z"] == "Inner" and [n.extra["owner"] for n in nodes if n.kind == "IndexSignature"] == ["A"]


def test_aliases_enumerations_and_modules():
    nodes = nodes_of('import { A as B } from "./k"; import D from "d";\nenum C { X = "x", Y = 3, Z }\ndeclare const enum E { P }\ntype T<Q> = { a: Q };\nswitch (x) { case 1: f(() => 2); default: g() }', False)
    said = {(n.kind, n.name): n.extra for n in nodes}
    assert said["ImportSpecifier", "B"] == {"imported": "A", "module": "./k"}
    assert said["EnumDeclaration", "C"]["type"] == '"x" | 3 | 4' and said["EnumDeclaration", "E"]["type"] == "0"
    assert said["TypeAlias", "T"]["type"] == "{ a: Q }" and said["PropertySignature", "a"]["owner"] == "T" and ("ArrowFunction", None) in said


def test_functions_inside_elements():
    text = "const A = () => <Ü v={() => 1} w={{ f: () => 2 }}>{xs.map((x) => <Y k={x} {...rest} />)}</Ü>;"
    assert [text[n.start : n.end] for n in nodes_of(text) if n.kind == "ArrowFunction"][1:] == ["() => 1", "() => 2", "(x) => <Y k={x} {...rest} />"]
    assert found(text, "JsxOpening", "JsxSelfClosing") == ["Ü", "Y"]


@pytest.mark.parametrize("text", ["const a = (", "<A></B>", "'open", "`${", "const x = <A", "}"])
def test_what_cannot_be_parsed_is_said(text):
    with pytest.raises(SyntaxProblem):
        nodes_of(text)
    (row,) = node_rows("f.tsx", text)
    assert row[3] == "Error" and row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["const ", "a", " = ", "(", ")", " => ", "{", "}", "<A />", "`", "${", "'", "/", ";", "\n", "interface ", ":", ",", "[", "]", "import ", "return ", "?", "<", ">", "type "]), max_size=25))
def test_any_text_gives_rows(parts):
    rows = node_rows("f.tsx", "".join(parts))
    assert all(r[6] <= r[7] for r in rows)


ODD = ["interface Foo\nfoo();\n", "interface Foo\n<<<<<<< ours\n{\n a: string }\n", "interface A { m<(a) }", "interface A { m< }", "for await x", "enum", "class", "interface A extends", "import {", "type A<"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_end(text):
    rows = node_rows("f.ts", text)
    assert rows and all(r[6] <= r[7] for r in rows)


def test_random_texts_end_in_bounded_memory():
    """100,000 random texts in a process of its own, with a limit of memory and of time."""
    code = """
import random, resource
resource.setrlimit(resource.RLIMIT_AS, (1 << 30, 1 << 30))
from loam.syntax.nodes import node_rows
parts = %r
dice = random.Random(3)
for k in range(100_000):
    text = "".join(dice.choices(parts, k=dice.randint(1, 18)))
    assert len(node_rows("f.tsx" if k %% 2 else "f.ts", text)) <= 4 * len(text) + 1, text
""" % ["const ", "a", " = ", "(", ")", " => ", "{", "}", "<A />", "`", "${", "'", "/", ";", "\n", "interface ", "I ", ":", ",", "[", "]", "import ", "return ", "?", "<", ">", "type ", "enum ", "class ", "extends ", "for ", "function ", "async ", "await ", "case ", "export ", "default ", "=", ".", "|", "readonly ", "1"]
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_table_and_table_function(spark):
    files = spark.createDataFrame([("a.tsx", "const A = () => <B />;"), ("b.ts", None), ("c.tsx", "const ("), ("d.tsx", "")], "file_path string, content string")
    rows = ts_nodes(files).orderBy("file", "node_id").collect()
    assert [(r.file, r.node_id, r.parent_id, r.kind) for r in rows] == [("a.tsx", 0, None, "SourceFile"), ("a.tsx", 1, 0, "VariableStatement"), ("a.tsx", 2, 1, "VariableDeclaration"), ("a.tsx", 3, 2, "ArrowFunction"), ("a.tsx", 4, 3, "JsxSelfClosing"), ("b.ts", 0, None, "SourceFile"), ("c.tsx", 0, None, "Error"), ("d.tsx", 0, None, "SourceFile")]
    register(spark)
    files.createOrReplaceTempView("files")
    assert spark.sql("select n.kind from files, lateral ts_nodes(file_path, content) n where file_path = 'a.tsx'").count() == 5
    assert [r[3] for r in node_rows("x.tsx", "<" * 3000)] == ["SourceFile"]
