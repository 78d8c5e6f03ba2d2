"""Source files of many shapes, one for each part, and what the extraction rules say of each: a table by shape, worked out
by hand. {k}, {z} and {t} stand for a part's key, size and type, in the sources and in what is expected of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loam.plans.tables import read


@dataclass
class Shape:
    source: str
    dependencies: str = ""
    tags: str = ""
    internal: str = ""
    state: str = ""
    functions: str = ""
    #: What the loose rules say where it differs.
    loose: dict | None = None
    #: The last component, and the last interface of the file.
    last: str | None = None
    interface: str = ""
    #: Functions, arrow functions and variable statements.
    chunks: tuple = ()


SHAPES = (
    Shape(
        'import React, { useState } from "react";\nimport Card, { Link as Go, type Props } from "./kit";\nexport const S{k} = ({ a }: Props) => <Card><Go to="{t}" /></Card>;\n',
        "Go,Props", "Card,Go", last="S{k}",
        chunks=('export const S{k} = ({ a }: Props) => <Card><Go to="{t}" /></Card>;', '({ a }: Props) => <Card><Go to="{t}" /></Card>'),
    ),
    Shape(
        'import { useState } from "react";\nimport * as Icons from "icons";\nexport default function S{k}() {\n  const [n, setN] = useState<number[]>([{z}]);\n  const bump = () => setN([...n, {z}]);\n  return <Icons.Plus onClick={bump} />;\n}\n',
        "", "Icons.Plus", "", "[n, setN] = useState<number[]>([{z}])", "bump|const bump = () => setN([...n, {z}]);", last="bump",
        chunks=(
            "export default function S{k}() {\n  const [n, setN] = useState<number[]>([{z}]);\n  const bump = () => setN([...n, {z}]);\n  return <Icons.Plus onClick={bump} />;\n}",
            "const [n, setN] = useState<number[]>([{z}]);", "const bump = () => setN([...n, {z}]);", "() => setN([...n, {z}])",
        ),
    ),
    Shape(
        '// <Fake /> {t}\nconst S{k} = () => {\n  const [a] = React.useState({z}); const [b] = useState(); const [c] = useState("x");\n  return <><A/>{a ? <B c={b}/> : <div/>}<A/></>;\n};\n',
        "", "A,B", "", '[b] = useState()#[c] = useState("x")',
        loose={"state": 'S{k} = () => {\n  const [a] = React.useState({z}); const [b] = useState(); const [c] = useState("x");\n  return <><A/>{a ? <B c={b}/> : <div/>}<A/></>;\n}#[a] = React.useState({z})#[b] = useState()#[c] = useState("x")'},
        last="S{k}",
        chunks=(
            'const S{k} = () => {\n  const [a] = React.useState({z}); const [b] = useState(); const [c] = useState("x");\n  return <><A/>{a ? <B c={b}/> : <div/>}<A/></>;\n};',
            '() => {\n  const [a] = React.useState({z}); const [b] = useState(); const [c] = useState("x");\n  return <><A/>{a ? <B c={b}/> : <div/>}<A/></>;\n}',
            "const [a] = React.useState({z});", "const [b] = useState();", 'const [c] = useState("x");',
        ),
    ),
    Shape(
        "const S{k} = () => <Row />;\nconst Row = () => <Cell v={() => {z}} />;\nconst Cell = ({ v }) => <td>{v()}</td>;\nconst _hidden = () => null, $fmt = (x) => x;\nconst plain = {z};\n",
        "", "Row,Cell", "Row,Cell,_hidden,$fmt", "",
        "Row|const Row = () => <Cell v={() => {z}} />;#Cell|const Cell = ({ v }) => <td>{v()}</td>;#_hidden|const _hidden = () => null, $fmt = (x) => x;#$fmt|const _hidden = () => null, $fmt = (x) => x;",
        loose={"internal": "Row,Cell,_hidden", "functions": "Row|const Row = () => <Cell v={() => {z}} />;#Cell|const Cell = ({ v }) => <td>{v()}</td>;#_hidden|const _hidden = () => null, $fmt = (x) => x;"},
        last="$fmt",
        chunks=(
            "const S{k} = () => <Row />;", "() => <Row />", "const Row = () => <Cell v={() => {z}} />;", "() => <Cell v={() => {z}} />", "() => {z}", "const Cell = ({ v }) => <td>{v()}</td>;",
            "({ v }) => <td>{v()}</td>", "const _hidden = () => null, $fmt = (x) => x;", "() => null", "(x) => x", "const plain = {z};",
        ),
    ),
    Shape(
        'import { api as client, IThing } from "../api";\nexport class S{k} extends Base<{ a: string }> {\n  load = async () => { const get = async (u) => await client(`/${u}/{z}`); return get("{t}"); };\n  render() { return <List items={[1, 2].map((i) => <Item key={i} />)} />; }\n}\n',
        "client,IThing", "List,Item", "", "", "get|const get = async (u) => await client(`/${u}/{z}`);", loose={"dependencies": "client"}, last="get",
        chunks=('async () => { const get = async (u) => await client(`/${u}/{z}`); return get("{t}"); }', "const get = async (u) => await client(`/${u}/{z}`);", "async (u) => await client(`/${u}/{z}`)", "(i) => <Item key={i} />"),
    ),
    Shape(
        'import { memo, forwardRef } from "react";\nconst Inner{z} = memo(() => <p>{t}</p>);\nconst S{k} = forwardRef((props, ref) => <Inner{z} ref={ref} />);\n',
        "memo,forwardRef", "Inner{z}", loose={"internal": "Inner{z}", "functions": "Inner{z}|const Inner{z} = memo(() => <p>{t}</p>);"},
        chunks=("const Inner{z} = memo(() => <p>{t}</p>);", "() => <p>{t}</p>", "const S{k} = forwardRef((props, ref) => <Inner{z} ref={ref} />);", "(props, ref) => <Inner{z} ref={ref} />"),
    ),
    Shape(
        "const re = /<Not \\/>[{z}]/g;\nconst s = \"<Nor />\" + '<This {t} />' + `<${re}>`;\nconst S{k} = (): JSX.Element => (cond ? <Yes a=\"<No />\">it's {s} &lt;b&gt;</Yes> : null);\n",
        "", "Yes", last="S{k}",
        chunks=(
            "const re = /<Not \\/>[{z}]/g;", "const s = \"<Nor />\" + '<This {t} />' + `<${re}>`;",
            "const S{k} = (): JSX.Element => (cond ? <Yes a=\"<No />\">it's {s} &lt;b&gt;</Yes> : null);", "(): JSX.Element => (cond ? <Yes a=\"<No />\">it's {s} &lt;b&gt;</Yes> : null)",
        ),
    ),
    Shape('export interface S{k}Props { size: "{z}"; onPick?: (e: Event) => void }\nexport type Kind = "a" | "b";\nexport enum Level { Low = {z}, High }\n'),
    Shape(""),
    Shape("/* {t} <Ghost /> */"),
    Shape("foo({z});"),
    Shape(
        "// \U0001f525 {t}\nconst pick = <T,>(xs: T[]): T => xs[{z}];\nfunction Über() { return <Überschrift größe={{z}} />; }\ninterface ÜberProps { a: {z} }\ninterface Last{z} { b: string }\n",
        "", "Überschrift", "", "", "pick|const pick = <T,>(xs: T[]): T => xs[{z}];", last="Über", interface="Last{z}",
        chunks=("const pick = <T,>(xs: T[]): T => xs[{z}];", "<T,>(xs: T[]): T => xs[{z}]", "function Über() { return <Überschrift größe={{z}} />; }"),
    ),
    Shape(
        'import { One, Two, Three } from "x";\nconst far = (a) => { return a + "{t}" + "01234567890123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890123456789"; };\nexport default () => <One><Two/><div/><Three/><Four/><Two/><Five/><Six/></One>;\n',
        "One,Two,Three", "One,Two,Three,Four,Five,Six", "", "", 'far|const far = (a) => { return a + "{t}" + "01234567890123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890123456789"; };', last="far",
        chunks=(
            'const far = (a) => { return a + "{t}" + "01234567890123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890123456789"; };', '(a) => { return a + "{t}" + "01234567890123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890123456789"; }',
            "() => <One><Two/><div/><Three/><Four/><Two/><Five/><Six/></One>",
        ),
    ),
)


def filled(text: Column) -> Column:
    for mark, column in (("{k}", "p_partkey"), ("{z}", "p_size"), ("{t}", "p_type")):
        text = F.replace(text, F.lit(mark), F.col(column).cast("string"))
    return text


def by_shape(texts: list[str], modulus: int | None = None) -> Column:
    """The text of each part's shape, filled."""
    return filled(F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % (modulus or len(texts)) + 1).cast("int")))


def shape_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, content: a file for each part, of one shape after the other."""
    return read(spark, sf_dir, "part").select(F.format_string("src/components/S%s/S%s.tsx", "p_partkey", "p_partkey").alias("file_path"), by_shape([s.source for s in SHAPES]).alias("content"))


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_filled(text: str) -> str:
    return f"replace(replace(replace({text}, '{{k}}', p_partkey::VARCHAR), '{{z}}', p_size::VARCHAR), '{{t}}', p_type)"


def sql_by_shape(texts: list[str | None]) -> str:
    """The same in SQL: the text of each part's shape, filled."""
    return sql_filled(f"([{', '.join('NULL' if t is None else sql_text(t) for t in texts)}])[p_partkey % {len(texts)} + 1]")


def sql_lists_by_shape(texts: list[tuple]) -> str:
    """A row for each text of each part's shape, filled."""
    lists = ", ".join(f"[{', '.join(map(sql_text, held))}]::VARCHAR[]" for held in texts)
    return f"unnest(list_transform(([{lists}])[p_partkey % {len(texts)} + 1], lambda x: {sql_filled('x')}))"
