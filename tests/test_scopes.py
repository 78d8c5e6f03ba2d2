"""Types by scope: names of other files, barrels, inheritance, circles; and that sources are read once."""

import uuid

import pytest

from loam.operators import extract, scopes
from loam.plans import catalogue
from loam.syntax.nodes import ts_nodes

FILES = [
    ("a.types.ts", 'import { Far as F1, Lost } from "./i1";\nexport interface Props { x: string; f: F1; o: Other; l: Lost }\ninterface Other { own: 1 }'),
    ("b.types.ts", 'import F1 from "./d";\nexport interface Props extends F1, Gone<Other> { y: Other }\ninterface Other { w: string; z: Props }'),
    ("i1.ts", 'export * from "./i2";'), ("i2/index.ts", 'export * from "../i3";\nexport * from "../nowhere";'), ("i3.ts", 'import { Deep } from "./d";\nexport { Deep as Far };\nexport * from "./i1";'),
    ("d.ts", "export interface Deep extends Up { n: number }\ninterface Up { up: { in: Up2 } }\ntype Up2 = Deep;\nexport default Deep;"),
    ("empty.ts", ""), ("bad.ts", "interface ("), ("null.ts", None),
]


def held(spark, files=FILES):
    return scopes.symbols(ts_nodes(spark.createDataFrame(files, "file_path string, content string")))


def test_names_mean_what_their_file_says(spark):
    got = {(r.file, r.name): (r.to_file, r.to_name) for r in scopes.scope(held(spark)).collect()}
    assert got["a.types.ts", "F1"] == got["b.types.ts", "F1"] == ("d.ts", "Deep") and ("a.types.ts", "Lost") not in got
    assert got["a.types.ts", "Other"] == ("a.types.ts", "Other") and got["b.types.ts", "Props"] == ("b.types.ts", "Props")


def test_trees_of_files_with_the_same_names(spark):
    paths = {}
    for r in scopes.trees(held(spark)).collect():
        paths.setdefault((r.file, r.root), set()).add(r.path)
    assert paths["a.types.ts", "Props"] == {"x", "f", "f.n", "f.up", "f.up.in", "o", "o.own", "l"} | {f"f.up.in.{p}" for p in ("n", "up")}
    assert paths["b.types.ts", "Props"] == {"y", "y.w", "y.z", "n", "up", "up.in", "up.in.n", "up.in.up"}
    assert paths["a.types.ts", "Other"] == {"own"} and paths["b.types.ts", "Other"] == {"w", "z", "z.y", "z.n", "z.up", "z.up.in", "z.up.in.n", "z.up.in.up"}
    last = {(r.file, r.root) for r in scopes.last_trees(held(spark)).collect()}
    assert last == {("a.types.ts", "Other"), ("b.types.ts", "Other"), ("d.ts", "Up")}


def test_members_in_order_and_without_declarations(spark):
    h = held(spark)
    rows = scopes.properties(h, scopes.scope(h)).where("file = 'b.types.ts' and owner = 'Props'").orderBy("place").collect()
    assert [(r.name, r.in_file, r.in_owner) for r in rows] == [("y", "b.types.ts", "Props"), ("n", "d.ts", "Deep"), ("up", "d.ts", "Up")]
    none = held(spark, [("e.ts", ""), ("f.ts", 'import { A } from "./g"; export * from "./f";')])
    assert scopes.trees(none).collect() == [] and scopes.last_trees(none).collect() == []


def test_a_barrel_that_many_files_import(spark):
    files = [(f"u{i}.ts", f'import {{ T{i % 3} as T }} from "./all";\nexport interface Props {{ t: T; k{i}: 1 }}') for i in range(60)]
    files += [("all.ts", 'export * from "./t0";\nexport * from "./t1";\nexport * from "./t2";'), *((f"t{i}.ts", f"export interface T{i} {{ v{i}: 1 }}") for i in range(3))]
    got = {(r.file, r.path) for r in scopes.trees(held(spark, files)).where("root = 'Props'").collect()}
    assert got == {(f"u{i}.ts", p) for i in range(60) for p in ("t", f"k{i}", f"t.v{i % 3}")}


def test_each_file_is_read_once(spark, tmp_path):
    mark = str(tmp_path)

    def counted(batches):
        for b in batches:
            for name in b.column("file_path").to_pylist():
                open(f"{mark}/{name.replace('/', '_')}-{uuid.uuid4().hex}", "w").close()
            yield b

    files = spark.createDataFrame(FILES, "file_path string, content string").mapInArrow(counted, "file_path string, content string")
    scopes.trees(scopes.symbols(ts_nodes(files))).collect()
    assert len(list(tmp_path.iterdir())) == len(FILES)


def test_props_through_barrels_and_heads(spark):
    files = [*FILES, ("v.tsx", 'import { Far as P } from "./i1";\nexport const View: React.FC<P> = () => <i />;\nexport const Bare = (x: Props) => <i />;'), ("w.tsx", 'import { Props } from "./b.types";\nfunction Wide({ y }: Props) { return <i />; }')]
    got = {r.componentName: r.doc for r in extract.documented_components(ts_nodes(spark.createDataFrame(files, "file_path string, content string"))).collect()}
    assert '"name":"n"' in got["View"] and '"name":"up"' in got["View"] and got["Bare"] == '{"displayName":"Bare"}'
    assert [p in got["Wide"] for p in ('"name":"y"', '"name":"n"', '"name":"up"', '"name":"x"')] == [True, True, True, False]


@pytest.mark.parametrize(("query", "rows"), [("interface_trees", 3200), ("last_interface_trees", 600), ("scoped_trees", 87)])
def test_trees_know_no_limit_of_rows(spark, query, rows):
    limit = "spark.sql.cteRecursionRowLimit"  # a million by default: no query may hang on it
    spark.conf.set(limit, "20")
    try:
        assert catalogue.QUERIES[query](spark, "/root/testdata/sf0.001").count() == rows
    finally:
        spark.conf.unset(limit)


def test_props_of_many_files_meet_by_shuffles(spark):
    plan = catalogue.QUERIES["documented_props"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
