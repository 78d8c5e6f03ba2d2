"""Tables that the registered queries are made over: reading them, and stand-ins built from their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.functions.js import in_order


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, content: a TSX file for each part, its names and texts from the part's columns."""
    text = """import React, {{ useState }} from "react";
import {{ IThing, Dep%2$s as Dep }} from "./d";
// part %3$s: it's a <Fake /> in a comment
const C%1$s: React.FC<C%1$sProps> = ({{ a }}: {{ a: () => void }}) => {{
    const [s, setS] = useState<string>("%4$s");
    const helper = (x: number): number => x + %2$s;
    const Inner = () => <Dep v={{`<${{s}}> ${{helper(1)}}`}} />;
    return <div><Inner /><Inner /><Foo.Bar a="1">{{helper(1)}} it's</Foo.Bar></div>;
}};
export default C%1$s;
""".replace("{{", "{").replace("}}", "}")
    tail = F.when(F.col("p_partkey") % 2 == 0, F.format_string("interface C%sProps { a: string }\n", F.col("p_partkey"))).otherwise("")
    body = F.concat(F.format_string(text, F.col("p_partkey"), F.col("p_size"), F.col("p_name"), F.col("p_type")), tail)
    return read(spark, sf_dir, "part").select(F.format_string("src/components/C%s.tsx", F.col("p_partkey")).alias("file_path"), body.alias("content"))


def part_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """component, schema: a schema document for each part with every kind of property that flattening tells apart."""
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(',"description":"'), F.col("p_name"), F.lit('"'))).otherwise("")
    body = F.concat(
        F.lit('{"definitions":{"'), F.col("component"), F.lit('Props":{"properties":{"label":{"type":"string"},"onPick":{"$comment":"() => void"},"once":{},"innerRef":{},'),
        F.lit('"items":{"type":"array","items":{"$ref":"#/definitions/Node"}},"sizes":{"type":"array","items":{"type":"number"}},"bag":{"type":"array"},"kind":{"type":"string","enum":["'),
        F.col("p_brand"), F.lit('","'), F.col("p_type"), F.lit('"]},"flag":{"type":"boolean"'), said, F.lit('},"multi":{"type":["string","number"]},"link":{"$ref":"#/definitions/Other"},"free":{}},'),
        F.lit('"allOf":[{"$ref":"#/definitions/Base"},{"properties":{"label":{"type":"number"},"extra":{"type":"boolean"}}}]},"Node":{"properties":{"id":{"type":"string"}}}}}'),
    )
    return read(spark, sf_dir, "part").withColumn("component", F.concat(F.lit("C"), F.col("p_partkey"))).select("component", body.alias("schema"))


def region_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component record for each region, its parts from the region's nations."""
    odd, n, k = F.col("n_nationkey") % 2 == 1, F.col("n_name"), F.col("n_nationkey")
    mixed = F.when(odd, F.lower(n)).otherwise(n)
    prop = F.concat(F.lit('"'), F.when(k % 4 == 0, F.concat(F.lit("onMouse"), n)).otherwise(n), F.lit('":'), F.when(k % 3 == 0, '{"type":"string"}').when(k % 3 == 1, '{"$ref":"#/definitions/X"}').otherwise("{}"))
    rows = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy(F.col("r_name").alias("component")).agg(
        F.create_map(F.lit("P"), F.concat(F.lit('{"properties":{'), F.array_join(in_order(prop, k), ","), F.lit("}}"))).alias("schema"),
        in_order(F.struct(F.when(k % 3 == 0, "").otherwise(n).alias("name")), k).alias("dependencies"),
        in_order(mixed, k).alias("jsxUsage"),
        in_order(n, k).alias("internalComponents"),
        in_order(F.struct(F.repeat(F.concat(n, F.lit(" ")), k).alias("code")), k).alias("state"),
        in_order(F.struct(mixed.alias("name"), F.concat(F.lit("code of "), n).alias("code")), k).alias("functions"),
    )
