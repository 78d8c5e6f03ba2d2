"""Chunks for retrieval from component records and schemas: one expression a kind, exploded together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loam.functions.js import capitalised, in_order, joined, once, shortened, starts_with_any, without_blanks

#: Beginnings of property names that tell nothing about a component.
DULL_PROPS = (
    "aria-", "onMouse", "onPointer", "onTouch", "onAnimation", "onTransition", "onScroll", "onWheel", "onDrag",
    "onCopy", "onPaste", "onKey", "onFocus", "onBlur", "onChange", "onInput", "color",
)
#: Most properties and tags that a chunk names; characters of a function in a chunk.
MOST_PROPS, MOST_TAGS, CODE = 10, 5, 100


def useful_prop(name: Column) -> Column:
    return ~starts_with_any(name, DULL_PROPS)


def prop_texts(schema: Column) -> Column:
    """`name (type)` of the first definition's properties, without dull ones, at most MOST_PROPS. schema: map of JSON."""
    first = F.try_element_at(F.map_values(schema), F.lit(1))
    props = F.map_entries(F.from_json(first, "struct<properties:map<string,string>>")["properties"])
    shown = F.slice(F.filter(props, lambda p: useful_prop(p["key"])), 1, MOST_PROPS)
    held = F.transform(shown, lambda p: F.struct(p["key"].alias("name"), F.from_json(p["value"], "struct<type:string,`$ref`:string>").alias("held")))
    kind = lambda t: F.when(F.startswith(t, F.lit("[")), F.array_join(F.from_json(t, "array<string>"), ",")).otherwise(t)
    one = lambda p: (
        F.when(p["held"]["type"].isNotNull(), F.concat(p["name"], F.lit(" ("), kind(p["held"]["type"]), F.lit(")")))
        .when(p["held"]["$ref"].isNotNull(), F.concat(p["name"], F.lit(" (ref)")))
        .otherwise(p["name"])
    )
    return F.transform(held, one)


def overview(component: Column, internal: Column, state: Column) -> Column:
    parts = F.when(F.size(internal) > 0, F.concat(F.lit(" composed of "), joined(internal, ", "))).otherwise("")
    return F.concat(component, F.lit(" is a UI component"), parts, F.when(F.size(state) > 0, " that manages state").otherwise(""), F.lit("."))


def function_kind(name: Column) -> tuple[Column, Column]:
    """Kind and text of a function's chunk."""
    part = capitalised(name)
    return F.when(part, "subcomponent").otherwise("function_summary"), F.concat(name, F.when(part, " is a reusable UI subcomponent").otherwise(" is a helper logic function"))


def _when(condition: Column, kind: str, text: Column) -> Column:
    one = F.array(F.struct(F.lit(kind).alias("type"), text.alias("text")))
    return F.when(condition, one).otherwise(F.slice(one, 1, 0))


def rag_chunks(records: DataFrame) -> DataFrame:
    """component, ord, type, text: overview, props, dependencies, composition, render flow, state, functions, examples.

    records: component, schema (map of name to JSON, or null), dependencies (structs with component or name, the first that has text), jsxUsage,
    internalComponents, state (structs with code), functions (structs with name). Null lists count as empty; the
    overview and the example of the component itself are always there. No shuffle: a row's chunks come from the row.
    """
    own = F.col("component")
    fields = records.schema["dependencies"].dataType.elementType.names
    deps = joined(without_blanks(F.transform("dependencies", lambda d: F.coalesce(*(F.nullif(d[f], F.lit("")) for f in ("component", "name") if f in fields)))), ", ")
    tags = F.slice(F.filter("jsxUsage", capitalised), 1, MOST_TAGS)
    records = once(records, "component", "internalComponents", "state", "functions", _props=prop_texts(F.col("schema")), _deps=deps, _tags=tags)
    props, deps, tags = F.col("_props"), F.col("_deps"), F.col("_tags")
    chunk = lambda kind, text: F.struct(kind.alias("type"), text.alias("text"))
    none = F.slice(F.array(chunk(F.lit(""), F.lit(""))), 1, 0)
    parts = [
        _when(F.lit(True), "overview", overview(own, F.col("internalComponents"), F.col("state"))),
        _when(F.size(props) > 0, "props", F.concat(own, F.lit(" accepts props: "), joined(props, ", "))),
        _when(deps != "", "dependencies", F.concat(own, F.lit(" depends on: "), deps)),
        _when(F.size("internalComponents") > 0, "composition", F.concat(own, F.lit(" is composed of: "), joined(F.col("internalComponents"), ", "))),
        _when(F.size(tags) > 0, "render_flow", F.concat(own, F.lit(" renders "), joined(tags, ", "))),
        F.transform("state", lambda s: chunk(F.lit("state"), F.concat(own, F.lit(" manages state: "), shortened(s["code"])))),
        F.transform("functions", lambda f: chunk(*function_kind(f["name"]))),
        F.transform(F.filter("functions", lambda f: capitalised(f["name"])), lambda f: chunk(F.lit("example"), F.concat(F.lit("<"), f["name"], F.lit(" />")))),
        _when(F.lit(True), "example", F.concat(F.lit("<"), own, F.lit(" />"))),
    ]
    return records.select("component", F.posexplode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("ord", "c")).select("component", "ord", "c.type", "c.text")


def knowledge_chunks(records: DataFrame) -> DataFrame:
    """component, ord, type, name, text: what the source of a component says about state, imports, tags and functions."""
    own = F.col("component")
    chunk = lambda kind, text, name=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("type"), name.alias("name"), text.alias("text"))
    hook = F.array(chunk("behavior", F.concat(own, F.lit(" uses React useState hook for internal state management."))))
    parts = [
        F.when(F.size("state") > 0, hook),
        F.transform("dependencies", lambda d: chunk("dependency", F.concat(own, F.lit(" imports and uses "), d, F.lit(" component.")))),
        F.transform("jsxUsage", lambda t: chunk("render", F.concat(own, F.lit(" renders "), t, F.lit(" component in JSX.")))),
        F.transform("functions", lambda f: chunk("function", F.concat(own, F.lit(" contains function "), f["name"], F.lit(": "), F.substring(f["code"], 1, CODE)), f["name"])),
    ]
    return records.select("component", F.posexplode(F.concat(*(F.coalesce(p, F.slice(hook, 1, 0)) for p in parts))).alias("ord", "c")).select("component", "ord", "c.type", "c.name", "c.text")


def component_props(entries: DataFrame) -> DataFrame:
    """id, component, type, text, metadata of each component: all property names with their types, in order.

    entries: component, ord, properties (structs name, type). Entries without properties are passed over.
    """
    pair = F.transform("properties", lambda p: F.concat_ws(" ", p["name"], p["type"]))
    held = entries.where("properties is not null").groupBy("component").agg(F.flatten(in_order(pair, F.col("ord"))).alias("all"))
    text = F.concat(F.col("component"), F.lit(" component props "), F.array_join("all", " "))
    return held.select(F.concat("component", F.lit("_props")).alias("id"), "component", F.lit("component-props").alias("type"), text.alias("text"), F.struct(F.lit("docgen").alias("parser")).alias("metadata"))


def array_schemas(texts: DataFrame, content: str = "content") -> DataFrame:
    """Only documents that are a JSON array at the top."""
    return texts.where(F.startswith(F.ltrim(content), F.lit("[")))
