"""Schema documents: made from interfaces, cleaned, selected, flattened into chunk rows, and resolved along references.

A schema is kept as its definitions: name and JSON text of each, peeled one level at a time, so that the order of keys
stays that of the document.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loam.functions.js import in_order, once
from loam.functions.spread import shuffled, spread
from loam.sources.stores import kept
from loam.syntax.nodes import ts_nodes
from loam.syntax.parser import Node, SyntaxProblem, nodes_of

MAP = "map<string,string>"


# ---------------------------------------------------------------- cleaning of source text


def without_react_types(content: Column) -> Column:
    """Takes out imports of React and makes mouse and change events `any`."""
    for pattern, new in ((r"import React.*;", ""), (r"MouseEvent<.*?>", "any"), (r"ChangeEvent<.*?>", "any")):
        content = F.regexp_replace(content, pattern, new)
    return content


def exported_interfaces(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"export interface (\w+)"), F.lit(1))


def repeats_interface(content: Column) -> Column:
    names = exported_interfaces(content)
    return F.size(names) != F.size(F.array_distinct(names))


_HEADS = r"extends\s+[^{]+"


def without_heads(content: Column) -> Column:
    """Takes out `extends ...` up to the brace."""
    return F.regexp_replace(content, _HEADS, "")


_DECLARED = re.compile(r"export interface (\w+)(?:(\s+extends\s+)(\w+)(?=\s*\{))?")


def number_interfaces(content: str | None) -> str | None:
    """If an interface name repeats, every interface gets the number of its occurrence, unique ones 1; a head that
    extends one plain name extends that name's first."""
    names = [m[1] for m in _DECLARED.finditer(content or "")]
    if len(set(names)) == len(names):
        return content
    count: dict[str, int] = {}

    def one(m: re.Match) -> str:
        count[m[1]] = count.get(m[1], 0) + 1
        return f"export interface {m[1]}{count[m[1]]}" + (f"{m[2]}{m[3]}1" if m[3] else "")

    return _DECLARED.sub(one, content)


@F.pandas_udf(T.StringType())
def numbered(content: pd.Series) -> pd.Series:
    """The only text rule with a running count, which column functions can't keep."""
    return content.map(number_interfaces, na_action="ignore")


def repaired(content: Column, names: Column) -> Column:
    """References to renamed interfaces: Partial<N> and `: N` name the first of them."""

    def one(text: Column, name: Column) -> Column:
        text = F.regexp_replace(text, F.concat(F.lit("Partial<"), name, F.lit(">")), F.concat(F.lit("Partial<"), name, F.lit("1>")))
        return F.regexp_replace(text, F.concat(F.lit(r":\s*"), name, F.lit(r"(\W)")), F.concat(F.lit(": "), name, F.lit("1$1")))

    return F.aggregate(names, content, one)


def cleaned(files: DataFrame, content: str = "content") -> DataFrame:
    """files with `content` cleaned: React types gone, and repeated interfaces numbered with their references."""
    plain = without_react_types(F.col(content))
    names = F.array_distinct(exported_interfaces(plain))
    return files.withColumn(content, F.when(repeats_interface(plain), repaired(numbered(plain), names)).otherwise(plain))


def nodes_or_retry(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """The node table of files; one that can't be parsed is tried again without its `extends` heads, and is left out
    with its Error row if that fails too."""
    return ts_nodes(files, path, content, without=_HEADS)


# ---------------------------------------------------------------- schema documents

#: Names of plain types.
_PLAIN = {"string": "string", "number": "number", "boolean": "boolean", "null": "null", "object": "object"}


def split_type(kind: str, at: str) -> list[str]:
    """The parts of a type text between separators that stand in no bracket, string or function type."""
    parts, depth, begin, quote = [], 0, 0, ""
    for i, c in enumerate(kind):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and kind[i - 1 : i] != "=":
            depth -= 1
        elif c == at and not depth:
            parts.append(kind[begin:i].strip())
            begin = i + 1
    return [p for p in (*parts, kind[begin:].strip()) if p]


def _bare(kind: str) -> str:
    """Without brackets around the whole; those of a function's parameters are none."""
    while kind.startswith("(") and kind.endswith(")"):
        depth = 0
        for i, c in enumerate(kind):
            depth += (c == "(") - (c == ")")
            if not depth:
                break
        if i < len(kind) - 1:
            break
        kind = kind[1:-1].strip()
    return kind


def object_schema(members: list[Node]) -> dict:
    """Schema of the members of one owner, nodes of kinds PropertySignature and IndexSignature."""
    props = {n.name: property_schema(n.extra["type"], n.extra.get("doc")) for n in members if n.kind == "PropertySignature"}
    out: dict = {"type": "object", "properties": props}
    if required := [n.name for n in members if n.kind == "PropertySignature" and not n.extra["optional"]]:
        out["required"] = required
    for n in members:
        if n.kind == "IndexSignature":
            out["additionalProperties"] = property_schema(n.extra["type"], None)
    return out


def property_schema(kind: str, doc: str | None) -> dict:
    """JSON schema of a type text: plain types, literals as enums, unions, intersections, arrays, inline objects, records
    and references; what only a type checker could tell (functions, generics of other libraries) has no type but its text
    as comment."""
    kind = _bare(kind.strip())
    out: dict = {}
    unions, both = split_type(kind, "|"), split_type(kind, "&")
    if "=>" in kind and len(unions) == 1:
        out = {"$comment": kind}
    elif len(unions) > 1:
        texts = [p[1:-1] for p in unions if p[0] in "\"'"]
        numbers = [float(p) if "." in p else int(p) for p in unions if re.fullmatch(r"-?\d+(\.\d+)?", p)]
        if len(texts) == len(unions):
            out = {"type": "string", "enum": texts}
        elif len(texts) + len(numbers) == len(unions):
            out = {"type": "number" if not texts else ["string", "number"], "enum": [*texts, *numbers]}
        elif all(p in _PLAIN for p in unions):
            out = {"type": [_PLAIN[p] for p in unions]}
        else:
            out = {"anyOf": [property_schema(p, None) for p in unions]}
    elif len(both) > 1:
        out = {"allOf": [property_schema(p, None) for p in both]}
    elif m := re.fullmatch(r"(?:readonly\s+)?(.+)\[\]", kind, re.S):
        out = {"type": "array", "items": property_schema(m[1], None)}
    elif m := re.fullmatch(r"(?:Readonly)?Array<(.+)>", kind, re.S):
        out = {"type": "array", "items": property_schema(m[1], None)}
    elif (m := re.fullmatch(r"Record<(.+)>", kind, re.S)) and len(parts := split_type(m[1], ",")) == 2:
        out = {"type": "object", "additionalProperties": property_schema(parts[1], None)}
    elif kind.startswith("{"):
        out = object_schema([n for n in nodes_of(f"interface _ {kind}", False) if n.extra.get("owner") == "_"])
    elif kind[:1] in "\"'" and kind:
        out = {"type": "string", "enum": [kind[1:-1]]}
    elif re.fullmatch(r"-?\d+(\.\d+)?", kind):
        out = {"type": "number", "enum": [float(kind) if "." in kind else int(kind)]}
    elif kind in _PLAIN:
        out = {"type": _PLAIN[kind]}
    elif kind in ("any", "unknown"):
        out = {}
    elif re.fullmatch(r"\w+", kind):
        out = {"$ref": f"#/definitions/{kind}"}
    else:
        out = {"$comment": kind}
    return out | ({"description": doc} if doc else {})


@F.pandas_udf(T.StringType())
def _type_json(kind: pd.Series, doc: pd.Series) -> pd.Series:
    def one(k: str | None, d: str | None) -> str:
        try:
            return json.dumps(property_schema(k or "any", d if isinstance(d, str) else None))
        except (SyntaxProblem, RecursionError, IndexError):
            return json.dumps({"$comment": k})

    return pd.Series([one(k, d) for k, d in zip(kind, doc, strict=True)])


def _quoted(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def definitions(nodes: DataFrame) -> DataFrame:
    """file, ord, name, definition (JSON) of every interface, type alias and enumeration; members of interfaces in order,
    inherited ones through allOf, index signatures as additionalProperties.

    Interfaces of one name in a file are merged into the first, as declarations merge.
    """
    held = nodes.where(F.col("kind").isin("PropertySignature", "IndexSignature", "InterfaceDeclaration", "TypeAlias", "EnumDeclaration"))
    held = held.withColumn("json", F.when(F.col("type").isNotNull(), _type_json("type", "doc")))
    prop, index = F.col("kind") == "PropertySignature", F.col("kind") == "IndexSignature"
    head, said = F.col("kind") == "InterfaceDeclaration", F.col("kind").isin("TypeAlias", "EnumDeclaration")
    name = F.when(prop | index, F.col("owner")).otherwise(F.col("name"))
    at = F.col("node_id")
    rows = held.groupBy("file", name.alias("name")).agg(
        F.min(F.when(head | said, at)).alias("ord"),
        F.bool_or(head).alias("interface"),
        F.concat(F.lit("{"), F.array_join(in_order(F.when(prop, F.concat(_quoted(F.col("name")), F.lit(":"), F.col("json"))), at), ","), F.lit("}")).alias("props"),
        in_order(F.when(prop & ~F.col("optional"), F.col("name")), at).alias("required"),
        F.max_by(F.when(index, F.col("json")), F.when(index, at)).alias("rest"),
        F.flatten(in_order(F.when(head, F.col("extends")), at)).alias("extends"),
        F.min_by(F.when(said, F.col("json")), F.when(said, at)).alias("said"),
    )
    refs = F.transform(F.filter("extends", lambda h: h.rlike(r"^\w+$")), lambda h: F.concat(F.lit('{"$ref":"#/definitions/'), h, F.lit('"}')))
    body = F.concat(
        F.lit('{"type":"object","properties":'), F.col("props"),
        F.when(F.size("required") > 0, F.concat(F.lit(',"required":'), F.to_json("required"))).otherwise(""),
        F.when(F.col("rest").isNotNull(), F.concat(F.lit(',"additionalProperties":'), F.col("rest"))).otherwise(""),
        F.when(F.size(refs) > 0, F.concat(F.lit(',"allOf":['), F.array_join(refs, ","), F.lit("]"))).otherwise(""), F.lit("}"),
    )
    # Members of inline objects have an owner that is no declaration; they stand in their member's schema.
    return rows.where("ord is not null").select("file", "ord", "name", F.when(F.col("interface"), body).otherwise(F.col("said")).alias("definition"))


def schema_documents(nodes: DataFrame) -> DataFrame:
    """file, schema: one JSON document of all definitions of a file."""
    pair = F.concat(_quoted(F.col("name")), F.lit(":"), F.col("definition"))
    return definitions(nodes).groupBy("file").agg(F.concat(F.lit('{"definitions":{'), F.array_join(in_order(pair, F.col("ord")), ","), F.lit("}}")).alias("schema"))


def exploded_definitions(schemas: DataFrame, key: str = "component", schema: str = "schema") -> DataFrame:
    """key, ord, definition, body: one row for each definition of a document; none for documents without definitions."""
    held = F.from_json(schema, f"struct<definitions:{MAP}>")["definitions"]
    return schemas.select(key, F.posexplode(held).alias("ord", "definition", "body"))


def selected(definitions: DataFrame, key: str = "component", name: str = "definition", body: str = "body", order: str = "ord") -> DataFrame:
    """The definition that stands for each component: <component>Props, else the first name with `props`, else the first
    with `data`, else the first."""
    low = F.lower(name)
    rank = F.when(F.col(name) == F.concat(F.col(key), F.lit("Props")), 1).when(F.contains(low, F.lit("props")), 2).when(F.contains(low, F.lit("data")), 3).otherwise(4)
    best = definitions.groupBy(key).agg(F.min_by(F.struct(name, body), F.struct(rank, order)).alias("d"))
    return best.select(key, f"d.{name}", f"d.{body}")


#: What is read of a property's schema; `type` and `enum` may be of any kind and come as text.
PROPERTY = "struct<type:string,`$ref`:string,items:struct<type:string,`$ref`:string>,enum:array<string>,description:string,`$comment`:string>"


def own_and_inherited(rows: DataFrame, body: str = "body", keys: tuple[str, ...] = ("component", "ord", "definition")) -> DataFrame:
    """keys, place, name, value: the properties of each definition, then those of its allOf parts; a later value takes
    the place of an earlier one, and the place stays that of the first. All within the row: nothing is shuffled."""
    held = F.from_json(body, "struct<properties:map<string,string>,allOf:array<struct<properties:map<string,string>>>>")
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = lambda m: F.coalesce(F.map_entries(m), none)
    rows = once(rows, *keys, held=held)
    every = F.concat(entries(F.col("held.properties")), F.coalesce(F.flatten(F.transform("held.allOf", lambda p: entries(p["properties"]))), none))
    rows = once(rows, *keys, every=every)
    merged = F.transform(F.array_distinct(F.transform("every", lambda e: e["key"])), lambda n: F.struct(n.alias("name"), F.element_at(F.filter("every", lambda e: e["key"] == n), -1)["value"].alias("value")))
    return rows.select(*keys, F.posexplode(merged).alias("place", "p")).select(*keys, "place", "p.name", "p.value")


def _type_text(kind: Column) -> Column:
    """`type` as text; a list of types with commas, as lists print."""
    return F.when(F.startswith(kind, F.lit("[")), F.array_join(F.from_json(kind, "array<string>"), ",")).otherwise(kind)


def _tail(ref: Column) -> Column:
    return F.element_at(F.split(ref, "/"), -1)


def resolved_type(held: Column) -> tuple[Column, Column]:
    """Type text of a property (a PROPERTY struct), and the definition it refers to or null."""
    kind, ref, item_ref, item_type = _type_text(held["type"]), held["$ref"], held["items"]["$ref"], _type_text(held["items"]["type"])
    is_list = kind == "array"
    link = F.when(is_list, F.when(item_ref.isNotNull(), _tail(item_ref))).when(kind.isNull() & ref.isNotNull(), _tail(ref))
    said = (
        F.when(is_list & item_ref.isNotNull(), F.concat(_tail(item_ref), F.lit("[]")))
        .when(is_list & item_type.isNotNull(), F.concat(item_type, F.lit("[]")))
        .when(is_list, "array").when(kind.isNotNull(), kind).when(ref.isNotNull(), _tail(ref)).otherwise("any")
    )
    return said, link


def described(name: Column, held: Column, component: Column) -> Column:
    """The property's own description, or a sentence by its kind. held: a PROPERTY struct."""
    return F.coalesce(
        F.nullif(held["description"], F.lit("")),
        F.when(F.startswith(name, F.lit("on")), F.concat(F.lit("Callback function triggered when "), F.lower(F.substring(name, 3, 1 << 20)), F.lit(" occurs in "), component, F.lit(".")))
        .when(held["enum"].isNotNull(), F.concat(name, F.lit(" can be one of: "), F.array_join(held["enum"], ", "), F.lit(".")))
        .when(held["type"] == "boolean", F.concat(F.lit("Boolean flag to control "), name, F.lit(" behavior in "), component, F.lit(".")))
        .otherwise(F.concat(name, F.lit(" property of "), component, F.lit(" component."))),
    )


def property_kind(name: Column) -> Column:
    """event for names that begin with on, ref for names with ref in any case, else property."""
    return F.when(F.startswith(name, F.lit("on")), "event").when(F.contains(F.lower(name), F.lit("ref")), "ref").otherwise("property")


def schema_chunks(schemas: DataFrame) -> DataFrame:
    """component, definition, isSubType, name, description, type, dataType, enum, linksTo, signature of every property of
    every definition of (component, schema), with ord and place for their order."""
    rows = once(own_and_inherited(exploded_definitions(spread(schemas.select("component", "schema")))), "component", "ord", "place", "definition", "name", held=F.from_json("value", PROPERTY))
    name, held, kind = F.col("name"), F.col("held"), property_kind(F.col("name"))
    said, link = resolved_type(held)
    rows = once(rows, _said=said, _link=link)
    said, link = F.col("_said"), F.col("_link")
    return rows.select(
        "component", "ord", "place", "definition", (F.col("definition") != F.concat("component", F.lit("Props"))).alias("isSubType"), "name",
        described(name, held, F.col("component")).alias("description"), kind.alias("type"),
        F.when(kind == "property", said).when(kind == "ref", "ref").alias("dataType"),
        F.when(kind == "property", held["enum"]).alias("enum"),
        F.when(kind == "property", link).alias("linksTo"),
        F.when(kind == "event", F.coalesce(F.nullif(held["$comment"], F.lit("")), F.lit("unknown"))).alias("signature"),
    )


def with_schemas(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """Component records with their own schema (null if there is none) and that of each dependency, in order.

    schemas: component, schema; a row a component. Both are equi-joins by shuffles, since schemas are as many as records.
    A record goes through once: its rows, one for each dependency, meet again by component and file, and only the first
    of them carries the record's lists.
    """
    own = records.join(shuffled(schemas), "component", "left")
    lists = F.struct("schema", "jsxUsage", "internalComponents", "state", "functions")
    each = own.select("component", "file", lists.alias("rest"), F.posexplode_outer("dependencies").alias("at", "name"))
    each = each.withColumn("rest", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("rest")))
    found = each.join(shuffled(schemas.select(F.col("component").alias("name"), F.col("schema").alias("held"))), "name", "left")
    nested = found.groupBy("component", "file").agg(F.first("rest", ignorenulls=True).alias("rest"), in_order(F.when(F.col("name").isNotNull(), F.struct("name", F.col("held").alias("schema"))), F.col("at")).alias("dependencies"))
    return nested.select("component", "file", "rest.schema", "dependencies", "rest.jsxUsage", "rest.internalComponents", "rest.state", "rest.functions")


# ---------------------------------------------------------------- types along references


def type_tree(spark: SparkSession, edges: DataFrame, max_depth: int = 4, skip: tuple[str, ...] = (), start: DataFrame | None = None) -> DataFrame:
    """root, path, depth, name, said: every property reached from each root along references.

    edges: owner, name, said (its type as text), target (an owner or null); a property with several targets, as a union
    has, stands in several rows and is followed into each at the same depth. A property is not followed at `max_depth`,
    into a type that is already on its path, or into one on the skip list; there its type text stands. Roots are all
    owners, or those of `start` (owner). Edges are read twice, so what is dear to make should be written first.

    A level is made from the one before it by two equi-joins and written, until one is empty; nothing limits its rows.
    """
    props = edges.select("owner", "name", "said").distinct()
    links = edges.where("target is not null").select("owner", "name", "target").distinct()
    links = links.where(~F.col("target").isin(*skip)) if skip else links
    props, links = kept(props, "tree-props"), kept(links, "tree-links")
    first = props if start is None else kept(props.join(shuffled(start), "owner", "left_semi"), "tree")
    level = first.select(F.col("owner").alias("root"), F.array("name").alias("path"), F.array("owner").alias("seen"), "owner", "name", "said")
    step, reached = props.select(F.col("owner").alias("target"), F.col("name").alias("_name"), F.col("said").alias("_said")), []
    for depth in range(1, max_depth + 2):
        reached.append(level.select("root", F.array_join("path", ".").alias("path"), F.lit(depth).alias("depth"), "name", "said"))
        if depth > max_depth:
            break
        onward = level.select("root", "path", "seen", "owner", "name").join(shuffled(links), ["owner", "name"]).where(~F.array_contains("seen", F.col("target")))
        level = kept(onward.join(shuffled(step), "target").select("root", F.array_append("path", F.col("_name")).alias("path"), F.array_append("seen", F.col("target")).alias("seen"), F.col("target").alias("owner"), F.col("_name").alias("name"), F.col("_said").alias("said")), "tree")
        if not level.limit(1).count():
            break
    return reduce(DataFrame.unionByName, reached)


@F.pandas_udf(T.ArrayType(T.StringType()))
def type_targets(kind: pd.Series, own: pd.Series) -> pd.Series:
    """Owners that a type text refers to: each branch of a union or intersection by its name, arrays by their items, an
    inline object by `own`. Functions, plain types and literals refer to none."""

    def one(text: str | None, inline: str) -> list[str]:
        out: list[str] = []
        for part in (q for p in split_type(text or "", "|") for q in split_type(p, "&")):
            part = _bare(part)
            if len(inner := split_type(part, "|")) > 1:
                out += one(part, inline)
                continue
            while m := re.fullmatch(r"(?:readonly\s+)?(.+)\[\]|(?:Readonly)?Array<(.+)>", part, re.S):
                part = _bare((m[1] or m[2]).strip())
                inner = split_type(part, "|")
                if len(inner) > 1:
                    break
            if len(inner) > 1:
                out += one(part, inline)
            elif "=>" in part:
                continue
            elif part.startswith("{"):
                out.append(inline)
            elif re.fullmatch(r"[A-Za-z_$][\w$]*", part) and part not in _PLAIN:
                out.append(part)
        return list(dict.fromkeys(out))

    return pd.Series([one(k, o) for k, o in zip(kind, own, strict=True)])
