"""What the node table of source files says: imports, state, functions, tags, chunks, components and interfaces.

Every operator is a filter and projection of the node table, or an aggregate of one file's nodes in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.functions.js import capitalised, first_match, first_seen, in_order
from loam.functions.spread import shuffled
from loam.operators import scopes
from loam.sources.stores import kept, written
from loam.syntax.nodes import component_name

#: Imported names that are no dependencies.
NO_DEPENDENCIES = ("React", "useState")


def _list(value: Column, when: Column) -> Column:
    return in_order(F.when(when, value), F.col("node_id"))


def dependency(prefix: str | None = None) -> Column:
    """Predicate: a named import that counts as a dependency; `prefix` leaves out names that begin with it."""
    out = (F.col("kind") == "ImportSpecifier") & ~F.col("name").isin(*NO_DEPENDENCIES)
    return out & ~F.startswith(F.col("name"), F.lit(prefix)) if prefix else out


def state(loose: bool = False) -> Column:
    """Predicate: a declaration whose initializer calls useState; `loose` takes any whose text has the word."""
    held = F.col("kind") == "VariableDeclaration"
    return held & (F.contains(F.col("text"), F.lit("useState")) if loose else (F.col("callee") == "useState"))


def function(own: Column) -> Column:
    """Predicate: a declaration of an arrow function that is not the component itself."""
    return (F.col("kind") == "VariableDeclaration") & (F.col("init_kind") == "ArrowFunction") & (F.col("name") != own)


def tag() -> Column:
    return F.col("kind").isin("JsxOpening", "JsxSelfClosing") & capitalised(F.col("name"))


def records(nodes: DataFrame) -> DataFrame:
    """component, file, dependencies, jsxUsage, internalComponents, state, functions of each file, in document order.

    Lists of names are distinct in order of first occurrence; state and functions keep repeats. Every file that can be
    parsed gives a row, with empty lists where there is nothing; files that can't be parsed give none.
    """
    own = component_name(F.col("file"))
    fn = function(own)
    out = nodes.where("kind <> 'Error'").groupBy("file").agg(
        first_seen(_list(F.col("name"), dependency())).alias("dependencies"),
        first_seen(_list(F.col("name"), tag())).alias("jsxUsage"),
        first_seen(_list(F.col("name"), fn & capitalised(F.col("name")))).alias("internalComponents"),
        _list(F.struct(F.col("text").alias("code")), state()).alias("state"),
        _list(F.struct("name", F.col("statement").alias("code")), fn).alias("functions"),
    )
    return out.select(own.alias("component"), "file", "dependencies", "jsxUsage", "internalComponents", "state", "functions")


def loose_records(nodes: DataFrame) -> DataFrame:
    """The looser rules: dependencies without names in I, state by the word alone, functions by statements with =>,
    each by its first declared name. The nodes are read three times, so those of a lazy table are written first."""
    wanted = F.col("kind").isin("SourceFile", "VariableStatement", "VariableDeclaration", "ImportSpecifier", "JsxOpening", "JsxSelfClosing")
    nodes = written(nodes.where(wanted), "loose")
    statement = nodes.where("kind = 'VariableStatement'").where(F.contains(F.col("text"), F.lit("=>"))).select("file", F.col("node_id").alias("statement_id"), "text")
    declared = nodes.where("kind = 'VariableDeclaration'").select("file", F.col("parent_id").alias("statement_id"), "node_id", "name")
    fns = statement.join(declared, ["file", "statement_id"]).groupBy("file", "statement_id").agg(first_match(F.col("name"), F.col("node_id")).alias("name"), F.first("text").alias("code"))
    own = component_name(F.col("file"))
    named = fns.where(F.col("name") != own).groupBy("file").agg(in_order(F.struct("name", "code"), F.col("statement_id")).alias("functions"), first_seen(in_order(F.when(capitalised(F.col("name")), F.col("name")), F.col("statement_id"))).alias("internalComponents"))
    rest = nodes.where("kind <> 'Error'").groupBy("file").agg(
        first_seen(_list(F.col("name"), dependency("I"))).alias("dependencies"),
        first_seen(_list(F.col("name"), tag())).alias("jsxUsage"),
        _list(F.struct(F.col("text").alias("code")), state(True)).alias("state"),
    )
    none = lambda c: F.coalesce(F.col(c), F.array().cast(named.schema[c].dataType)).alias(c)
    return rest.join(named, "file", "left").select(own.alias("component"), "file", "dependencies", "jsxUsage", none("internalComponents"), "state", none("functions"))


def ast_chunks(nodes: DataFrame) -> DataFrame:
    """id (file name and offset with leading trivia), file, type, text of functions and variable statements at any depth."""
    name = F.element_at(F.split("file", "/"), -1)
    return nodes.where(F.col("kind").isin("FunctionDeclaration", "VariableStatement", "ArrowFunction")).select(F.concat_ws("_", name, F.col("pos")).alias("id"), "file", F.lit("ast_node").alias("type"), "text", "node_id")


#: Fixed value: typed constant components up to their first closing brace.
FUNCTION_PATTERN = r"(?U)const\s+(\w+)\s*:\s*React\.FC[^{]*\{([\s\S]*?)\}"


def pattern_chunks(texts: DataFrame, pattern: str = FUNCTION_PATTERN, kind: str = "function", key: str = "file_path", content: str = "content") -> DataFrame:
    """key, ord, id (group 1), type, text (whole match) of all matches, leftmost and non-overlapping."""
    rx = F.lit(pattern)
    pairs = F.arrays_zip(F.regexp_extract_all(content, rx, F.lit(1)).alias("id"), F.regexp_extract_all(content, rx, F.lit(0)).alias("text"))
    return texts.select(key, F.posexplode(pairs).alias("ord", "m")).select(key, "ord", F.col("m.id").alias("id"), F.lit(kind).alias("type"), F.col("m.text").alias("text"))


def front_ends(nodes: DataFrame) -> DataFrame:
    """parser, component, propsInterface, file of the three front ends.

    All give the last component of each file. `babel` adds the last interface of the same file, `typescript` the
    interface that is named after the component, in whatever file it stands; `tree-sitter` has null. One aggregate of the nodes
    holds what all of them need; it is written, a row a file, so that the sources are parsed once.
    """
    is_one = (F.col("kind") == "FunctionDeclaration") | (F.col("kind") == "VariableDeclaration") & F.col("identifier") & F.col("init_kind").isin("ArrowFunction", "FunctionExpression")
    head = F.when(F.col("kind") == "InterfaceDeclaration", F.col("name"))
    facts = kept(nodes.groupBy("file").agg(
        F.max_by(F.when(is_one, F.col("name")), F.when(is_one & F.col("name").isNotNull(), F.col("node_id"))).alias("component"),
        F.max_by(head, F.when(head.isNotNull(), F.col("node_id"))).alias("last"),
        F.collect_set(head).alias("declared"),
    ), "front-ends")
    table = facts.select(F.explode("declared").alias("name")).distinct()
    found = facts.where("component is not null").withColumn("want", F.concat("component", F.lit("Props"))).join(table, F.col("want") == F.col("name"), "left")
    each = F.array(
        F.struct(F.lit("babel").alias("parser"), F.coalesce("last", F.lit("")).alias("i")),
        F.struct(F.lit("typescript").alias("parser"), F.coalesce("name", F.lit("")).alias("i")),
        F.struct(F.lit("tree-sitter").alias("parser"), F.lit(None).cast("string").alias("i")),
    )
    return found.select(F.explode(each).alias("e"), "component", "file").select("e.parser", "component", F.col("e.i").alias("propsInterface"), "file")


def documented_components(nodes: DataFrame) -> DataFrame:
    """parser, componentName, doc, file of every component function at the top of a file; doc is JSON of its name and props.

    Props are the members, own and inherited, of the interface that its text names as React.FC<...> or as the type of its
    parameter, as that name is meant in its file: declared there, or imported from wherever it is declared. An interface of
    another file that is not imported does not count; without one there are no props.
    """
    is_one = (F.col("kind") == "FunctionDeclaration") | (F.col("kind") == "VariableDeclaration") & F.col("init_kind").isin("ArrowFunction", "FunctionExpression")
    head = F.substring_index(F.coalesce("statement", "text"), "=>", 1)
    named = F.coalesce(F.nullif(F.regexp_extract(head, r"FC\s*<\s*(\w+)", 1), F.lit("")), F.regexp_extract(head, r"[)}\w]\s*:\s*(\w*Props)\b", 1))
    shown = is_one & capitalised(F.col("name"))
    held = scopes.symbols(nodes, shown, wants=F.when(shown, named))
    names = scopes.scope(held)
    own = held.where("wants is not null").select("file", "node_id", "name", "wants")
    props = scopes.properties(held, names).groupBy(F.col("file").alias("to_file"), F.col("owner").alias("to_name")).agg(in_order(F.struct("name", F.col("said").alias("type"), "optional", "doc"), F.col("place")).alias("props"))
    at = own.join(shuffled(names.withColumnRenamed("name", "wants")), ["file", "wants"], "left").join(shuffled(props), ["to_file", "to_name"], "left")
    doc = F.to_json(F.struct(F.col("name").alias("displayName"), "props"))
    return at.select(F.lit("docgen").alias("parser"), F.col("name").alias("componentName"), doc.alias("doc"), "file", "node_id")


def interfaces(nodes: DataFrame) -> DataFrame:
    """file, interface, ord of the interfaces at the top of each file."""
    return nodes.where("kind = 'InterfaceDeclaration' and top").select("file", F.col("name").alias("interface"), (F.row_number().over(Window.partitionBy("file").orderBy("node_id")) - 1).alias("ord"))
