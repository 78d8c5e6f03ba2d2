"""Types by scope: which declaration a name means in a file, what an interface inherits, and type trees over both.

Declarations are keyed by (file, name). A name in a file means the file's own declaration, else what the file imports
under that name; imports are followed through re-exports and barrels (`export * from`) to the declaring file. Loops run
over written frontiers of distinct keys, one equi-join a round, until nothing new is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loam.functions.spread import shuffled
from loam.operators.schema import type_targets, type_tree
from loam.sources.stores import kept

_DECLARED = ("InterfaceDeclaration", "TypeAlias", "EnumDeclaration")
_BROUGHT = ("ImportSpecifier", "ImportDefault")
_SHOWN = ("ExportSpecifier", "ExportStar", "ExportAssignment")


#: Stands between a file and a name in a key; neither has it.
_BETWEEN = "\x01"


def _key(file: str | Column, name: str | Column) -> Column:
    return F.concat_ws(_BETWEEN, file, name)


def symbols(nodes: DataFrame, also: Column | None = None, **more: Column) -> DataFrame:
    """What scopes, members and trees need of the node table, written once: sources are parsed a single time. also: other
    nodes to keep; more: other columns."""
    shown = F.when(F.col("kind").isin(*_DECLARED), F.col("text").rlike(r"^export\b"))
    default = F.when(F.col("kind").isin(*_DECLARED), F.col("text").rlike(r"^export\s+default\b"))
    wanted = F.col("kind").isin("SourceFile", "PropertySignature", *_DECLARED, *_BROUGHT, *_SHOWN)
    return kept(nodes.where(wanted | also if also is not None else wanted).select("file", "node_id", "kind", "name", "owner", "type", "optional", "doc", "extends", "imported", "module", "top", shown.alias("shown"), default.alias("default"), *(c.alias(n) for n, c in more.items())), "symbols")


def module_paths(file: Column, module: Column) -> Column:
    """Where a relative module may be: its path from the importing file's folder with each ending that a file may have; an
    empty list for a package."""
    parts = F.filter(F.split(F.concat(F.regexp_replace(file, "[^/]*$", ""), module), "/"), lambda p: p != ".")
    empty = F.array().cast("array<string>")
    path = F.array_join(F.aggregate(parts, empty, lambda seen, p: F.when((p == "..") & (F.size(seen) > 0), F.slice(seen, 1, F.size(seen) - 1)).otherwise(F.array_append(seen, p))), "/")
    every = F.array(*(F.concat(path, F.lit(end)) for end in ("", ".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx")))
    return F.when(F.startswith(module, F.lit(".")), every).otherwise(empty)


def declared(held: DataFrame) -> DataFrame:
    """file, name of every type at the top of a file."""
    return held.where(F.col("kind").isin(*_DECLARED) & F.col("top")).select("file", "name").distinct()


def modules(held: DataFrame) -> DataFrame:
    """file, module, to_file: the file that a relative module is, seen from a file; packages and absent files have no row."""
    asked = held.where("module is not null").select("file", "module").distinct()
    tried = asked.select("file", "module", F.posexplode(module_paths(F.col("file"), F.col("module"))).alias("rank", "to_file"))
    there = held.where("kind = 'SourceFile'").select(F.col("file").alias("to_file"))
    return tried.join(shuffled(there), "to_file").groupBy("file", "module").agg(F.min_by("to_file", "rank").alias("to_file"))


def exported(held: DataFrame, wanted: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """file, name, to_file, to_name: the declaration that each exported name of a file is.

    wanted: (file, name) of the exports to follow; all imported ones if None. A file's own export of a name hides those
    of its `export *`; a name that several `export *` lead to different declarations is ambiguous and has no row, nor
    has one that only leads in a circle. `default` does not pass through `export *`.
    """
    at = modules(held) if at is None else at
    own = declared(held)
    brought = held.where(F.col("kind").isin(*_BROUGHT)).join(shuffled(at), ["file", "module"]).groupBy("file", "name").agg(F.min_by(F.struct("to_file", F.col("imported").alias("to_name")), "node_id").alias("b")).select("file", "name", "b.*")
    shown = held.where("shown and top").select("file", F.when(F.col("default"), F.lit("default")).otherwise(F.col("name")).alias("name"), F.lit(True).alias("done"), F.col("file").alias("to_file"), F.col("name").alias("to_name")).distinct()
    said = held.where("kind in ('ExportSpecifier', 'ExportAssignment')").select("file", "name", F.col("imported").alias("local"), "module")
    local = said.where("module is null").join(shuffled(own.select("file", F.col("name").alias("local"), F.lit(True).alias("here"))), ["file", "local"], "left")
    here = local.where("here").select("file", "name", F.lit(True).alias("done"), F.col("file").alias("to_file"), F.col("local").alias("to_name"))
    passed = local.where("here is null").join(shuffled(brought.withColumnRenamed("name", "local")), ["file", "local"]).select("file", "name", F.lit(False).alias("done"), "to_file", "to_name")
    onward = said.where("module is not null").join(shuffled(at), ["file", "module"]).select("file", "name", F.lit(False).alias("done"), "to_file", F.col("local").alias("to_name"))
    steps = kept(shown.unionByName(here).unionByName(passed).unionByName(onward).distinct(), "exports")
    stars = held.where("kind = 'ExportStar'").join(shuffled(at), ["file", "module"]).select(F.col("file").alias("at_file"), F.col("to_file").alias("star")).distinct()

    wanted = brought.select(F.col("to_file").alias("file"), F.col("to_name").alias("name")) if wanted is None else wanted
    front = wanted.select("file", "name").distinct().select("file", "name", F.col("file").alias("at_file"), F.col("name").alias("at_name"), F.array(_key("file", "name")).alias("seen"))
    found, here = None, steps.select(F.col("file").alias("at_file"), F.col("name").alias("at_name"), "done", "to_file", "to_name")
    while True:
        met = kept(front.join(shuffled(here), ["at_file", "at_name"], "left"), "met")
        done = met.where("done").select("file", "name", "to_file", "to_name")
        found = done if found is None else found.unionByName(done)
        if not met.where("done is null or not done").limit(1).count():
            break
        through = met.where("done is null and at_name <> 'default'").join(shuffled(stars), "at_file").select("file", "name", F.col("star").alias("to_file"), F.col("at_name").alias("to_name"), "seen")
        onward = met.where("not done").select("file", "name", "to_file", "to_name", "seen").unionByName(through).withColumn("_key", _key("to_file", "to_name"))
        # Of several ways to a key one is enough: what follows is the same.
        onward = onward.where(~F.array_contains("seen", F.col("_key"))).groupBy("file", "name", "to_file", "to_name").agg(F.first(F.array_append("seen", F.col("_key"))).alias("seen"))
        front = onward.select("file", "name", F.col("to_file").alias("at_file"), F.col("to_name").alias("at_name"), "seen")
    one = found.distinct().groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("to_file", "to_name")).alias("to"))
    return one.where("n = 1").select("file", "name", "to.to_file", "to.to_name")


def scope(held: DataFrame) -> DataFrame:
    """file, name, to_file, to_name: what each type name that a file declares or imports means; imports that can't be
    resolved (packages, absent or ambiguous names) have no row. A file's own declaration hides an import of its name."""
    own = declared(held)
    mine = own.select("file", "name", F.col("file").alias("to_file"), F.col("name").alias("to_name"))
    if not held.where(F.col("kind").isin(*_BROUGHT)).limit(1).count():
        return kept(mine, "scope")
    at = kept(modules(held), "modules")
    brought = held.where(F.col("kind").isin(*_BROUGHT)).join(shuffled(at), ["file", "module"]).groupBy("file", "name").agg(F.min_by(F.struct("to_file", "imported"), "node_id").alias("b"))
    brought = brought.join(shuffled(own), ["file", "name"], "left_anti").select("file", "name", F.col("b.to_file").alias("_from"), F.col("b.imported").alias("_as"))
    found = exported(held, at=at).select(F.col("file").alias("_from"), F.col("name").alias("_as"), "to_file", "to_name")
    return kept(mine.unionByName(brought.join(shuffled(found), ["_from", "_as"]).select("file", "name", "to_file", "to_name")), "scope")


# ---------------------------------------------------------------- what is inherited


def heritage(held: DataFrame, names: DataFrame) -> DataFrame:
    """file, name, ord, to_file, to_name: the declarations that an interface extends, in order, and those that an alias of
    plain names stands for (`type A = B`, `type A = B & C`). Type arguments of a head are not followed; heads whose name
    has no declaration (of packages, utility types) have no row."""
    parts = F.when(F.col("kind") == "InterfaceDeclaration", F.col("extends")).when(F.col("type").rlike(r"^\s*[\w$]+(\s*&\s*[\w$]+)*\s*$"), F.split("type", "&"))
    heads = held.where("kind in ('InterfaceDeclaration', 'TypeAlias') and top").select("file", "name", "node_id", F.posexplode(parts).alias("at", "head"))
    heads = heads.select("file", "name", (F.col("node_id").cast("long") * 1000 + F.col("at")).alias("ord"), F.regexp_extract("head", r"^\s*([A-Za-z_$][\w$]*)\s*(<.*)?$", 1).alias("head"))
    return heads.join(shuffled(names.withColumnRenamed("name", "head")), ["file", "head"]).select("file", "name", "ord", "to_file", "to_name")


def ancestry(held: DataFrame, names: DataFrame) -> DataFrame:
    """file, name, way, at_file, at_name: each declaration, with an empty way, and all that it inherits from; `way` has the
    places of the heads that lead there, so that ways in order are the order in which members count. Circles end where
    they close; of several ways to one declaration in a round the first is kept."""
    up = kept(heritage(held, names), "heritage").select(F.col("file").alias("at_file"), F.col("name").alias("at_name"), "ord", "to_file", "to_name")
    front = kept(declared(held).select("file", "name", F.array().cast("array<long>").alias("way"), F.col("file").alias("at_file"), F.col("name").alias("at_name"), F.array(_key("file", "name")).alias("seen")), "ancestry")
    every = None
    while front.limit(1).count():
        every = front if every is None else every.unionByName(front)
        met = front.join(shuffled(up), ["at_file", "at_name"]).withColumn("_key", _key("to_file", "to_name")).where(~F.array_contains("seen", F.col("_key")))
        best = met.groupBy("file", "name", "to_file", "to_name").agg(F.min(F.struct(F.array_append("way", F.col("ord")).alias("way"), F.array_append("seen", F.col("_key")).alias("seen"))).alias("w"))
        front = kept(best.select("file", "name", "w.way", F.col("to_file").alias("at_file"), F.col("to_name").alias("at_name"), "w.seen"), "ancestry")
    return front.drop("seen") if every is None else every.drop("seen")


def properties(held: DataFrame, names: DataFrame) -> DataFrame:
    """file, owner, place, name, said, optional, doc, in_file, in_owner of every property of every type, inherited ones
    included.

    A type's own members come first, then those of its heads in order, each head's own before what it inherits; the
    first declaration of a name in that order counts. in_file and in_owner tell where that is. Inline object types are
    owners too (`Owner.member`) and inherit nothing. Repeated interfaces of a file merge.
    """
    members = held.where("kind = 'PropertySignature'").select(F.col("file").alias("at_file"), F.col("owner").alias("at_name"), "node_id", F.col("name").alias("member"), "type", "optional", "doc")
    own = declared(held)
    inline = members.join(shuffled(own.select(F.col("file").alias("at_file"), F.col("name").alias("at_name"))), ["at_file", "at_name"], "left_anti")
    inline = inline.select(F.col("at_file").alias("file"), F.col("at_name").alias("name"), F.array().cast("array<long>").alias("way"), "at_file", "at_name", "node_id", "member", "type", "optional", "doc")
    found = ancestry(held, names).join(shuffled(members), ["at_file", "at_name"]).unionByName(inline)
    first = found.groupBy("file", "name", "member").agg(F.min(F.struct("way", "node_id", "at_file", "at_name", "type", "optional", "doc")).alias("m"))
    out = first.groupBy("file", "name").agg(F.array_sort(F.collect_list(F.struct("m.way", "m.node_id", "member", "m"))).alias("all"))  # the properties of one type
    out = out.select("file", "name", F.posexplode("all").alias("place", "x"))
    return out.select("file", F.col("name").alias("owner"), "place", F.col("x.member").alias("name"), F.col("x.m.type").alias("said"), F.col("x.m.optional").alias("optional"), F.col("x.m.doc").alias("doc"), F.col("x.m.at_file").alias("in_file"), F.col("x.m.at_name").alias("in_owner"))


# ---------------------------------------------------------------- trees


def edges(held: DataFrame) -> DataFrame:
    """owner, name, said, target of every property, as type_tree takes them: owners and targets are keys of (file, name),
    and a type's names are looked up in the file that declares the member. The table is written."""
    names = scope(held)
    props = kept(properties(held, names), "properties")
    named = props.select("file", "owner", "name", "said", "in_file", F.explode_outer(type_targets("said", F.concat_ws(".", "in_owner", "name"))).alias("want"))
    inline = F.col("want").contains(".")
    met = named.join(shuffled(names.select(F.col("file").alias("in_file"), F.col("name").alias("want"), "to_file", "to_name")), ["in_file", "want"], "left")
    target = F.when(inline, _key("in_file", "want")).otherwise(F.when(F.col("to_file").isNotNull(), _key("to_file", "to_name")))
    return kept(met.select(_key("file", "owner").alias("owner"), "name", "said", target.alias("target")), "edges")


def trees(held: DataFrame, roots: DataFrame | None = None, max_depth: int = 4) -> DataFrame:
    """file, root, path, depth, name, said of every type's properties, own and inherited, followed along references.

    held: symbols(). roots: (file, interface) to begin at; all types, inline ones too, if None. A type is followed where
    it is declared, in whatever file; one that is on its path already, or that no file declares, stays as text.
    """
    start = None if roots is None else roots.select(_key("file", "interface").alias("owner")).distinct()
    out = type_tree(held.sparkSession, edges(held), max_depth, start=start)
    part = lambda k: F.split_part("root", F.lit(_BETWEEN), F.lit(k))
    return out.select(part(1).alias("file"), part(2).alias("root"), "path", "depth", "name", "said")


def last_trees(held: DataFrame, max_depth: int = 4) -> DataFrame:
    """The tree of the last interface of each file alone, as a file that is written again keeps the last."""
    tops = held.where("kind = 'InterfaceDeclaration' and top").groupBy("file").agg(F.max_by("name", "node_id").alias("interface"))
    return trees(held, tops, max_depth)
