"""Merkle manifest of a table: a tree of digests for each group, a tree over the groups' roots, and a proof for each row.

Trees are ternary and ragged. Leaves of a group are cut into aligned blocks; inside a block the fractal traversal emits
one authentication path after the other from stacked subtrees. The blocks' roots are the leaves of the next round, and
so on until each group is one node; the upper paths are appended by joins on blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loam.llm.common import materialize, table

#: Children of a node; levels of an aligned block (3^6 leaves) and of the subtrees that are stacked inside it.
FAN, BLOCK_LEVELS, SUBTREE_LEVELS = 3, 6, 2

PROOF = "array<struct<left:string,right:string>>"

#: The columns of a documents row that its leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex of the sha256 of the parts' bytes in a row."""
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and its text, or `-` if it is null."""
    return digest(*(F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(proof, start, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]).cast("binary"), 256))


# ---------------------------------------------------------------- fractal traversal of a block


def _parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class _Subtree:
    """Nodes of levels bottom..top - 1 above the leaves of one aligned range; it is filled a leaf at a time.

    What is below `bottom` is only kept on the stack, three nodes a level at most, until it is hashed into its parent.
    """

    def __init__(self, leaves: list[str], index: int, bottom: int, top: int):
        self.leaves, self.bottom, self.top = leaves, bottom, top
        self.at, self.end = index * FAN**top, min((index + 1) * FAN**top, len(leaves))
        self.nodes: list[list[str]] = [[] for _ in range(top - bottom)]
        self.first = [index * FAN ** (top - level) for level in range(bottom, top)]
        self.stack: list[list[str]] = [[] for _ in range(top)]

    def step(self) -> None:
        """Takes the next leaf; the last one of the range closes its ragged runs."""
        if self.at >= self.end:
            return
        node, self.at = self.leaves[self.at], self.at + 1
        for level in range(self.top):
            if level >= self.bottom:
                self.nodes[level - self.bottom].append(node)
            run = self.stack[level]
            run.append(node)
            if len(run) < FAN and self.at < self.end:
                return
            node = _parent(run)
            self.stack[level] = []

    def run(self, level: int, node: int) -> tuple[str, str]:
        """The siblings of a node, those on its left and those on its right, as texts."""
        held, own = self.nodes[level - self.bottom], node - self.first[level - self.bottom]
        begin = own - own % FAN
        return "".join(held[begin:own]), "".join(held[own + 1 : begin + FAN])


def traverse(leaves: list[str], levels: int, height: int = SUBTREE_LEVELS) -> Iterator[list[tuple[str, str]]]:
    """The authentication path of each leaf of a block in order, as (left, right) siblings of each level.

    The levels are cut into strata of `height`. Each stratum holds the subtree that the present leaf is in, and the next
    one of it, which takes one leaf for each path that is emitted and so is whole just when it is needed. Thus a block
    keeps two subtrees for each stratum and a stack, not its tree; leaves are read where they lie.
    """
    strata = [(bottom, min(bottom + height, levels)) for bottom in range(0, levels, height)]
    held = []
    for bottom, top in strata:
        now = _Subtree(leaves, 0, bottom, top)
        while now.at < now.end:
            now.step()
        held.append([now, _Subtree(leaves, 1, bottom, top), 1])
    path: list[tuple[str, str]] = [("", "")] * levels
    for k in range(len(leaves)):
        for s, (bottom, top) in enumerate(strata):
            if k and k % FAN**top == 0:
                held[s][:2] = held[s][1], _Subtree(leaves, held[s][2] + 1, bottom, top)
                held[s][2] += 1
            for level in range(bottom, top):
                if k % FAN**level == 0:  # the node above this leaf has changed
                    path[level] = held[s][0].run(level, k // FAN**level)
        yield list(path)
        for _, coming, _ in held:
            coming.step()


def _levels(n: int, most: int) -> int:
    """Levels above n nodes until one is left, `most` at most."""
    levels = 0
    while levels < most and n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


# ---------------------------------------------------------------- positions, blocks, rounds


def with_positions(rows: DataFrame, group: str, order: list[str], tag: str) -> DataFrame:
    """rows with `_pos` (from 0 inside a group, by the order columns) and `_all` (rows of the group).

    Rows are dealt by ranges and numbered where they lie; a table of a row for each group and partition says how many lie
    before. So a group of any size is spread over as many tasks as its rows fill.
    """
    held = rows.repartitionByRange(F.col(group), *(F.col(c) for c in order)).sortWithinPartitions(group, *order)
    held = materialize(held.withColumn("_at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_at", 33)
    pieces = held.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_min"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.select(group, "_part", (before - F.col("_min")).alias("_shift"), F.sum("_n").over(own).alias("_all"))
    return held.withColumn("_part", part).join(starts, [group, "_part"]).withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _block(levels: int) -> Column:
    return F.expr(f"_pos div {FAN**levels}")


def _block_paths(rows: DataFrame, group: str, levels: int) -> DataFrame:
    """rows (_pos, _all, node and others) with `proof`, the path of each node inside its block, in place of _all."""
    kept = [c for c in rows.columns if c != "_all"]

    def run(block: pa.Table) -> pa.Table:  # FAN^levels rows at most
        block = block.sort_by("_pos")
        whole = block.column("_all")[0].as_py()
        up = levels if whole > FAN**levels else _levels(whole, levels)
        runs = [run for path in traverse(block.column("node").to_pylist(), up) for run in path]
        sides = [pa.array([r[k] for r in runs], pa.string()) for k in (0, 1)]
        ends = pa.array([up * k for k in range(block.num_rows + 1)], pa.int32())
        return pa.table([*(block.column(c) for c in kept), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(sides, ["left", "right"]))], names=[*kept, "proof"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), f"proof {PROOF}"])
    return rows.groupBy(group, _block(levels)).applyInArrow(run, schema)


def forest(rows: DataFrame, group: str, order: list[str], levels: int = BLOCK_LEVELS, tag: str = "tree") -> tuple[DataFrame, DataFrame]:
    """rows with `position` and `proof` (siblings up to the group's root), and the roots: (group, node).

    rows: group (text, not null), node (the leaf digest), order columns that tell rows apart, and columns that are
    carried along. Each round works on aligned blocks of 3^levels nodes and leaves one node for each of them, so a few
    rounds do for any number of rows; only a count of each round reaches the driver.
    """
    lower = materialize(_block_paths(with_positions(rows, group, order, f"{tag}-order"), group, levels), tag)
    root = lower.where(F.col("_pos") % FAN**levels == 0).select(group, _block(levels).alias("_place"), fold(F.col("node"), F.col("proof")).alias("node"))
    root = materialize(root, f"{tag}-roots")
    if not root.where("_place > 0").limit(1).count():
        return lower.withColumnRenamed("_pos", "position"), root.drop("_place")
    upper, top = forest(root, group, ["_place"], levels, f"{tag}-up")
    upper = upper.select(group, F.col("_place").alias("_block"), F.col("proof").alias("_upper"))
    # A block's rows meet its upper path: 3^levels rows of a key at most.
    met = lower.withColumn("_block", _block(levels)).join(upper, [group, "_block"])
    return met.withColumn("proof", F.concat("proof", "_upper")).drop("_upper", "_block").withColumnRenamed("_pos", "position"), top


def manifest(rows: DataFrame, group: Column, key: Column, node: Column, carried: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """key, leaf, carried columns, position (in the group), subroot, root, proof: a row for each row of the table.

    Leaves of a group stand by key (nulls first), then by digest; groups stand by their UTF-8 bytes, null ahead of all
    others, the empty text being a group of its own. Repeated rows are leaves of their own, in turn; null keys are keys; an
    empty table gives no row. Only the columns that are passed in are read, whatever else the table has.
    """
    carried = carried or {}
    own = rows.select(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("_group"), key.alias("_key"), node.alias("node"), *(c.alias(f"c_{n}") for n, c in carried.items()))
    # Equal rows are told apart by where they lie, so that even they can be dealt to several tasks.
    own = materialize(own.withColumn("_nth", F.monotonically_increasing_id()), "leaves")
    leaves, roots = forest(own, "_group", ["_key", "node", "_nth"], levels)
    above, top = forest(roots.select(F.lit("").alias("_every"), F.col("_group").alias("_of"), "node"), "_every", ["_of"], levels, "groups")
    above = above.select(F.col("_of").alias("_group"), F.col("node").alias("subroot"), F.col("proof").alias("_above"))
    held = leaves.join(above, "_group").crossJoin(F.broadcast(top.select(F.col("node").alias("root"))))  # one row
    return held.select(
        F.col("_key").alias("key"), F.col("node").alias("leaf"), *(F.col(f"c_{n}").alias(n) for n in carried), "position", "subroot", "root", F.concat("proof", "_above").alias("proof")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and what becomes of each proof if some texts lose their line feeds.

    A null doc_id is `-` in its leaf and is never tampered with; null texts stay null.
    """
    docs = table(spark, sf_dir, "documents")
    own = [F.col(c) for c in COLUMNS]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    tampered = F.when(hit, leaf(*own[:-1], F.translate("text", "\n", "")))
    held = manifest(docs, F.col("source"), F.col("doc_id"), leaf(*own), {"tampered": tampered})
    siblings = F.array_join(F.transform("proof", lambda r: F.concat(r["left"], r["right"])), "")
    held = held.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return held.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
