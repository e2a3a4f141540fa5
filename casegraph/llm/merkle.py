"""Merkle manifest of a dataset: a digest for each row, a tree for each group, a tree over the groups, and a proof for each row.

A row's rank in its group is a number of base-8 digits, one for each level of its tree. Rows of one block (512 consecutive ranks) come
together in one exchange; there the last digit is grouped away first, then the one before, then the third, and each grouping nests the
child structs into their parent, so a block becomes one row: a struct of 8 structs of 8 structs of 8 leaves. The blocks' digests are
the leaves of the next table of blocks, until each group has one block. A proof needs no join of leaves: a transform walks down the
nested structs, adds at each step the digests left and right of the child, and explodes the block. Only where a group has more than one
block do its block rows (one for each 512 leaves) meet the proofs of their parents, on the block's number.

Ranks come from one range exchange by group and order: the place in the written partition plus the rows of the group in partitions before.
A group with a third of all rows (or with all) is many partitions and many blocks. Texts aren't shuffled, only digests are.

Defined cases: a null field is `-`; a null group is a group of its own, before all others; null ids come first in their group; rows of
equal id go by their digest, so equal rows are leaves of their own side by side; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A node has 2**BITS children at most, a block DIGITS levels.
BITS, DIGITS = 3, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The digests left and right of a node in its run.
SIDES = "struct<left: string, right: string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: every value with its length before it, so that no two rows have the same input."""
    return digest(*map(field, values))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n["digest"]), "")


def _ranked(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with rank (from 0, in their group g) and height (levels of the group's tree), written."""
    # The place holds the partition in its upper bits; the table keeps it, so every later pass sees the same ranks.
    placed = written(rows.repartitionByRange("g", *by).sortWithinPartitions("g", *by).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    group = Window.partitionBy("g")
    before, size = F.sum("n").over(group.orderBy("part")) - F.col("n"), F.sum("n").over(group)
    height = F.when(size == 1, 0).otherwise(F.ceil(F.length(F.bin(size - 1)) / BITS)).cast("int")
    shifts = parts.select("g", "part", (before - F.col("first")).alias("shift"), height.alias("height"))  # a row for each partition and group in it
    return placed.join(shifts, ["g", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _rolled(nodes: DataFrame, below: int) -> DataFrame:
    """g, block, height, node: the blocks of nodes (g, rank, height, node), which stand `below` levels over the leaves."""
    digits = [f"d{k}" for k in range(DIGITS)]
    digit = lambda k: F.shiftright("rank", BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    rows = nodes.select("g", F.shiftright("rank", BITS * DIGITS).alias("block"), "height", *(digit(k).alias(d) for k, d in enumerate(digits)), "node").repartition("g", "block")
    for k, d in enumerate(digits):
        run = F.sort_array(F.collect_list(F.struct(d, "node")))
        rows = rows.groupBy("g", "block", "height", *digits[k + 1 :]).agg(F.transform(run, lambda x: x["node"]).alias("children"))
        # Above its root a tree has nothing: the only node goes up as it is.
        active = F.col("height") > below + k
        rows = rows.withColumn("node", F.struct(F.when(active, F.sha2(_joined(F.col("children")), 256)).otherwise(F.col("children")[0]["digest"]).alias("digest"), active.alias("active"), "children")).drop("children")
    return rows


def _forest(rows: DataFrame, by: Sequence[str]) -> list[DataFrame]:
    """The tables of blocks over rows (g, the columns of by, node), each written; in the last each group has one block."""
    nodes, levels = _ranked(rows, by), []
    while True:
        blocks = written(_rolled(nodes, DIGITS * len(levels)))
        levels.append(blocks)
        if (blocks.agg(F.max("height")).first()[0] or 0) <= DIGITS * len(levels):
            return levels
        nodes = blocks.select("g", F.col("block").alias("rank"), "height", F.struct(F.col("node.digest").alias("digest")).alias("node"))


def _unrolled(levels: list[DataFrame], tops: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Every leaf (node) with its path to the root, and the columns of carry; tops has g, the path from the group's root on, and those."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(levels) - 1, -1, -1):
        found = levels[k].join(above, ["g", "block"])
        found = found.withColumn("steps", F.array(F.struct("node", "path")))
        for _ in range(DIGITS):
            found = found.withColumn("steps", F.flatten(F.transform("steps", _children)))
        found = found.select("g", "block", *carry, F.posexplode("steps").alias("place", "step"))
        rank = F.shiftleft("block", BITS * DIGITS) + F.col("place")
        above = found.select("g", rank.alias("block"), *carry, F.col("step.node").alias("node"), F.col("step.path").alias("path"))
        above = above.drop("node") if k else above.drop("block")
    return above


def _children(step: Column) -> Column:
    """The children of a node, each with the digests beside it put before the node's path."""
    children = step["node"]["children"]

    def child(node: Column, i: Column) -> Column:
        sides = F.struct(_joined(F.slice(children, F.lit(1), i)).alias("left"), _joined(F.slice(children, i + 2, F.lit(1 << BITS))).alias("right"))
        return F.struct(node.alias("node"), F.concat(F.when(step["node"]["active"], F.array(sides)).otherwise(F.expr(f"cast(array() as array<{SIDES}>)")), step["path"]).alias("path"))

    return F.transform(children, child)


def proofs(leaves: DataFrame) -> DataFrame:
    """Of leaves (group, id, leaf, and a struct `carried`): leaf, carried, subroot, root and path, which is a list of the digests left and
    right of the leaf and of its ancestors, up to the root."""
    key = F.when(F.col("group").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("group").cast("string")))  # `-` sorts before `=`
    rows = leaves.select(key.alias("g"), "id", "leaf", F.struct(F.col("leaf").alias("digest"), "carried").alias("node"))
    groups = _forest(rows, ["id", "leaf"])
    subroots = groups[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), F.struct(F.col("node.digest").alias("digest"), F.struct("g").alias("carried")).alias("node"))
    top = _forest(subroots, ["key"])
    root = top[-1].select("g", F.expr(f"cast(array() as array<{SIDES}>)").alias("path"), F.col("node.digest").alias("root"))
    tops = _unrolled(top, root, ["root"]).select(F.col("node.carried.g").alias("g"), "path", F.col("node.digest").alias("subroot"), "root")
    return _unrolled(groups, tops, ["subroot", "root"]).select(F.col("node.digest").alias("leaf"), F.col("node.carried").alias("carried"), "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, sides: digest(sides["left"], node, sides["right"]))


def path_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda sides: F.concat(sides["left"], sides["right"])), ""), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """doc_id, leaf, subroot, root, path of every row of docs."""
    leaves = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf([F.col(f) for f in fields]).alias("leaf"), F.struct(F.col(id_col).alias("doc_id")).alias("carried"))
    return proofs(leaves).select("carried.doc_id", "leaf", "subroot", "root", "path")


def tampered(docs: DataFrame) -> DataFrame:
    """Every row's proof, checked against a row whose text is lower-cased (A-Z) where 3 divides the crc32 of its id."""
    honest = [F.col(f) for f in FIELDS]
    changed = [F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select("doc_id", F.col("lang").alias("group"), leaf(honest).alias("leaf"), F.when(hit, leaf(changed)).alias("changed"))
    found = proofs(rows.select("group", F.col("doc_id").alias("id"), "leaf", F.struct("doc_id", "changed").alias("carried")))
    return found.select(
        "carried.doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("carried.changed", "leaf"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
