"""Merkle manifest of a table: hash trees over fixed-size ordered arrays of nodes, collapsed by SQL.

Leaves of a group are numbered in order without a task that holds a group, and dealt to
blocks of a fixed number of consecutive leaves. Inside a block the levels are array
expressions: `sequence` numbers the runs of a level, `slice` takes each, `aggregate` joins
it, `transform` makes the next level, and an outer `aggregate` stacks the levels. Block
roots are nodes again, so the same step repeats over them until each group has one node; the
groups' nodes go through it once more. A path of a leaf is an array of (before, after), the
hashes that stand left and right of it in its run, one for each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.rows import own
from lodestrand.operators.bm25 import small
from lodestrand.operators.numbering import numbered
from lodestrand.runtime import lifetime, materialize

#: Leaves of a block at most; a power of the fan-out below it is taken.
BLOCK = 1_024
_STEP = "struct<before:string,after:string>"


def digest(text: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of a text's UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value as text: no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hash of a row's values."""
    return digest(F.concat(*map(field, values)))


def _joined(nodes: Column, start: Column, length: Column | int) -> Column:
    return F.aggregate(F.slice(nodes, start, length), F.lit(""), lambda a, x: F.concat(a, x))


def _next(nodes: Column, fan_out: int) -> Column:
    """The level above: each run of fan_out nodes as its hash."""
    runs = F.sequence(F.lit(1), F.size(nodes), F.lit(fan_out))
    return F.transform(runs, lambda at: digest(_joined(nodes, at, fan_out)))


def _levels(nodes: Column, heights: Column, fan_out: int, then) -> Column:
    """then(levels) of an array's levels, the given one first and as many above it as heights has entries."""
    start = F.array(nodes)
    return F.aggregate(heights, start, lambda levels, _: F.concat(levels, F.array(_next(F.element_at(levels, -1), fan_out))), then)


def _path(levels: Column, heights: Column, index: Column, fan_out: int) -> Column:
    """What stands before and after a leaf's node in its run, level by level."""

    def step(h: Column) -> Column:
        nodes = F.element_at(levels, h)
        at = F.floor(index / F.pow(F.lit(fan_out), h - 1)).cast("int")  # the node's index in its level
        first = at - at % fan_out
        return F.struct(_joined(nodes, first + 1, at - first).alias("before"), _joined(nodes, at + 2, fan_out - 1 - (at - first)).alias("after"))

    return F.transform(heights, step)


def _heights(block: Column, size: Column, fan_out: int, depth: int) -> Column:
    """1, 2, ... for the levels above a block's nodes: all of a full block, and those that a group with one block needs."""
    powers = F.array(*[F.lit(fan_out**h) for h in range(depth)])
    numbers = F.array(*[F.lit(h + 1) for h in range(depth)])
    return F.slice(numbers, F.lit(1), F.when(block == 0, F.size(F.filter(powers, lambda p: p < size))).otherwise(depth))


def _folded(nodes: DataFrame, group: str, fan_out: int, depth: int, name: str) -> DataFrame:
    """Blocks of nodes (group, pos, item with its node): group, block, items in order, and the block's root as node."""
    width = fan_out**depth
    blocks = nodes.groupBy(group, F.floor(F.col("pos") / width).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("items"))
    heights = _heights(F.col("block"), F.size("items"), fan_out, depth)
    root = _levels(F.transform("items", lambda x: x["item"]["node"]), heights, fan_out, lambda levels: F.element_at(F.element_at(levels, -1), 1))
    return materialize(blocks.withColumn("node", root), name)


def _opened(blocks: DataFrame, fan_out: int, depth: int, *keep: str) -> DataFrame:
    """Each item of blocks with its pos and its path inside its block; the columns keep are the block's."""
    heights = _heights(F.col("block"), F.size("items"), fan_out, depth)
    row = lambda levels, x: F.struct(x["pos"].alias("pos"), x["item"].alias("item"), _path(levels, heights, (x["pos"] - F.col("block") * fan_out**depth).cast("int"), fan_out).alias("path"))
    each = _levels(F.transform("items", lambda x: x["item"]["node"]), heights, fan_out, lambda levels: F.transform("items", lambda x: row(levels, x)))
    return blocks.select(*keep, F.explode(each).alias("x")).select(*keep, "x.*")


def _climbed(blocks: DataFrame, group: str, fan_out: int, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """The one node of each group, as (group, node), and the heights of blocks above the given ones."""
    above: list[DataFrame] = []
    while not (now := above[-1] if above else blocks).where("block > 0").isEmpty():
        nodes = now.select(group, F.col("block").alias("pos"), F.struct("node").alias("item"))
        above.append(_folded(nodes, group, fan_out, depth, "merkle-above"))
    return now.select(group, "node"), above


def manifest(rows: DataFrame, group: Column, order: Column, node: Column, fan_out: int = 2, block: int = BLOCK) -> DataFrame:
    """Every row with its place in the hash tree: the input's columns and leaf, subroot, root, path.

    Leaves (node, hexadecimal hashes) of a group stand in the order given, ascending with null
    first; ties go by the leaf, and equal leaves are alike. While a level has several nodes,
    every fan_out consecutive ones (the last run: fewer, even one) become the hash of their
    joined text. subroot is the group's last node; subroots in order of group (null first,
    bytewise) make root in the same way. path holds the hashes beside the row's node in its
    run, `before` and `after` it, from its leaf to the root; levels without any hold empty
    texts. Input columns named like an output, in any case, are replaced. An empty table gives
    no rows. What one task holds of a group is a block of at most `block` leaves.
    """
    depth = 1
    while fan_out ** (depth + 1) <= block:
        depth += 1
    with lifetime(rows.sparkSession) as keep:
        return _manifest(rows, group, order, node, fan_out, depth, keep)


def _manifest(rows: DataFrame, group: Column, order: Column, node: Column, fan_out: int, depth: int, keep) -> DataFrame:
    out = ("leaf", "subroot", "root", "path")
    kept = [(c, x) for c, x in zip(rows.columns, own(rows)) if c.lower() not in out]
    names = [f"c{i}" for i in range(len(kept))]
    slim = rows.select(group.alias("group"), order.alias("order"), node.alias("node"), F.struct(*[x.alias(n) for n, (_, x) in zip(names, kept)]).alias("row"))
    # Equal rows of a hot id are dealt to several parts by where they were read.
    placed = numbered(slim.withColumn("read", F.monotonically_increasing_id()), "order", "node", "read", groups=("group",), name="pos", start=0)
    leaves = _folded(placed.select("group", "pos", F.struct("node", "row").alias("item")), "group", fan_out, depth, "merkle-leaves")
    tops, above = _climbed(leaves, "group", fan_out, depth)

    # The tree over the groups' nodes, as one group.
    tops = numbered(tops, "group", name="pos", start=0)
    subroots = _folded(tops.select(F.lit(0).alias("one"), "pos", F.struct(F.col("node"), F.col("group")).alias("item")), "one", fan_out, depth, "merkle-groups")
    root, over = _climbed(subroots, "one", fan_out, depth)

    # Paths from the top down: of the blocks of groups, of groups, of the blocks of leaves.
    up = root.select(F.lit(0).cast("bigint").alias("p"), F.array().cast(f"array<{_STEP}>").alias("up"), F.col("node").alias("root"))
    for b in reversed(over):
        opened = _opened(b, fan_out, depth, "block")
        up = opened.join(small(up), F.col("block") == F.col("p")).select(F.col("pos").alias("p"), F.concat("path", "up").alias("up"), "root")
    opened = _opened(subroots, fan_out, depth, "block")
    of_group = opened.join(small(up), F.col("block") == F.col("p"))
    up = of_group.select(F.col("item.group").alias("g"), F.lit(0).cast("bigint").alias("p"), F.concat("path", "up").alias("up"), F.col("item.node").alias("subroot"), "root")
    for b in reversed(above):
        opened = _opened(b, fan_out, depth, "group", "block")
        joined = opened.join(small(up), F.col("group").eqNullSafe(F.col("g")) & (F.col("block") == F.col("p")))
        up = joined.select(F.col("group").alias("g"), F.col("pos").alias("p"), F.concat("path", "up").alias("up"), "subroot", "root")
    known = materialize(up, "merkle-up")
    keep(leaves, known)

    # Joined as blocks, so that a path above is met once for each block; then every leaf gets its own.
    met = leaves.join(small(known), F.col("group").eqNullSafe(F.col("g")) & (F.col("block") == F.col("p")))
    found = _opened(met, fan_out, depth, "block", "up", "subroot", "root")
    return found.select(
        *[F.col(f"item.row.{n}").alias(c) for n, (c, _) in zip(names, kept)],
        F.col("item.node").alias("leaf"),
        "subroot",
        "root",
        F.concat("path", "up").alias("path"),
    )


def proof(path: Column) -> Column:
    """The hash of all siblings of a path, from the leaf up and left to right."""
    return digest(F.aggregate(path, F.lit(""), lambda a, s: F.concat(a, s["before"], s["after"])))


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, node, lambda a, s: digest(F.concat(s["before"], a, s["after"])))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def audited(docs: DataFrame, tampered: Column, change: tuple[str, Column], fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", **how) -> DataFrame:
    """The manifest of a table and what its proofs say of a copy in which some rows were changed.

    change names a field and its value in the tampered rows. Returns doc_id, leaf, subroot,
    root, proof_sha256 (all of the table as it is), folded_root (from the copy's row along
    the table's path) and verified (whether that is the root). Null values are a leaf of
    their own (`-`), null ids come first, repeated rows each have a place, an empty table
    gives no rows; columns that are no field play no part.
    """
    name, value = change
    col = dict(zip(docs.columns, own(docs)))
    whole = [col[f] for f in fields]
    other = [F.when(tampered, value).otherwise(col[f].cast("string")) if f == name else col[f] for f in fields]
    rows = docs.select(col[id_col].cast("bigint").alias("doc_id"), col[group_col].cast("string").alias("of"), leaf(*whole).alias("node"), leaf(*other).alias("copy"))
    found = manifest(rows, F.col("of"), F.col("doc_id"), F.col("node"), **how)
    back = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("copy"), F.col("path")).alias("folded_root"))
    return back.withColumn("verified", F.col("folded_root") == F.col("root"))
