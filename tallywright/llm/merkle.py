"""Merkle manifest of a dataset in blocks that are laid out after van Emde Boas.

Rows become leaves; leaves of one group (here a language), in the order of their keys, are the lowest nodes of a tree in
which every `FAN` consecutive nodes (the last run may be shorter, even one) become one digest, until one remains. The
groups' roots, in the order of the groups, become one root in the same way.

A tree is cut into blocks of `height` levels over aligned runs of FAN ** height nodes. A block is a table row: its
digests stand in one byte string, a subtree split at half its height, the upper half first and then the lower halves
from left to right, each laid out likewise. The address of a node is computed from its depth and index alone, so
siblings at every depth are read without pointers and in few cache lines whatever their size. The roots of the blocks
are the lowest nodes of the next blocks, until each group has one block.

Spark deals by block: a task never holds more than a block's nodes, and a group with most rows is just more blocks. Ranks
inside a group come from one range shuffle of digests and keys; texts are hashed where they are read and never move.

Null groups are a group of their own and come first, null keys are ordered first, equal keys by their digest; equal rows
are equal leaves, one after another. A null value is `-`, an empty one `0:`, so the two differ. An empty table has no
leaves, no blocks and no rows. Columns that aren't named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tallywright.operators.ranking import join_null_safe
from tallywright.session import materialise

FAN = 8
HEIGHT = 4
BITS = 3  # of FAN
DIGEST = 32
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATH = ("places", "sizes", "others")


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows of values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


@cache
def layout(height: int) -> tuple[tuple[int, int, int], ...]:
    """For each depth of a full tree of so many levels: how many levels above it the upper part that it hangs from
    begins, the size of that part, and the size of the lower part it is the root of."""

    def nodes(levels: int) -> int:
        return (FAN**levels - 1) // (FAN - 1)

    table = [(0, 0, 0)] * height

    def split(top: int, levels: int) -> None:
        if levels < 2:
            return
        upper = levels // 2
        table[top + upper] = (upper, nodes(upper), nodes(levels - upper))
        split(top, upper)
        split(top + upper, levels - upper)

    split(0, height)
    return tuple(table)


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes of one depth, by their index from the left."""
    place = np.zeros(len(index), np.int64)
    table = layout(height)
    while depth:
        up, above, below = table[depth]
        place += above + index % FAN**up * below
        index = index // FAN**up
        depth -= up
    return place


def grow(digests: list[bytes], levels: int) -> bytes:
    """The laid out block over these lowest nodes, with so many levels above them."""
    height = levels + 1
    size = (FAN**height - 1) // (FAN - 1)
    # the lowest level is mostly full in all blocks but the last of a group
    block = np.zeros((size, DIGEST), np.uint8)
    for depth in range(levels, -1, -1):
        places = address(height, depth, np.arange(len(digests)))
        block[places] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)
        if depth:
            text = [d.hex().encode() for d in digests]
            digests = [sha256(b"".join(text[i : i + FAN])).digest() for i in range(0, len(text), FAN)]
    return block.tobytes()


def levels_of(n: int) -> int:
    """Levels above so many nodes until one remains."""
    levels = 0
    while n > 1:
        n = -(-n // FAN)
        levels += 1
    return levels


def number(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """(tree, rank, n) beside the columns: place in the tree by `order` and the tree's size.

    Rows are range partitioned; a partition holds runs of trees, and each run's place follows from the sizes of the runs
    before it, one row per tree and partition.
    """
    sort = ["tree", *order]
    dealt = materialise(nodes.withColumn("tie", F.monotonically_increasing_id()), "nodes")
    ranged = dealt.repartitionByRange(*sort, "tie").sortWithinPartitions(*sort, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "ranged")
    run = F.shiftright("at", 33)
    runs = ranged.groupBy("tree", run.alias("run")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "run", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"), F.sum("size").over(tree).alias("n"))
    joined = join_null_safe(ranged.withColumn("run", run), runs, ["tree", "run"])
    return joined.withColumn("rank", F.col("at") - F.col("first") + F.col("ahead")).drop("at", "run", "first", "ahead")


def blocks_of(members: DataFrame, height: int) -> DataFrame:
    """(tree, block, nodes, levels, digests, root) of the lowest blocks over (tree, rank, n, digest)."""
    kinds = {"block": LongType(), "nodes": LongType(), "levels": IntegerType(), "digests": BinaryType(), "root": BinaryType()}
    out = StructType([members.schema["tree"], *[StructField(c, t) for c, t in kinds.items()]])
    arrow = to_arrow_schema(out)
    whole = FAN**height

    def block(table: pa.Table) -> pa.Table:
        rank = table.column("rank").to_numpy()
        order = np.argsort(rank, kind="stable")
        n = table.column("n")[0].as_py()
        levels = height if n > whole else levels_of(n)
        laid = grow(table.column("digest").take(pa.array(order)).to_pylist(), levels)
        row = [table.column("tree")[0].as_py(), int(rank[0]) // whole, len(rank), levels, laid, laid[:DIGEST]]
        return pa.table([pa.array([v], t) for v, t in zip(row, arrow.types, strict=True)], schema=arrow)

    return members.select("tree", "rank", "n", "digest").groupBy("tree", F.shiftright("rank", BITS * height).alias("at")).applyInArrow(block, out)


def build(members: DataFrame, height: int) -> list[DataFrame]:
    """Written tables of blocks, lowest first, until each tree has one block."""
    tables = []
    while True:
        blocks = materialise(blocks_of(members, height), "blocks")
        tables.append(blocks)
        top = blocks.agg(F.max("block").alias("top")).first()["top"]
        if not top:  # one block a tree, or none at all
            return tables
        sizes = blocks.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
        members = join_null_safe(blocks.select("tree", F.col("block").alias("rank"), F.col("root").alias("digest")), sizes, ["tree"])


@cache
def offsets(height: int, depth: int) -> list[int]:
    """Where the digests of one depth begin in a block's bytes."""
    return (address(height, depth, np.arange(FAN**depth)) * DIGEST).tolist()


def walk(laid: bytes, nodes: int, levels: int, index: int) -> tuple[list[int], list[int], list[bytes]]:
    """Upwards from a lowest node of a block: place in its run, size of the run, and the other members of the run."""
    places, sizes, others = [], [], []
    for depth in range(levels, 0, -1):
        first = index - index % FAN
        last = min(first + FAN, nodes)
        places.append(index - first)
        sizes.append(last - first)
        others += [laid[p : p + DIGEST] for k, p in enumerate(offsets(levels + 1, depth)[first:last], first) if k != index]
        index //= FAN
        nodes = -(-nodes // FAN)
    return places, sizes, others


def paths(members: DataFrame, blocks: DataFrame, above: DataFrame | None, carry: Sequence[str], height: int) -> DataFrame:
    """Each member's columns `carry` with its path to the root: `places`, `sizes` and `others`, lowest first, and the
    other columns of `above`.

    blocks: the blocks that the members are the lowest nodes of; above: the paths of these blocks' roots, if they go on.
    """
    if above is None:
        upper = blocks.select("tree", "block", "nodes", "levels", "digests", *[F.lit(b"").alias(f"up_{c}") for c in PATH])
    else:
        up = above.select("tree", F.col("rank").alias("block"), *[F.col(c).alias(f"up_{c}") for c in above.columns if c not in ("tree", "rank")])
        upper = join_null_safe(blocks.select("tree", "block", "nodes", "levels", "digests"), up, ["tree", "block"])
    more = [c.removeprefix("up_") for c in upper.columns if c.startswith("up_") and c.removeprefix("up_") not in PATH]
    fields = members.select("tree", "rank", *carry)
    names = fields.columns
    whole = FAN**height
    out = StructType([*fields.schema.fields, *[StructField(c, BinaryType()) for c in (*PATH, *more)]])
    arrow = to_arrow_schema(out)

    def climb(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        block = right.to_pylist()[0]
        laid, nodes, levels = block["digests"], block["nodes"], block["levels"]
        found: list[list[bytes]] = [[], [], []]
        for rank in left.column("rank").to_pylist():
            places, sizes, others = walk(laid, nodes, levels, rank % whole)
            for kept, own, c in zip(found, (bytes(places), bytes(sizes), b"".join(others)), PATH, strict=True):
                kept.append(own + block[f"up_{c}"])
        columns = [left.column(c) for c in names] + [pa.array(v, pa.binary()) for v in found]
        columns += [pa.array([block[f"up_{c}"]] * left.num_rows, pa.binary()) for c in more]
        return pa.table(columns, names=arrow.names).cast(arrow)

    left = fields.groupBy("tree", F.shiftright("rank", BITS * height).alias("block"))
    return left.cogroup(upper.groupBy("tree", "block")).applyInArrow(climb, out)


def climb_all(members: DataFrame, tables: list[DataFrame], above: DataFrame | None, carry: Sequence[str], height: int) -> DataFrame:
    """Paths of all members through all blocks: the uppermost blocks first, each block's path given to its members."""
    for k in range(len(tables) - 1, 0, -1):
        above = paths(tables[k - 1].select("tree", F.col("block").alias("rank")), tables[k], above, [], height)
    return paths(members, tables[0], above, carry, height)


def manifest(
    docs: DataFrame, leaves: Column, key: str = "doc_id", group: str = "lang", carry: Sequence[Column] = (), height: int = HEIGHT
) -> tuple[DataFrame, list[DataFrame], DataFrame, list[DataFrame]]:
    """Written tables: numbered leaves (tree, key, digest, what is carried, rank, n) and the blocks of the groups' trees;
    then the numbered roots of the groups (group, digest) and the blocks of the one tree over them."""
    rows = docs.select(F.col(group).alias("tree"), F.col(key).alias("key"), leaves.alias("digest"), *carry)
    members = materialise(number(rows, ["key", "digest"]), "leaves")
    lower = build(members, height)
    roots = lower[-1].select(F.col("tree").alias("group"), F.col("root").alias("digest"), F.lit(0).alias("tree"))
    groups = materialise(number(roots, ["group"]), "groups")
    return members, lower, groups, build(groups, height)


def prove(docs: DataFrame, leaves: Column, key: str = "doc_id", group: str = "lang", carry: Sequence[Column] = (), height: int = HEIGHT) -> DataFrame:
    """(key, digest, carried columns, places, sizes, others, subroot, root): each leaf with its path to the root.

    `others` are the digests of the siblings, lowest run first and each run from left to right; `places` and `sizes` hold
    a byte per run: where the path's own node stands in it and how many nodes it has.
    """
    members, lower, groups, upper = manifest(docs, leaves, key, group, carry, height)
    tops = climb_all(groups, upper, None, ["group", "digest"], height)
    roots = tops.join(upper[-1].select("tree", "root"), "tree")  # one tree, one block at the top
    tail = roots.select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("rank"), *PATH, F.col("digest").alias("subroot"), "root")
    names = [c for c in members.columns if c not in ("tree", "rank", "n")]
    proofs = climb_all(members, lower, tail, names, height)
    return proofs.select(F.col("key").alias(key), *[c for c in proofs.columns if c not in ("tree", "rank", "key")])


def folded(proofs: DataFrame, start: str, out: str = "folded") -> DataFrame:
    """Adds the root that follows from the digest in column `start` and the path."""
    schema = StructType([*proofs.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (start, "places", "sizes", "others")]
            roots = [fold_up(*row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, out])

    return proofs.mapInArrow(run, schema)


def fold_up(digest: bytes, places: bytes, sizes: bytes, others: bytes) -> bytes:
    text = others.hex().encode()
    ends = [2 * DIGEST * e for e in accumulate((s - 1 for s in sizes), initial=0)]
    for place, a, b in zip(places, ends[:-1], ends[1:], strict=True):
        own = a + 2 * DIGEST * place
        digest = sha256(text[a:own] + digest.hex().encode() + text[own:b]).digest()
    return digest
