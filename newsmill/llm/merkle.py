"""A Merkle manifest of a dataset, stored as blocks of subtrees in van Emde Boas order.

Every row is a leaf, every source a tree with FAN children a node, and the trees' roots are the leaves of the tree that
gives the dataset's root. A tree is cut into aligned subtrees of HEIGHT levels; a subtree is one stored block, in which
each subtree is laid out recursively as its upper half followed by its lower halves, so a walk from leaf to root
touches few pages of any size. Addresses are arithmetic on (level, position); they serve both construction and the
retrieval of siblings. The roots of the blocks are the leaves of the next layer of blocks, up to a single one.

Positions in a tree come from a range partitioning and the counts of its parts, so no source is sorted or numbered in
one task; a block holds FAN ** HEIGHT leaves at most, and the layers above shrink by that factor.

Defined results: null columns hash as `-`; null sources are a tree of their own, first in order; null ids come first in
their tree; equal ids are ordered by their leaves, so repeated rows are neighbouring leaves with equal digests; an empty
table gives no rows; columns other than those of the leaf don't count, whatever their names. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.llm.common import stage

FAN = 3
#: Levels of a block: up to 6,561 leaves, 9,841 digests of 32 bytes.
HEIGHT = 8
WIDTH = 32
#: Columns of a leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


# ---- layout -----------------------------------------------------------------------------------------------------


def nodes_of(levels: int, fan: int = FAN) -> int:
    return (fan**levels - 1) // (fan - 1)


@lru_cache(maxsize=64)
def layout(height: int, fan: int = FAN) -> list[np.ndarray]:
    """Addresses in van Emde Boas order of a full subtree: one array for each depth, the root's first."""
    levels = height + 1
    if levels == 1:
        return [np.zeros(1, "int64")]
    top = levels // 2
    upper, lower = layout(top - 1, fan), layout(levels - top - 1, fan)
    out = list(upper)
    for depth, inner in enumerate(lower):
        below = nodes_of(top, fan) + np.arange(fan**top)[:, None] * nodes_of(levels - top, fan) + inner[None, :]
        out.append(below.reshape(-1))
    return out


def height_of(size: int, fan: int = FAN) -> int:
    """Levels above the leaves until one node remains."""
    h = 0
    while size > 1:
        size, h = -(-size // fan), h + 1
    return h


class Block:
    """A stored subtree: digests by (level above the leaves, position), kept in one buffer in layout order."""

    def __init__(self, leaves: int, height: int, store: bytes | None = None, fan: int = FAN):
        self.leaves, self.height, self.fan = leaves, height, fan
        self.where = layout(height, fan)[::-1]
        self.store = bytearray(nodes_of(height + 1, fan) * WIDTH) if store is None else store

    def width(self, level: int) -> int:
        return -(-self.leaves // self.fan**level)

    def get(self, level: int, at: int) -> str:
        i = int(self.where[level][at]) * WIDTH
        return bytes(self.store[i : i + WIDTH]).hex()

    def put(self, level: int, at: int, what: bytes) -> None:
        i = int(self.where[level][at]) * WIDTH
        self.store[i : i + WIDTH] = what

    def fill(self, leaves: list[bytes]) -> bytes:
        """Stores the leaves and all that is above them; returns the root."""
        for at, leaf in enumerate(leaves):
            self.put(0, at, leaf)
        for level in range(self.height):
            n = self.width(level)
            for at in range(self.width(level + 1)):
                run = range(at * self.fan, min(n, (at + 1) * self.fan))
                self.put(level + 1, at, hashlib.sha256("".join(self.get(level, i) for i in run).encode()).digest())
        return bytes.fromhex(self.get(self.height, 0))

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """What stands left and right of a leaf's ancestor, level by level."""
        out = []
        for level in range(self.height):
            first, n = at - at % self.fan, self.width(level)
            left = "".join(self.get(level, i) for i in range(first, at))
            out.append((left, "".join(self.get(level, i) for i in range(at + 1, min(n, first + self.fan)))))
            at //= self.fan
        return out


def encode(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{left},{right}" for left, right in path)


def decode(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in path.split(";")] if path else []


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


# ---- trees ------------------------------------------------------------------------------------------------------


def leaf_hash(columns: dict[str, Column]) -> Column:
    """The digest of a row as 32 bytes."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[one(columns[c].cast("string")) for c in LEAF]), 256))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds at, the position in the tree by the order, and size, the rows of the tree."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    held = stage(ranged.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), name)
    runs = held.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return held.join(runs, ["tree", "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("part", "row", "shift")


BLOCK = "tree string, block long, size long, store binary, root binary"


def blocks_of(nodes: DataFrame, height: int) -> DataFrame:
    """Nodes (tree, at, size, digest) as stored blocks."""
    most = FAN**height

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        size = int(rows["size"].iloc[0])
        block = Block(len(rows), height if size > most else height_of(size))
        root = block.fill(list(rows["digest"]))
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "block": [int(rows["block"].iloc[0])], "size": [size], "store": [bytes(block.store)], "root": [root]})

    return nodes.select("tree", F.expr(f"at div {most}").alias("block"), "at", "size", "digest").groupBy("tree", "block").applyInPandas(pack, BLOCK)


def grow(nodes: DataFrame, height: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The layers of blocks above the nodes, the lowest first, and the root of each tree (tree, root)."""
    most, layers = FAN**height, []
    while True:
        layers.append(stage(blocks_of(nodes, height), f"{name}-{len(layers)}"))
        larger = layers[-1].where(F.col("size") > most)
        nodes = larger.select("tree", F.col("block").alias("at"), F.ceil(F.col("size") / most).alias("size"), F.col("root").alias("digest"))
        if larger.isEmpty():
            break
    roots = layers[0].where(F.col("size") <= most).select("tree", "root")
    for layer in layers[1:]:
        roots = roots.unionByName(layer.where(F.col("size") <= most).select("tree", "root"))
    return layers, roots


def retrieve(members: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """tree, block (the member's position) and path up to the root, for members (tree, at) of blocks (tree, block, size, store, above)."""
    most = FAN**height

    def paths(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        block, above = opened(held, len(rows), most, height)
        found = [encode([*block.siblings(int(at) % most), *above]) for at in rows["at"]]
        return pd.DataFrame({"tree": rows["tree"], "block": rows["at"], "path": found})

    keyed = members.select("tree", F.expr(f"at div {most}").alias("block"), "at")
    return keyed.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(paths, "tree string, block long, path string")


def opened(held: pd.DataFrame, leaves: int, most: int, height: int) -> tuple[Block, list[tuple[str, str]]]:
    row = held.iloc[0]
    size = int(row["size"])
    return Block(leaves, height if size > most else height_of(size), row["store"]), decode(row["above"])


def under(layers: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The lowest layer's blocks, each with what is above it: layers of grow(), above (tree, path) the roots' own paths."""
    most, found, held = FAN**height, None, None
    for k in range(len(layers) - 1, -1, -1):
        layer = layers[k].drop("root")
        held = layer.where(F.col("size") <= most).join(above.select("tree", F.col("path").alias("above")), "tree")
        if found is not None:
            held = held.unionByName(layer.where(F.col("size") > most).join(found.withColumnRenamed("path", "above"), ["tree", "block"]))
        if k:
            found = retrieve(layers[k - 1].where(F.col("size") > most).select("tree", F.col("block").alias("at")), held, height)
    return held


RESULT = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Where tampered holds, changed stands for the text when folded_root is recomputed.
    """
    most = FAN**height
    columns = {c: F.col(f"`{c}`") for c in LEAF}
    other = leaf_hash(columns | {"text": changed}) if changed is not None else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("="), columns["source"].cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf_hash(columns).alias("digest"), F.when(F.lit(False) if tampered is None else tampered, other).alias("other"))
    rows = stage(rows.withColumn("uid", F.monotonically_increasing_id()), "leaves")
    leaves = numbered(rows, ["doc_id", "digest", "uid"], "ordered-leaves").drop("uid")

    layers, subroots = grow(leaves, height, "blocks")
    subroots = stage(subroots, "subroots")
    top = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest")), ["source"], "ordered-subroots")
    top_layers, roots = grow(top, height, "top")
    root = roots.first()
    root = root.root.hex() if root else ""
    of_top = under(top_layers, roots.select("tree", F.lit("").alias("path")), height)
    above = retrieve(top, of_top, height).select(F.col("block").alias("at"), "path").join(top.select("at", F.col("source").alias("tree")), "at").drop("at")
    above = stage(above, "tree-paths")
    held = under(layers, above, height).join(subroots.select("tree", F.lower(F.hex("root")).alias("subroot")), "tree")

    def prove(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        block, above = opened(held, len(rows), most, height)
        out = []
        for doc, at, leaf, other in zip(rows["doc_id"], rows["at"], rows["digest"], rows["other"], strict=True):
            path = [*block.siblings(int(at) % most), *above]
            again = folded((leaf if other is None else other).hex(), path)
            out.append((doc, leaf.hex(), held["subroot"].iloc[0], root, digest(*(x for pair in path for x in pair)), again, again == root))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    # ids travel as strings: with nulls among them, pandas would make numbers floats
    members = leaves.select("tree", F.expr(f"at div {most}").alias("block"), "at", F.col("doc_id").cast("string").alias("doc_id"), "digest", "other")
    out = members.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInPandas(prove, RESULT)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def newlines_deleted(docs: DataFrame) -> DataFrame:
    """The manifest checked against texts without line feeds, where 2 divides the crc32 of the decimal doc_id."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, even, F.regexp_replace("text", "\n", ""))
