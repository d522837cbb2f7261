"""Operator 13, Merkle manifest of a dataset, its trees stored in van Emde Boas order.

A row is a leaf; each source's leaves, by id, make a tree of FANOUT children, and the sources'
subroots, by source, make the tree above.  A tree of height h is split at half its height, again
and again, until parts are BLOCK levels high or less (`cuts`): aligned subtrees, each a row of a
Parquet table, whose nodes lie in van Emde Boas order (`address`): the top half first, then each
bottom half, all recursively so.  Construction fills a block's array and sibling retrieval reads
it by the same address arithmetic.  The roots of one layer's blocks are the leaves of the next.

As Spark jobs: leaves are ranged by (source, id), which splits sources of any size; their places
follow from places in partitions and the partitions' counts.  Layers are built upwards, one
grouping a layer by (source, block), at most FANOUT^BLOCK nodes each, and proofs are passed
downwards the same way: a block learns the siblings above its root once, for all its leaves.

Defined results: nulls are hashed as `-`; null and equal ids stand first and in the order of
their digests; equal rows are leaves of their own; a source of one row has its leaf as subroot;
null texts have no letters to tamper with; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import ranked, stored

FANOUT, BLOCK = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# ---- heights, cuts and addresses


@lru_cache(maxsize=None)
def height(leaves: int) -> int:
    """Levels above the leaves: FANOUT nodes at a time become one until one is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FANOUT), levels + 1
    return levels


@lru_cache(maxsize=None)
def cuts(h: int) -> tuple[int, ...]:
    """Heights of the parts of a tree of height h, from the leaves up: halves until they are BLOCK or less."""
    if h <= BLOCK:
        return (h,)
    return cuts(h - h // 2) + cuts(h // 2)


def nodes_of(h: int) -> int:
    """Nodes of a whole tree with h levels above its leaves."""
    return (FANOUT ** (h + 1) - 1) // (FANOUT - 1)


@lru_cache(maxsize=1 << 16)
def address(h: int, depth: int, at: int) -> int:
    """Place of the node at (depth from the root, at from the left) in the van Emde Boas order of a whole
    tree with h levels above its leaves.  The tree's h + 1 levels are split at half: a top tree, then
    the bottom trees from left to right, whose roots are the children of the top tree's leaves."""
    if h == 0:
        return 0
    top = (h + 1) // 2  # levels of the top tree
    if depth < top:
        return address(top - 1, depth, at)
    below = h - top  # height of a bottom tree
    width = FANOUT ** (depth - top)
    return nodes_of(top - 1) + (at // width) * nodes_of(below) + address(below, depth - top, at % width)


def built(leaves: list[str], h: int) -> list[str]:
    """The block over leaves with h levels above them, in van Emde Boas order; absent nodes are ''."""
    nodes = [""] * nodes_of(h)
    row = leaves
    for depth in range(h, -1, -1):
        for at, x in enumerate(row):
            nodes[address(h, depth, at)] = x
        if depth:
            row = [digest("".join(row[i : i + FANOUT])) for i in range(0, len(row), FANOUT)]
    return nodes


def siblings(nodes: list[str], h: int, leaf: int) -> list[tuple[str, str]]:
    """For each level from a block's leaf up: the digests before and after its own node in the run."""
    out = []
    at = leaf
    for depth in range(h, 0, -1):
        first = at - at % FANOUT
        run = [nodes[address(h, depth, i)] for i in range(first, first + FANOUT)]
        out.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        at //= FANOUT
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root over node, given its siblings level by level."""
    for before, after in path:
        node = digest(before + node + after)
    return node


# ---- jobs


def record(text: str) -> str:
    """SQL: the digest of a row's fields, text standing for the text."""
    parts = (f"coalesce(concat(octet_length(string({c})), ':', string({c})), '-')" for c in (*FIELDS[:-1], text))
    return f"sha2(concat({', '.join(parts)}), 256)"


def block_of(layer: int) -> Column:
    """The layer's block that holds the layer's node at, in a tree of size leaves: at without its last digits."""
    tall = " + ".join(f"int(size > {FANOUT**k}L)" for k in range(HEIGHTS - 1))
    digits = ", ".join(str(cuts(h)[layer] if layer < len(cuts(h)) else 0) for h in range(HEIGHTS))
    return F.expr(f"shiftright(at, {FANOUT.bit_length() - 1} * get(array({digits}), {tall}))")


#: Heights that a tree of less than 2^63 leaves may have: 0 to 16.
HEIGHTS = 17


def layers(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """leaves(tree, at, size, node) -> the stored layers of blocks from the leaves up, each with tree, block,
    size, h, n, top, nodes (in van Emde Boas order) and root; and tree, root of every tree."""

    def building(layer: int):
        def build(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("at")
            size = int(rows["size"].iloc[0])
            heights = cuts(height(size))
            nodes = built(rows["node"].tolist(), heights[layer])
            return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "block": [rows["block"].iloc[0]], "size": [size], "h": [heights[layer]], "n": [len(rows)], "top": [layer == len(heights) - 1], "nodes": [nodes], "root": [nodes[0]]})

        return build

    made: list[DataFrame] = []
    now = leaves.select("tree", "at", "size", "node")
    while not made or not now.isEmpty():
        blocks = now.withColumn("block", block_of(len(made))).groupBy("tree", "block")
        made.append(stored(blocks.applyInPandas(building(len(made)), "tree string, block long, size long, h int, n int, top boolean, nodes array<string>, root string"), "merkle-blocks"))
        now = made[-1].where("not top").select("tree", F.col("block").alias("at"), "size", F.col("root").alias("node"))
    tops = [x.where("top").select("tree", "root") for x in made]
    roots = tops[0]
    for x in tops[1:]:
        roots = roots.unionByName(x)
    return made, roots


WAY = "path array<struct<before string, after string>>, subroot string"


def passed_down(ways: DataFrame) -> DataFrame:
    """ways(tree, block, h, n, nodes, path, subroot) -> tree, at, path, subroot: the way of each leaf of the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                up = [(p["before"], p["after"]) for p in row.path]
                for i in range(0, row.n, FANOUT):
                    leaves = range(i, min(i + FANOUT, row.n))
                    path = [[{"before": b, "after": a} for b, a in siblings(row.nodes, row.h, k) + up] for k in leaves]
                    yield pd.DataFrame({"tree": row.tree, "at": [row.block * FANOUT**row.h + k for k in leaves], "path": path, "subroot": row.subroot})

    return stored(ways.mapInPandas(run, f"tree string, at long, {WAY}"), "merkle-paths")


def ways(made: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks with the way above their roots: tree, block, h, n, nodes, path, subroot.

    above(tree, path, subroot) is the way above each tree's own root.  A layer's blocks pass it on to
    the blocks below, whose roots are their leaves.
    """
    columns = ["tree", "block", "h", "n", "nodes", "path", "subroot"]
    known = None
    for blocks in reversed(made):
        here = blocks.where("top").join(above.hint("shuffle_merge"), "tree").select(*columns)
        if known is not None:
            of_block = passed_down(known).withColumnRenamed("at", "block")
            here = here.unionByName(blocks.where("not top").join(of_block.hint("shuffle_merge"), ["tree", "block"]).select(*columns))
        known = here
    return known


def leaves_of(docs: DataFrame) -> DataFrame:
    """docs -> stored doc_id, tree, leaf and tampered (null unless the row is to be tampered with)."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return stored(
        docs.select(
            "doc_id", F.expr("IF(source IS NULL, '0', concat('1', source))").alias("tree"), F.expr(record("text")).alias("leaf"),
            F.expr(f"IF(crc32(encode(string(doc_id), 'UTF-8')) % 5 = 0, {record(lower)}, NULL)").alias("tampered"),
        ),
        "merkle-leaves",
    )


Manifest = tuple[DataFrame, list[DataFrame], list[DataFrame], DataFrame, DataFrame]


def manifest(docs: DataFrame) -> Manifest:
    """The stored manifest of docs: leaves with their places, the layers of the sources' trees and of the
    tree above, and the tables of subroots and of the one root."""
    leaves = stored(ranked(leaves_of(docs), "doc_id", "leaf"), "merkle-placed")
    sources, subroots = layers(leaves.withColumnRenamed("leaf", "node"))
    subroots = stored(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("node")), "key"), "merkle-subroots")
    above, root = layers(subroots)
    return leaves, sources, above, subroots, root


def verified(found: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf of a manifest."""
    leaves, sources, above, subroots, root = found
    start = root.select("tree", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.lit("").alias("subroot"))
    of_source = passed_down(ways(above, start)).select("at", "path")
    of_source = stored(subroots.select("at", F.col("key").alias("tree"), F.col("node").alias("subroot")).join(of_source.hint("shuffle_merge"), "at"), "merkle-sources")
    blocks = ways(sources, of_source.select("tree", "path", "subroot")).crossJoin(F.broadcast(root.select("root")))  # one row

    def fold(rows: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        row = way.iloc[0]
        up = [(p["before"], p["after"]) for p in row["path"]]
        rest = "".join(b + a for b, a in up).encode()
        wide = FANOUT ** int(row["h"])
        ends: dict[str, str] = {}
        proofs, roots = [], []
        for at, leaf, tampered in zip(rows["at"], rows["leaf"], rows["tampered"]):
            own = siblings(row["nodes"], int(row["h"]), at % wide)
            proof = sha256("".join(b + a for b, a in own).encode())
            proof.update(rest)
            proofs.append(proof.hexdigest())
            node = folded(tampered or leaf, own)
            if node not in ends:
                ends[node] = folded(node, up)
            roots.append(ends[node])
        out = rows[["doc_id", "leaf"]].assign(subroot=row["subroot"], root=row["root"], proof_sha256=proofs, folded_root=roots)
        return out.assign(verified=out["folded_root"] == row["root"])

    of_block = leaves.withColumn("block", block_of(0)).select("tree", "block", "at", "doc_id", "leaf", "tampered")
    both = of_block.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
    kind = dict(leaves.dtypes)["doc_id"]
    return both.applyInPandas(fold, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle(docs: DataFrame) -> DataFrame:
    return verified(manifest(docs.select(*FIELDS)))
