import math
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import merkle
from sparkloom.llm.common import read
from sparkloom.llm.merkle import address, block_of, built, cuts, folded, height, layers, nodes_of, op13_merkle, ranked, siblings, ways

SF = "/root/testdata/sf0.001"


def h(text):
    return sha256(text.encode()).hexdigest()


def tree(leaves):
    """All levels of a tree, the leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    out = []
    for row in levels[:-1]:
        first = at - at % 16
        run = row[first : first + 16]
        out.append((run[: at - first], run[at - first + 1 :]))
        at //= 16
    return out


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = way(trees[s], at) + way(top, k)
            node = own
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None:
                node = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))
            for before, after in path:
                node = h("".join(before) + node + "".join(after))
            out.append((r.doc_id, own, trees[s][-1][0], top[-1][0], h("".join("".join(b + a) for b, a in path)), node, node == top[-1][0]))
    return out


def same(docs):
    order = lambda x: tuple(map(str, x))
    got = [tuple(r) for r in op13_merkle(docs).collect()]
    assert sorted(got, key=order) == sorted(brute(docs.collect()), key=order)
    return got


def test_given_documents(spark):
    got = same(read(spark, SF, "documents"))
    assert 0 < sum(not x[-1] for x in got) < len(got) / 3


def test_addresses_are_a_layout(spark):
    for tall in range(5):
        places = [address(tall, d, i) for d in range(tall + 1) for i in range(16**d)]
        assert sorted(places) == list(range(nodes_of(tall)))
    # A tree of four levels: the top two levels come first, then each lower half as one stretch.
    assert {address(3, d, i) for d in (0, 1) for i in range(16**d)} == set(range(17))
    for child in range(256):
        assert {address(3, 2, child)} | {address(3, 3, 16 * child + i) for i in range(16)} == set(range(17 + 17 * child, 34 + 17 * child))
    assert [cuts(k) for k in (0, 2, 3, 4, 5, 10)] == [(0,), (2,), (2, 1), (2, 2), (2, 1, 2), (2, 1, 2, 2, 1, 2)]
    assert all(sum(cuts(k)) == k and max(cuts(k)) <= 2 for k in range(17))
    assert [height(n) for n in (0, 1, 2, 16, 17, 256, 257, 4097)] == [0, 0, 1, 1, 2, 2, 3, 4]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 257, 300])
def test_block_against_plain_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = tree(leaves)
    nodes = built(leaves, len(levels) - 1)
    assert nodes[0] == levels[-1][0]
    for at in range(n):
        path = siblings(nodes, len(levels) - 1, at)
        assert path == [("".join(b), "".join(a)) for b, a in way(levels, at)] and folded(leaves[at], path) == nodes[0]


def test_layers_of_a_tall_tree(spark):
    """A source of 5,000 rows has two layers; small trees stand beside it."""
    rows = spark.range(5000).select(F.lit("big").alias("tree"), "id").unionByName(spark.range(40).select(F.concat(F.lit("s"), F.col("id") % 3).alias("tree"), "id"))
    leaves = ranked(rows.withColumn("node", F.sha2(F.concat("tree", F.col("id").cast("string")), 256)).repartition(7), "id")
    placed = {(r.tree, r.at): r for r in leaves.collect()}
    assert len(placed) == 5040 and all(r.at == (i if t == "big" else r.id // 3) for (t, i), r in placed.items())
    made, roots = layers(leaves)
    assert len(made) == 2 and made[1].count() == 1
    for name, root in roots.collect():
        assert root == tree([placed[name, i].node for i in range(sum(t == name for t, _ in placed))])[-1][0]
    start = roots.select("tree", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("root").alias("subroot"))
    low = {(r.tree, r.block): r for r in ways(made, start).collect()}
    for (name, at), row in placed.items():
        block = low[name, at // 256 if name == "big" else 0]
        own = siblings(block.nodes, block.h, at % 256)
        assert folded(row.node, own + [tuple(p) for p in block.path]) == block.subroot


def test_block_numbers(spark):
    sizes = [(n, at) for n in (1, 16, 17, 256, 4096, 4097, 16**4 + 1, 16**9 + 3) for at in {0, n // 2, n - 1}]
    df = spark.createDataFrame(sizes, "size long, at long")
    for layer in (0, 1, 2):
        for r in df.withColumn("block", block_of(layer)).collect():
            tall = cuts(math.ceil(math.log(r.size, 16) - 1e-12) if r.size > 1 else 0)
            assert height(r.size) == sum(tall) and r.block == r.at // 16 ** (tall[layer] if layer < len(tall) else 0)


def test_odd_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, at int"
    rows = [(None, None, None, None, None), (None, None, None, None, None), (7, None, "en", 3, "ABC"), (7, None, "en", 3, "ABC"), (7, "", None, 0, ""), (1, "é", "fr", 1, "É" * 70_000), (2, "z", "x", -5, "Zz"), (10, "z", "x", 5, None), (25, "ｚ", "x", 5, "QQ"), (12, "🎈", "x", 5, "QQ")]
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], schema)
    assert len(same(docs)) == len(rows)
    assert op13_merkle(docs.limit(0)).count() == 0
    (one,) = same(docs.where("doc_id = 12"))
    assert one[1] == one[2] == one[3] and one[4] == h("")
    assert merkle.digest("") == h("")
