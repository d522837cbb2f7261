import random
from collections import defaultdict

from pyspark.sql import functions as F

from sparkloom.llm.common import read
from sparkloom.llm.packing import LENGTHS, OVERHEAD, op10_packing, pack, packed

SF = "/root/testdata/sf0.001"


def slow_pack(sizes, lengths=LENGTHS, overhead=OVERHEAD):
    """The same rules by plain search."""
    bins, out = [], []  # bins: [capacity, used]
    for i, s in enumerate(sizes):
        room = [(c - u, -k) for k, (c, u) in enumerate(bins) if c - u >= s]
        if room:
            space = min(room)[0]
            b = next(k for k in last[space][::-1] if bins[k][0] - bins[k][1] == space)
            last[space].remove(b)
        else:
            if not bins:
                last = defaultdict(list)
            cost = min(((c + overhead) / (s + min(c - s, sum(x for x in sizes[i + 1 :] if x <= c - s))), c) for c in lengths if c >= s)
            bins.append([cost[1], 0])
            b = len(bins) - 1
        out.append((b, bins[b][1]))
        bins[b][1] += s
        last[bins[b][0] - bins[b][1]].append(b)
    return [b for b, _ in out], [o for _, o in out], [min(c for c in lengths if c >= u) for _, u in bins]


def test_against_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        sizes = sorted((rng.choice([rng.randrange(1, 4097), rng.randrange(1, 200)]) for _ in range(rng.randrange(1, 80))), reverse=True)
        assert pack(sizes) == slow_pack(sizes)


def sound(rows, sizes):
    at, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        if r.bin is not None:
            at[r.shard, r.bin].append((r.offset, r.length, r.bin_length))
    for cells in at.values():
        cells.sort()
        end = 0
        for o, n, _ in cells:
            assert o == end
            end += n
        assert {c for *_, c in cells} == {min(c for c in LENGTHS if c >= end)}
    for d, n in sizes.items():
        assert sum(x for _, x in pieces[d]) == n
    return at


def test_every_word_once(spark):
    docs = read(spark, SF, "documents")
    sizes = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    at = sound(op10_packing(docs).collect(), sizes)
    assert sum(sizes.values()) >= 0.9 * sum(c[0][2] for c in at.values())
    shards = packed(docs, shard_rows=40)
    sound(shards.collect(), sizes)
    assert shards.select("shard").distinct().count() > 3


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a " * 9000), (4, "b"), (4, "b"), (None, "c d"), (5, "e " * 4096)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, bin int")
    out = op10_packing(docs).collect()
    assert len(out) == 9 and sum(r.bin is None for r in out) == 2
    sound([r for r in out if r.doc_id != 4], {1: 0, 2: 0, 3: 9000, 5: 4096})
    assert op10_packing(docs.limit(0)).count() == 0
    assert packed(docs.withColumn("n", F.lit(7)), length_col="n").agg(F.sum("length")).first()[0] == 49


def test_equal_and_null_ids_spread_over_shards(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text " * 20).alias("text"))
    out = packed(rows.union(spark.range(5_000).select(F.lit(7).cast("long"), F.lit("w " * 30))), shard_rows=1000)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(sizes) == 25 and max(sizes) < 1200 and sum(sizes) == 25_000
    names = spark.createDataFrame([("a", "x y z"), (None, "u v"), ("a", None)], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.length) for r in packed(names).collect()) == [("None", 2), ("a", 0), ("a", 3)]
