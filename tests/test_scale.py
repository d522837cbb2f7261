"""Operators that must not list all pairs: each against brute force, and on a hot group."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import grams as grams_
from sparkloom.functions import text as T
from sparkloom.operators import cooccur, dedup, graph, search, vector_index
from sparkloom.plans.bindings import articles, read

SF = "/root/testdata/sf0.1"


def grams(t):
    t = t.lower()
    return {t[i : i + 5] for i in range(len(t) - 4)}


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = ["the quick brown fox jumps over the lazy dog near the river bank", "Ünïcödé tïtlés 🎈🎈 with émojis and ßome more letters", "aaaaaaaaaaaaaaaa", "short"]
    rows = []
    for i in range(250):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice("xyzé🎈")
        rows.append((i, "".join(t)))
    rows += [(900, None), (901, ""), (902, "four")]
    got = {(r.a, r.b): r.similarity for r in dedup.similar_pairs(spark.createDataFrame(rows, "doc_id long, title string"), threshold=0.7).collect()}
    first = {}
    for i, t in rows:
        if t and grams(t):
            first.setdefault(frozenset(grams(t)), i)
    want = {}
    for (x, a), (y, b) in itertools.combinations(first.items(), 2):
        if len(x & y) / len(x | y) >= 0.7:
            want[min(a, b), max(a, b)] = len(x & y) / len(x | y)
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_a_shared_stem_makes_no_pairs(spark):
    """20,000 titles with one stem, linked in twos: candidates are in proportion to links."""
    stem = "breaking news from the capital of the northern province today at noon"
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(26))
    rows = []
    for i in range(10_000):
        own = word()
        rows += [(2 * i, f"{stem} {own}"), (2 * i + 1, f"{stem} {own}s")]
    df = spark.createDataFrame(rows, "doc_id long, title string")
    s = df.select(F.col("doc_id").alias("id"), F.transform(T.shingles("title"), lambda x: F.xxhash64(x)).alias("s"))
    assert dedup.candidate_pairs(s, 0.85).count() < 12_000
    assert dedup.similar_pairs(df).count() == 10_000


def shuffled_rows(spark):
    """Rows that all stages so far have written to be shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_sets_that_only_share_elements_are_not_shuffled(spark):
    """2,000 texts of 40 of the same 160 words share rare grams by the thousand; only the planted near copies leave the tasks where they meet."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(160)]
    rows = []
    for i in range(1_900):
        rows.append((i, " ".join(rng.sample(words, 40))))
    rows += [(i, rows[i - 1_900][1] + "x") for i in range(1_900, 2_000)]
    df = spark.createDataFrame(rows, "doc_id long, title string").repartition(4)
    s = df.select(F.col("doc_id").alias("id"), F.transform(T.shingles("title"), lambda x: F.xxhash64(x)).alias("s")).localCheckpoint()
    elements = s.agg(F.sum(F.size("s"))).first()[0]
    before = shuffled_rows(spark)
    got = {(r.a, r.b) for r in dedup.candidate_pairs(s, 0.85).collect()}
    assert {(i - 1_900, i) for i in range(1_900, 2_000)} <= got and len(got) < 200
    assert shuffled_rows(spark) - before < 0.5 * elements


@pytest.mark.parametrize("job", ["groups", "kept", "report"])
def test_jobs_on_similar_pairs_shuffle_no_meetings(spark, job):
    """1,500 texts of 40 of the same 160 words and 50 near copies, each once more."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(160)]
    texts = [" ".join(rng.sample(words, 40)) for _ in range(1_500)]
    texts += [t + "x" for t in texts[:50]]
    texts += [t + "x" for t in texts[:50]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, title string").repartition(4).localCheckpoint()
    before = shuffled_rows(spark)
    if job == "groups":
        got = {(r.root, r.member) for r in dedup.duplicate_groups(dedup.stored(dedup.similar_pairs(df), "pairs"), dedup.set_copies(df)).collect()}
        assert got == {(i, n * 50 + 1_500 + i) for i in range(50) for n in range(2)}
    elif job == "kept":
        assert {r.doc_id for r in dedup.dedup_similar(df).collect()} == set(range(1_500))
    else:
        assert tuple(dedup.dedup_step(df)[1].first()) == (1_600, 1_550, 1_500)
    assert shuffled_rows(spark) - before < 0.4 * sum(len(grams(t)) for t in texts)


def jaccard_pairs(sets, threshold):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_candidates_in_blocks_and_of_large_sets(spark, monkeypatch):
    """No similar pair is lost where all sets share elements, in cut buckets, among sets of very different sizes; ids are strings."""
    monkeypatch.setattr(grams_, "MEET", 60)
    monkeypatch.setattr(grams_, "SENT", 100)
    monkeypatch.setattr(grams_, "PAIRS", 1_000)
    rng = random.Random(11)
    sets = {}
    for c, size in enumerate([1, 2, 3, 8, 40, 150, 300, 700, 1_500, 2_400, 2_600, 3_100, 6_000]):
        base = [rng.randrange(-(2**63), 2**63) for _ in range(size)]
        for i in range(14 if size < 1_000 else 7):
            own = rng.randrange(size // 6 + 1)
            sets[f"{c}-{i}"] = set(rng.sample(base, size - rng.randrange(own + 1))) | {rng.randrange(-(2**63), 2**63) for _ in range(own)} | {1, 2}
    hot = [rng.randrange(-(2**63), 2**63) for _ in range(3)]
    sets |= {f"hot{i}": {*hot, *rng.sample(range(10, 40), rng.randrange(4))} for i in range(300)}
    sets = dict({frozenset(s): i for i, s in sets.items()}.items())
    sets = {i: s for s, i in sets.items()}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id string, s array<long>").repartition(3)
    for threshold in (0.6, 0.85, 1.0):
        want = jaccard_pairs(sets, threshold)
        got = [(r.a, r.b) for r in dedup.candidate_pairs(df, threshold).collect()]
        assert len(got) == len(set(got)) and want <= set(got) and all(a < b for a, b in got)
        assert threshold == 1.0 or len(want) > 100


def test_stored_sets_are_a_fraction_of_the_elements(spark, monkeypatch):
    """20 texts of 5,000 grams each: a prefix is stored, not a row for each gram."""
    rows = {}
    put = dedup.stored

    def counted(df, what, *a):
        out = put(df, what, *a)
        rows[what] = rows.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(dedup, "stored", counted)
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("abcdefgh") for _ in range(5_000))) for i in range(20)]
    assert dedup.similar_pairs(spark.createDataFrame([*texts, (20, texts[0][1] + "x"), (21, texts[0][1])], "doc_id long, title string")).count() == 1
    assert sum(rows.values()) < 0.2 * 21 * 5_000


def clustered(n, dim, centres, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return (c[rng.integers(0, centres, n)] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32)


def recall(spark, v, q, index, probes=None):
    true = {(r.query_id, r.id) for r in search.vector_search(v, q).collect()}
    got = vector_index.search(index, q, probes=probes).collect()
    assert len(got) == len(true) and all(0 <= r.score <= 10.001 for r in got)
    return len({(r.query_id, r.id) for r in got} & true) / len(true)


def test_index_recall_and_work_on_clusters(spark):
    x = clustered(6000, 32, 60)
    v = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)], "id long, embedding array<float>")
    v = v.unionByName(spark.createDataFrame([(9000, None), (9001, [0.0] * 32)], "id long, embedding array<float>"))
    q = v.where("id % 50 = 0 AND id < 9000").withColumnRenamed("id", "query_id")
    index = vector_index.build(v, part_rows=100)
    probes = vector_index.probes_for(index, q)
    sizes = {(r["cell"], r.part): r.n for r in index.rows.groupBy("cell", "part").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) < 400 and sum(sizes.values()) == 6001
    visited = vector_index._nearest_cells(index, q, probes).join(index.rows.groupBy("cell").count(), "cell").agg(F.sum("count")).first()[0]
    assert visited < 0.1 * 6001 * q.count()
    assert recall(spark, v, q, index, probes) >= 0.95


def test_index_recall_on_the_given_vectors(spark):
    """Noise in 64 dimensions: many cells are needed; fewer than a tenth of the rows are scored exactly."""
    v = read(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = vector_index.build(v)
    assert recall(spark, v, q, index) >= 0.95
    scored = vector_index.candidates(index, q, 40, len(index.centroids)).count()
    assert scored == 40 * q.count() < 0.1 * v.count() * q.count()


def test_index_of_nothing_and_of_copies(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert vector_index.search(vector_index.build(none), q).count() == 0
    same = spark.range(500).select("id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    assert [r.id for r in vector_index.search(vector_index.build(same, cells=3), q, k=3).collect()]


def test_queries_in_blocks_give_the_same(spark, monkeypatch):
    v = read(spark, "/root/testdata/sf0.01", "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    once = sorted(search.vector_search(v, q, 5).collect())
    monkeypatch.setattr(search, "MAX_QUERIES", 9)
    assert sorted(search.vector_search(v, q, 5).collect()) == once


def test_partitions_of_pairs_grow_with_the_mentions(spark, monkeypatch):
    """Ten times the mentions in ten times the partitions, and the same pairs as by hand."""
    rows = [(i // 4, f"e{(i * 7 + i // 4) % 30}", "s", None, i % 4) for i in range(4000)]
    monkeypatch.setattr(cooccur, "PART_ROWS", 100)
    m = spark.createDataFrame(rows, "doc_id long, entity string, source string, ts timestamp, ord long")
    assert [cooccur.entity_pairs(x).rdd.getNumPartitions() for x in (m.where("doc_id < 100"), m)] == [4, 40]
    docs = {}
    for d, e, *_ in rows:
        docs.setdefault(d, set()).add(e)
    want = sorted((d, a, b) for d, es in docs.items() for a, b in itertools.combinations(sorted(es), 2))
    assert sorted((r.doc_id, r.e1, r.e2) for r in cooccur.entity_pairs(m).collect()) == want


def test_search_makes_no_row_for_each_pair(spark):
    """Ties, copies, nulls, zeros and other lengths as by plain cosine; scores are matrices, and no join of all pairs is planned."""
    rng = random.Random(4)
    rows = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(3)]) for i in range(300)]
    rows += [(400, None), (401, [0.0, 0.0, 0.0]), (402, [1.0, None, 0.0]), (403, [1.0, 0.0]), (404, [1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.where("id % 50 = 0 OR id > 400").withColumnRenamed("id", "query_id")
    found = search.vector_search(v, q, 7)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    of = dict(rows)
    want = set()
    for i in (r.query_id for r in q.collect()):
        best = sorted((-round(max(10 * cosine(of[i], x), 0.0), 3), j) for j, x in rows)[:7]
        want |= {(i, j, -s + 0.0, n + 1) for n, (s, j) in enumerate(best)}
    assert {(r.query_id, r.id, r.score, r["rank"]) for r in found.collect()} == want


@pytest.mark.parametrize("chars", [10**6, 3_000])
def test_large_dictionary_against_plain_search(spark, chars):
    docs = articles(spark, "/root/testdata/sf0.001").select("doc_id", F.lower("text").alias("t"))
    texts = {r.doc_id: r.t or "" for r in docs.collect()}
    rng = random.Random(2)
    names = {"", "zzzzzzz", "🎈", "der", "ñ"}
    for t in texts.values():
        for _ in range(4):
            i = rng.randrange(max(1, len(t)))
            names.add(t[i : i + rng.randint(2, 9)])
    entries = spark.createDataFrame([(n, i) for i, n in enumerate(sorted(names))] + [("der", 9999), (None, 9998)], "w string, e long")
    got = sorted((r.doc_id, r.w, r.e) for r in T.containing(docs, "t", entries, "w", most=10, chars=chars).select("doc_id", "w", "e").collect())
    rows = [(n, i) for i, n in enumerate(sorted(names)) if n] + [("der", 9999)]
    assert got == sorted((d, n, i) for d, t in texts.items() for n, i in rows if n in t)


def test_two_hundred_thousand_names(spark):
    docs = articles(spark, "/root/testdata/sf0.01").select("doc_id", F.lower("text").alias("t"))
    words = [r[0] for r in docs.select(F.explode(F.split("t", r"\s+")).alias("w")).distinct().orderBy("w").limit(3000).collect() if len(r[0]) > 5]
    entries = spark.range(200_000).select(F.concat(F.lit("no such name "), "id").alias("w")).unionByName(spark.createDataFrame([(w,) for w in words], "w string"))
    few = spark.createDataFrame([(w,) for w in words[:1900]], "w string")
    big = T.containing(docs, "t", entries, "w").select("doc_id", "w")
    assert big.join(few, "w", "left_semi").count() == T.containing(docs, "t", few, "w").count() > 1000


def test_tfidf_pairs_in_several_blocks(spark, monkeypatch):
    """300 texts share a rare word, and every third pair of them is near; blocks and runs of terms are small."""
    monkeypatch.setattr(dedup, "BLOCK", 40)
    monkeypatch.setattr(dedup, "COLUMNS", 16)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(100):
        t = rng.sample(words, 14)
        texts += [["rare", *t], ["rare", *t, rng.choice(words)], ["rare", *t[:-3], *rng.sample(words, 3)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, title string").repartition(5)
    vectors = dedup.tfidf(docs, "title", features=None).localCheckpoint()
    held = {}
    for r in vectors.collect():
        held.setdefault(r.id, {})[r.term] = r.w
    dots = {(a, b): sum(w * held[b].get(t, 0.0) for t, w in held[a].items()) for a, b in itertools.combinations(sorted(held), 2)}
    want = {k: s for k, s in dots.items() if s >= 0.6}
    rows = dedup.tfidf_pairs(vectors, 0.6).collect()
    got = {(r.a, r.b): r.similarity for r in rows}
    assert len(rows) == len(got) and len(want) > 100
    assert got.keys() == want.keys() and all(abs(s - want[k]) < 1e-9 for k, s in got.items())


def test_paths_between_leaders_are_the_cheapest_ways_of_all(spark):
    """Against labels of all nodes: two components, many equal costs, cheap ways of many hops, leaders as inner nodes."""
    rng = random.Random(12)
    edges = {}
    for part, size in (("a", 60), ("b", 15)):
        for i in range(size):
            for j in rng.sample(range(size), 6):
                if i != j:
                    edges[min((part, i), (part, j)), max((part, i), (part, j))] = rng.choice([1, 2, 2, 3, 9])
    ends = [("a", i) for i in range(6)] + [("b", i) for i in range(3)] + [("z", i) for i in range(5)]
    # A way of four cheap edges beside a dear one of two.
    edges |= {(("z", i), ("z", i + 1)): 1 for i in range(4)} | {(("z", 0), ("z", 9)): 5, (("z", 4), ("z", 9)): 5}
    name = lambda x: f"{x[0]}{x[1]:02d}"
    e = spark.createDataFrame([(name(p), name(q), w) for (p, q), w in edges.items()], "e1 string, e2 string, weight long").localCheckpoint()
    nodes = spark.createDataFrame([(name(x),) for x in ends], "node string")
    wanted = spark.createDataFrame([(name(p), name(q)) for p, q in itertools.combinations(ends, 2)], "root string, node string")
    for cost in ("weight", "inverse"):
        rows = graph.shortest_weighted_paths(e, nodes, cost)
        near = lambda r: r.join(wanted, ["root", "node"]).where("hops <= 3")
        found = graph.paths_between(e, nodes, wanted, cost)
        paths = [sorted(map(tuple, graph.traced(x, near(x), 3).join(near(x).select("root", "node", "dist"), ["root", "node"]).collect())) for x in (rows, found)]
        assert paths[0] == paths[1] and len(paths[0]) > 10
