import random
import re

from sparkloom.llm.common import read
from sparkloom.llm.components import connected_components
from sparkloom.llm.minmax import near_duplicates, op4_minmax, possible_pairs, rarest_first, without_near_duplicates

SF01 = "/root/testdata/sf0.01"


def brute(docs, words=2, percent=80):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    index = {}
    for i in ids:
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    for i in ids:
        seen = {}
        for s in sets[i]:
            for j in index[s]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_against_brute_force(spark):
    docs = read(spark, SF01, "documents")
    assert found(op4_minmax(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_group_of_edited_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(14)):
            w[k] = f"x{i}y{k}"
        rows.append((1000 - i, " ".join(w)))
    assert found(op4_minmax(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_bucket_of_many_components(spark):
    """Pairs linked with each other only, all in the buckets of one shared passage."""
    rng = random.Random(8)
    shared = [f"s{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(260):
        tail = [f"t{i // 2}y{k}" for k in range(50)]
        if i % 2:
            for k in rng.sample(range(50), 6):
                tail[k] = f"u{i}y{k}"
        rows.append((5000 - i, " ".join(shared + tail)))
    expected = brute(rows)
    assert len({c for _, c, _ in expected.values()}) == 130
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2)) == expected


def test_possible_pairs_lose_no_link(spark):
    """Members of one leader, of many sizes and distances: every link that is not with the leader is proposed."""
    rng = random.Random(13)
    for percent in (80, 60):
        top = set(range(100))
        sets = [top]
        for i in range(150):
            near = rng.choice(sets)
            s = {x for x in near if rng.random() > rng.choice((0.0, 0.05, 0.2))}
            s |= {rng.choice((1000 + rng.randrange(60), 10000 * (i + 1) + k)) for k in range(rng.randrange(40))}
            if s - top or top - s:
                sets.append(s)

        def alike(x, y):
            return 100 * len(x & y) >= percent * len(x | y)

        ids = range(1, len(sets))
        component = {i: 0 if alike(sets[i], top) else i for i in ids}
        links = {(i, j) for i in ids for j in ids if i < j and component[i] != component[j] and sets[i] != sets[j] and alike(sets[i], sets[j])}
        table = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, shingles array<long>")
        group = spark.createDataFrame([(i, 0, len(sets[i]), component[i]) for i in ids], "a long, b long, n long, component long")
        pairs = {(r.a, r.b) for r in possible_pairs(rarest_first(group, table), percent).collect()}
        assert len(links) > 50 and links <= pairs
        assert len(pairs) < len(sets) * len(sets) // 4


def test_large_bucket_lists_few_pairs(spark):
    """Texts that share most of their words and are linked in twos: pairs grow with the texts, not with their square."""
    shared = set(range(160))
    sets = {i: shared | {1000 * (i // 2 + 1) + k for k in range(36)} | {10**7 + i} for i in range(1, 2001)}
    sets[0] = shared | set(range(200, 237))
    table = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, shingles array<long>")
    group = spark.createDataFrame([(i, 0, len(sets[i]), i) for i in sets if i], "a long, b long, n long, component long")
    pairs = {(r.a, r.b) for r in possible_pairs(rarest_first(group, table), 80).collect()}
    assert pairs == {(i, i + 1) for i in range(2, 2000, 2)}


def test_edge_cases(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \n", 5), (4, "One", 5), (5, "one", 5), (6, "a b", 5), (7, "A\tb", 5), (8, "b a", 5), (9, "z " * 60000, 5), (6, "a b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long")
    assert found(op4_minmax(docs)) == brute([(a, b) for a, b, _ in rows])
    assert op4_minmax(docs).count() == 10
    stay = without_near_duplicates(docs, words=2)
    assert sorted(r.doc_id for r in stay.collect()) == [1, 2, 3, 4, 6, 8, 9] and stay.columns == docs.columns
    assert op4_minmax(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "q w e r"), (3, "q w e r"), (None, "alone here")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(nulls).collect()) == [("3", "3", True), ("None", "3", False), ("None", "None", True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
