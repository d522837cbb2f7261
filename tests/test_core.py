"""Small hand-made cases: expected values follow from the operators' definitions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import cooccur, dedup, graph, scoring, search, signals, trends
from sparkloom.sources import ingest

ARTICLES = [
    (1, "reuters", "2026-05-28", '{"persons": ["Jensen Huang"], "orgs": ["NVIDIA"], "locations": ["Santa Clara"]}'),
    (2, "bloomberg", "2026-05-28", '{"persons": ["Jerome Powell"], "orgs": ["Federal Reserve"], "locations": ["Washington"]}'),
    (3, "reuters", "2026-05-27", '{"persons": ["Jensen Huang", "Jerome Powell"], "orgs": ["NVIDIA", "Federal Reserve"], "locations": []}'),
    (4, "ap", "2026-05-26", '{"persons": [], "orgs": ["Congress"], "locations": [" Washington ", " "]}'),
    (5, "bloomberg", "2026-05-25", '{"orgs": ["Wall Street"], "locations": ["New York"]}'),
    (6, "bloomberg", "not a day", "malformed"),
    (7, "bloomberg", None, None),
]


@pytest.fixture(scope="module")
def mentions(spark):
    df = spark.createDataFrame(ARTICLES, "doc_id long, source string, published string, json string")
    df = df.withColumn("entities", T.entity_arrays(F.col("json"))).withColumn("ts", T.parse_time(F.col("published")))
    return T.mentions_of(df).cache()


def test_mentions_and_graph(mentions):
    assert mentions.count() == 14 and mentions.select("entity").distinct().count() == 9
    assert {r.entity for r in cooccur.important_entities(mentions).collect()} == {"nvidia", "federal reserve", "jensen huang", "jerome powell", "washington"}
    edges = graph.entity_graph(mentions)
    assert [tuple(r) for r in edges.collect()] == [("federal reserve", "jerome powell", 2), ("jensen huang", "nvidia", 2)]
    central = graph.degree_centrality(edges, cooccur.important_entities(mentions))
    assert {r.entity: r.centrality for r in central.collect()} == {"nvidia": 0.25, "federal reserve": 0.25, "jensen huang": 0.25, "jerome powell": 0.25, "washington": 0.0}


def test_nothing_where_there_is_too_little(spark, mentions):
    sectors = spark.createDataFrame([("nvidia", "technology"), ("federal reserve", "finance"), ("jensen huang", "technology"), ("jerome powell", "finance")], "entity string, sector string")
    assert cooccur.sector_links(mentions, sectors).count() == 0
    daily = trends.daily_counts(mentions)
    assert trends.velocity(daily).count() == 0 and trends.bursts(daily).count() == 0
    n = {r.entity: r for r in trends.narratives(daily, min_length=3).collect()}
    assert set(n) == {"nvidia", "jensen huang", "federal reserve", "jerome powell", "washington"}
    assert {(r.phase, r.recent_7_days, r.acceleration) for r in n.values()} == {("emerging", 2, 2)}


@pytest.mark.parametrize(("counts", "phase"), [([0, 1, 3, 5], "emerging"), ([10, 7, 4, 2], "fading"), ([5, 5, 5], "peaked"), ([1, 5, 15, 3], "growing"), ([20, 10, 3, 1], "fading"), ([], "emerging"), ([5], "emerging")])
def test_phases(spark, counts, phase):
    from sparkloom.streaming.streams import phase_of

    df = spark.createDataFrame([(counts,)], "c array<long>")
    assert df.select(trends.phase_of_series(F.col("c"))).first()[0] == phase == phase_of(counts)


def link(spark, **over):
    row = {"source_entity": "nvidia", "target_entity": "federal reserve", "source_sector": "technology", "target_sector": "finance", "cooccurrence_count": 5, "source_diversity": 3, "strength": 0.75, "semantic_similarity": 0.6} | over
    return spark.createDataFrame([tuple(row.values())], "source_entity string, target_entity string, source_sector string, target_sector string, cooccurrence_count long, source_diversity long, strength double, semantic_similarity double")


def test_confidence_and_impact(spark):
    assert (c := scoring.calibrate_links(link(spark)).first()).confidence == 0.843 and c.confidence_label == "high"
    assert scoring.calibrate_links(link(spark, cooccurrence_count=3, source_diversity=2, semantic_similarity=0.4)).first().confidence == 0.779
    causal = link(spark, cooccurrence_count=100, source_diversity=50, semantic_similarity=0.95).withColumn("causal_direction", F.lit("a")).withColumn("causal_mechanism", F.lit("b"))
    assert scoring.calibrate_links(causal).first().confidence == 0.85
    zero = scoring.calibrate_links(link(spark, cooccurrence_count=0, source_diversity=0, semantic_similarity=0.0)).first()
    assert (zero.confidence, zero.confidence_label) == (0.15, "low")
    impact = scoring.predict_impact(link(spark).withColumn("confidence", F.lit(0.75)), scoring.impact_table(spark)).first().impact
    assert (impact.likelihood, impact.timeframe, impact.predicted_effect) == (0.63, "medium", "Capital reallocation")


def test_alerts(spark):
    links = link(spark).withColumn("confidence", F.lit(0.85))
    none = links.limit(0)
    assert [r.severity for r in signals.relationship_alerts(links, none).collect()] == ["high"]
    assert signals.relationship_alerts(links, links).count() == 0 and signals.relationship_alerts(none, none).count() == 0


def test_entity_cells(spark):
    cells = ['{"persons": ["A"]}', "", "{bad", None, '{"orgs": null}']
    out = spark.createDataFrame([(c,) for c in cells], "c string").select(T.entity_arrays(F.col("c")).alias("e")).collect()
    assert [(r.e.persons, r.e.orgs, r.e.locations) for r in out] == [(["A"], [], [])] + [([], [], [])] * 4


def test_text_functions(spark):
    def one(f, value):
        return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]

    assert one(T.clean_text, "Caf&eacute; \U0001f600 see https://x.y/z  now\n") == "Café see now"
    assert one(T.clean_text, None) == ""
    assert one(T.canonical_url, "https://www.Example.com/a?utm_source=x&id=2&fbclid=9/") == "https://example.com/a?id=2"
    assert one(T.canonical_url, "http://e.com/p?ref=1") == "http://e.com/p"
    assert one(T.normal_title, "The Rise, of a  New Era!") == "rise new era"
    assert one(T.headline, "Markets fall | Example News") == "Markets fall"
    assert one(T.fuzzy_hash, "b a, A!") == one(T.fuzzy_hash, "a b") and one(T.fuzzy_hash, " ") == ""
    assert tuple(one(T.category, "Sports NewsTeam wins")) == ("Sports", "NewsTeam wins")
    assert one(T.remove_boilerplate, "Read more about it here\nA perfectly normal sentence.\nshort\n© 2024 by someone else") == "A perfectly normal sentence."
    assert one(lambda c: T.shingles(c), "abcd") == [] and one(lambda c: T.shingles(c), "abcdef") == ["abcde", "bcdef"]
    assert one(T.sensationalism, "War and peace") == 0.3333


def test_merge_and_backfill(spark):
    cols = "title string, source string, link string, full_text string, n long"
    old = spark.createDataFrame([("Hello", "a", "l1", "x", 1)], cols)
    new = spark.createDataFrame([(" hello ", "a", "l1", None, 2), ("World", "a", "l2", None, 3), ("world", "a", "l2", None, 4), (None, None, None, None, 5)], cols)
    assert sorted(r.n for r in ingest.merge_new(old, new, "n").collect()) == [3, 5]
    details = spark.createDataFrame([("l2", "long text"), ("l2", "t")], "link string, full_text string")
    got = ingest.backfill(new, details).collect()
    assert len(got) == 4 and {r.n: r.full_text for r in got} == {2: None, 3: "long text", 4: "long text", 5: None}


def test_dedup(spark):
    df = spark.createDataFrame([(1, "hello world again"), (2, "hello world again"), (3, "completely different"), (4, ""), (5, "")], "doc_id long, title string")
    assert [r.doc_id for r in dedup.dedup_exact(df).orderBy("doc_id").collect()] == [1, 3, 4]
    assert [r.doc_id for r in dedup.dedup_similar(df).orderBy("doc_id").collect()] == [1, 3, 4, 5]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (4, 5)], "a long, b long")
    assert sorted(r.x for r in dedup.greedy_drops(edges).collect()) == [2, 4, 5]
    assert {(r.root, r.member) for r in dedup.duplicate_groups(edges).collect()} == {(1, 2), (3, 4), (1, 5)}


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("b", "c", 1), ("a", "c", 9), ("c", "d", 1)], "e1 string, e2 string, weight long")
    labels = graph.shortest_weighted_paths(edges, spark.createDataFrame([("a",)], "node string"))
    out = {r.node: (r.dist, r.path) for r in labels.join(graph.traced(labels, labels, 3).drop("root"), "node").collect()}
    assert out["d"] == (7.0, ["a", "b", "c", "d"]) and out["c"][0] == 6.0 and out["a"] == (0.0, ["a"])
    assert {r.node: r.dist for r in graph.shortest_weighted_paths(edges, spark.createDataFrame([("a",)], "node string"), max_hops=1).collect()} == {"a": 0.0, "b": 5.0, "c": 9.0}


def test_paths_against_brute_force(spark):
    """A random graph of 200 nodes: costs, hops and the path by (cost, hops, name of the node before)."""
    rng = random.Random(7)
    names = [f"n{i:03}" for i in range(200)]
    weights = {}
    for i in range(1, 190):
        for j in {rng.randrange(i), rng.randrange(i)}:
            weights[names[j], names[i]] = rng.randint(1, 9)
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "e1 string, e2 string, weight long")
    roots = ["n000", "n150", "n199"]
    labels = graph.shortest_weighted_paths(edges, spark.createDataFrame([(r,) for r in roots], "node string"))
    around = {}
    for (a, b), w in weights.items():
        around.setdefault(a, {})[b] = w
        around.setdefault(b, {})[a] = w
    want = {}
    for root in roots:
        best = {root: (0, 0)}
        for _ in range(200):
            for u in list(best):
                for v, w in around.get(u, {}).items():
                    best[v] = min(best.get(v, (10**9, 0)), (best[u][0] + w, best[u][1] + 1))
        for v, (dist, hops) in best.items():
            path = [v]
            while path[0] != root:
                d, h = best[path[0]]
                path.insert(0, min(u for u, w in around[path[0]].items() if u in best and best[u] == (d - w, h - 1)))
            want[root, v] = (float(dist), hops, path)
    deepest = max(h for _, h, _ in want.values())
    paths = {(r.root, r.node): r.path for r in graph.traced(labels, labels, deepest).collect()}
    assert {(r.root, r.node): (r.dist, r.hops, paths[r.root, r.node]) for r in labels.collect()} == want
    with pytest.raises(RuntimeError, match="still fall"):
        graph.shortest_weighted_paths(edges, spark.createDataFrame([("n000",)], "node string"), max_rounds=2)


def test_summary_keeps_the_best_sentences(spark):
    long_ = "Cats sleep daily. Dogs bark at cats and dogs. Rain fell once. Cats and dogs sleep while cats dream! Nothing else?"
    rows = [(1, long_), (2, "One. Two."), (3, None), (4, ""), (5, "Short. A. B. C. D.")]
    out = {r.doc_id: r.summary for r in T.summary(spark.createDataFrame(rows, "doc_id long, text string"), keep=2).collect()}
    assert out[2] == "One. Two." and out[3] == out[4] == "" and out[5] == "Short. A. B. C. D."

    import re
    from collections import Counter

    parts = re.split(r"(?<=[.!?])\s+", long_)
    words = [[w for w in re.findall("[a-z]+", p.lower()) if len(w) > 2] for p in parts]
    f = Counter(w for ws in words for w in ws)
    score = [-sum(f[w] for w in ws) / len(ws) for ws in words]
    first = sorted(sorted(range(len(parts)), key=lambda i: (score[i], i))[:2])
    assert out[1] == " ".join(parts[i] for i in first)


def test_kmeans_topics_find_planted_groups(spark):
    from sparkloom.operators import narratives

    rng = random.Random(1)
    rows = [(10 * g + i, [100.0 * g + rng.random(), 50.0 * g + rng.random()]) for g in range(3) for i in range(6)] + [(99, [-900.0, 900.0])]
    out = {r.id: r.cluster for r in narratives.cluster_vectors(spark.createDataFrame(rows, "id long, embedding array<double>"), 4).collect()}
    assert out[99] == -1 and len({out[10 * g] for g in range(3)} - {-1}) == 3
    assert all(out[10 * g + i] == out[10 * g] for g in range(3) for i in range(6))


def test_column_profile(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}", f"name {i}", None) for i in range(200)], "id long, kind string, name string, none string")
    out = {r.column: (r.distinct_values, r.categorical) for r in ingest.categorical_profile(df).collect()}
    assert out["kind"] == (3, True) and out["none"][1] and not out["name"][1] and 170 < out["name"][0] < 230 and "id" not in out
    assert ingest.drop_temporary(spark.createDataFrame([(1, 2, 3)], "a int, b_tmp int, c_tmp int"), keep=("c_tmp",)).columns == ["a", "c_tmp"]


def test_feed_takes_each_kind_by_its_own_scale(spark):
    from sparkloom.operators import briefing

    links = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 60.0)], "source_entity string, target_entity string, strength double")
    spikes = spark.createDataFrame([("k", None, 250.0), (None, "e", 50.0)], "keyword string, entity string, score double")
    topics = spark.createDataFrame([("t", -5)], "topic string, acceleration long")
    chains = spark.createDataFrame([("x->y->z", 40.0)], "chain string, total_weight double")
    out = [tuple(r) for r in briefing.discovery_feed(links, spikes, topics, chains, per_kind=2, top=5).collect()]
    assert out == [("link", "c - d", 1.0), ("signal", "k", 1.0), ("signal", "e", 0.5), ("topic", "t", 0.5), ("chain", "x->y->z", 0.4)]


def test_dedup_step_and_its_report(spark):
    titles = ["the same headline about rain"] * 2 + ["the same headline about rains"] + [f"{c * 9} words of its own" for c in "abcdefghijk"]
    df = spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    out, report = dedup.dedup_step(df)
    assert sorted(r.doc_id for r in out.collect()) == [0, *range(3, 14)] and tuple(report.first()) == (14, 13, 12)
    few, report = dedup.dedup_step(df.limit(3))
    assert few.count() == 2 and tuple(report.first()) == (3, 2, 2)


def test_explanations_and_defaults(spark):
    one = link(spark).withColumn("confidence", F.lit(0.8125))
    examples = spark.createDataFrame([("nvidia", "federal reserve", i, 100 - i) for i in range(1, 6)], "source_entity string, target_entity string, rank int, doc_id long")
    r = scoring.explain_links(one, scoring.why_table(spark), examples).first()
    assert r.why_connected == "Capital markets and investment flows (nvidia) fund or constrain technology development (federal reserve)."
    assert r.evidence.asDict() == {"cooccurrence_count": 5, "source_diversity": 3, "relationship_strength": 0.75, "confidence": 0.813, "examples": [99, 98, 97]}
    odd = scoring.explain_links(link(spark, source_sector="x{b}", target_sector="y"), scoring.why_table(spark)).first()
    assert odd.why_connected.startswith("Entities in x{b} and y are connected") and odd.evidence.examples == []
    plain = scoring.downstream_effects(one, spark.createDataFrame([], "p1 string, p2 string, effects array<string>")).first().downstream
    assert plain == ["Cross-domain propagation between technology and finance", "Secondary effects in connected sectors", "Potential narrative amplification across sources"]


def test_bundle_of_folders(spark, tmp_path):
    results = {"links": link(spark), "none": link(spark).limit(0)}
    ingest.write_bundle(results, str(tmp_path))
    ingest.write_bundle(results, str(tmp_path))
    rows = ingest.read_bundle(spark, str(tmp_path), ["links", "none"]).collect()
    assert len(rows) == 1 and rows[0].result == "links" and '"source_entity":"nvidia"' in rows[0].row


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "blue whale swims"), (3, "red whale"), (4, "green frog"), (5, "grey owl")], "id long, text string")
    q = spark.createDataFrame([(9, "blue whale")], "query_id long, text string")
    assert [r.id for r in search.bm25(docs, q, 2).orderBy("rank").collect()] == [2, 3]
    vec = search.hashed_embeddings(docs.unionByName(q.withColumnRenamed("query_id", "id"))).select("id", "text", "embedding")
    best = search.hybrid_search(vec.where("id < 9"), docs, vec.where("id = 9").withColumnRenamed("id", "query_id"), 3).where("rank = 1").first()
    assert best.id == 2


def test_feed_and_page(spark):
    xml = "<rss><channel><item><title>A &lt;b&gt;title&lt;/b&gt;</title><link>http://x/1</link><pubDate>d</pubDate></item><item><title>no link</title></item></channel></rss>"
    out = ingest.feed_entries(spark.createDataFrame([("s", "in", xml)], "source string, country string, xml string")).collect()
    assert [(r.title, r.link, r.published) for r in out] == [("A title", "http://x/1", "d")]
    page = "<article><h2>A headline of some length</h2><p>Some description here</p><a href='/x'>go</a></article>" * 2
    cards = ingest.page_cards(spark.createDataFrame([(1, "http://h.com/p", page)], "page_id long, url string, html string")).collect()
    assert [(r.title, r.description, r.link, r.source) for r in cards] == [("A headline of some length", "Some description here", "http://h.com/x", "h.com")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\n\"b\"", datetime.datetime(2024, 1, 2))], "doc_id long, title string, ts timestamp")
    ingest.save_analyzed(df, str(tmp_path / "p"))
    assert ingest.load_analyzed(spark, str(tmp_path / "p")).select("title").first()[0] == "a,\n\"b\""
    ingest.write_result(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    raw = spark.createDataFrame([("s", "t", "d", "l", "", "p", "x", "c", "line\n\"two\"", "y")], ingest.RAW_SCHEMA)
    ingest.save_raw(raw, str(tmp_path / "c"))
    assert ingest.load_raw(spark, str(tmp_path / "c")).first().full_text == "line\n\"two\""


def test_default_lexicons(spark):
    from sparkloom.functions import lexicons

    text = "The Prime Minister met Jane Goodall near London and Google today"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert docs.select(T.names_in(F.col("text"), lexicons.NAME_SKIP_WORDS)).first()[0] == ["Jane Goodall"]
    assert {(r.etype, r.name) for r in T.gazetteer(docs, lexicons.gazetteer_table(spark)).collect()} == {("orgs", "Google"), ("locations", "London")}
    names = spark.createDataFrame([("google", "orgs"), ("senate committee", "orgs"), ("senate committee", "persons"), ("xyz", "orgs")], "entity string, etype string")
    out = {(r.entity, r.sector, r.confidence) for r in cooccur.classify_sectors(names.where("etype = 'orgs'"), lexicons.sector_keyword_table(spark)).collect()}
    assert out == {("google", "technology", 0.3), ("senate committee", "politics", 0.5), ("xyz", "global_events", 0.1)}
    effects = lexicons.downstream_table(spark)
    assert scoring.downstream_effects(link(spark, source_sector="technology", target_sector="finance"), effects).first().downstream[0] == "Venture capital reallocation"


def test_tfidf_pairs_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(3)
    common = ["alpha", "beta", "gamma", "delta", "omega"]
    titles = ["alpha beta gamma"] * 1100 + ["alpha beta gamma delta omega kappa lambda"] * 3
    titles += [" ".join(rng.choice(common) for _ in range(rng.randrange(2, 9))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    vectors = dedup.tfidf(docs, "title").localCheckpoint()
    by_id = {}
    for r in vectors.collect():
        by_id.setdefault(r.id, {})[r.term] = r.w
    first = {}
    for i in sorted(by_id):
        first.setdefault(tuple(sorted((t, round(w, 7)) for t, w in by_id[i].items())), i)
    ones = sorted(first.values())
    want = {}
    for k, a in enumerate(ones):
        for b in ones[k + 1 :]:
            sim = sum(w * by_id[b].get(t, 0.0) for t, w in by_id[a].items())
            if sim >= 0.85:
                want[a, b] = sim
    assert want
    for i in by_id:
        f = first[tuple(sorted((t, round(w, 7)) for t, w in by_id[i].items()))]
        if f != i:
            want[f, i] = 1.0
    got = {(r.a, r.b): r.similarity for r in dedup.tfidf_pairs(vectors).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert sum(a == 0 for a, _ in got) >= 1099


def test_groups_hold_copies(spark):
    """Against brute force over all rows: copies of kept rows, of dropped rows, in other letter case; texts without a gram."""
    rng = random.Random(6)
    titles = ["abc", "abc", None, ""]
    for _ in range(20):
        t = "".join(rng.choice("abcdefgh ") for _ in range(40))
        near = [t + "x", t + "xy", t[1:]]
        titles += [t, near[0], near[0].upper(), t, near[1], near[2], near[1], near[2]]
    df = spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    sets = {i: {t[j : j + 5].lower() for j in range(len(t) - 4)} for i, t in enumerate(titles) if t and len(t) > 4}
    kept, want = [], set()
    for i, s in sets.items():
        roots = [k for k in kept if len(sets[k] & s) >= 0.85 * len(sets[k] | s)]
        if roots:
            want.add((roots[0], i))
        else:
            kept.append(i)
    got = [(r.root, r.member) for r in dedup.duplicate_groups(dedup.similar_pairs(df), dedup.set_copies(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 140
    assert {r.doc_id for r in dedup.dedup_similar(df).collect()} == set(range(len(titles))) - {m for _, m in got}


def test_keep_first_by_tfidf_drops_copies_of_dropped_rows(spark):
    """Against keep-first over all pairs: copies of kept rows, copies of dropped ones, rows that only a dropped one is near."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    titles = []
    for _ in range(25):
        t = rng.sample(words, 12)
        near = [[*t, rng.choice(words)] for _ in range(2)]
        titles += [" ".join(x) for x in (t, near[0], near[0], near[1], [*near[0], rng.choice(words)], t, near[1])]
    vectors = dedup.tfidf(spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string"), "title", features=None).localCheckpoint()
    held = {}
    for r in vectors.collect():
        held.setdefault(r.id, {})[r.term] = r.w
    kept = []
    for i in sorted(held):
        if all(sum(w * held[i].get(t, 0.0) for t, w in held[k].items()) < 0.85 for k in kept):
            kept.append(i)
    gone = [r.x for r in dedup.tfidf_drops(vectors).collect()]
    assert len(gone) == len(set(gone)) and set(gone) == set(held) - set(kept) and len(kept) < 75
    by_pairs = {r.x for r in dedup.greedy_drops(dedup.tfidf_pairs(vectors)).collect()}
    assert by_pairs < set(gone)  # what the listed pairs alone drop


def test_names_in_reads_whole_texts(spark):
    names = [f"Anna {chr(65 + i)}{'x' * 3}" for i in range(15)]
    text = ". ".join(names) + " " + "word " * 1000 + "Jane Goodall"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert docs.select(T.names_in(F.col("text"), ["The"])).first()[0] == [*names, "Jane Goodall"]
    assert docs.select(T.names_in(F.col("text"), ["The"], limit=2, chars=2000)).first()[0] == names[:2]


def test_impact_takes_the_forward_pattern_of_a_pair_once(spark):
    links = spark.createDataFrame([("x", "y", "A", "B", 0.5), ("y", "z", "B", "A", 0.5), ("x", "z", "A", "C", 0.5)], "source_entity string, target_entity string, source_sector string, target_sector string, confidence double")
    patterns = [("A", "B", 0.4, "short", "ahead"), ("B", "A", 0.8, "long", "back"), ("A", "B", 0.4, "short", "ahead"), ("C", "A", 0.2, "long", "only back")]
    out = scoring.predict_impact(links, spark.createDataFrame(patterns, "p1 string, p2 string, likelihood double, timeframe string, effect string")).collect()
    assert sorted((r.source_entity, r.target_entity, r.impact.predicted_effect) for r in out) == [("x", "y", "ahead"), ("x", "z", "only back"), ("y", "z", "back")]


def test_large_dictionaries_give_the_same_hits(spark):
    words = ["an", "ana", "banana", "é😀", "x y", "q"]
    rows = spark.createDataFrame([(1, "banana é😀"), (2, "x y"), (3, ""), (4, None), (5, "an")], "id long, t string")
    entries = spark.createDataFrame([(w,) for w in words], "w string")
    hits = [sorted((r.id, r.w) for r in T.containing(rows, "t", entries, "w", most).collect()) for most in (100, 2)]
    assert hits[0] == hits[1] == sorted((r, w) for r, t in ((1, "banana é😀"), (2, "x y"), (5, "an")) for w in words if w in t)


def test_sums_of_lags_equal_the_lags(spark):
    import random

    from pyspark.sql import functions as F

    from sparkloom.operators import lag

    rng = random.Random(2)
    rows = [(i, rng.choice("abcd"), "s", rng.randrange(90 * 24) * 3600 + rng.choice([0, 0, 1])) for i in range(300)]
    m = spark.createDataFrame(rows, "doc_id long, entity string, source string, t long").withColumn("ts", F.timestamp_seconds("t"))
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("b", "none")], "e1 string, e2 string")
    s = lag.lag_samples(m, pairs).groupBy("e1", "e2").agg(F.count_if("ahead").alias("n1"), F.count_if(~F.col("ahead")).alias("n2"), F.avg(F.when(F.col("ahead"), F.col("lag_hours"))).alias("l1"), F.avg(F.when(~F.col("ahead"), F.col("lag_hours"))).alias("l2"))
    want = {(r.e1, r.e2): (r.n1, r.n2, round(r.l1, 6), round(r.l2, 6)) for r in s.collect()}
    got = {(r.e1, r.e2): (r.n1, r.n2, round(r.l1, 6), round(r.l2, 6)) for r in lag.lag_sums(m, pairs).collect()}
    assert got == want and len(want) == 3


def test_contexts_add_to_sectors(spark):
    keywords = spark.createDataFrame([("metals", 0, "steel", "keyword"), ("finish", 1, "polished", "keyword")], "sector string, rank int, keyword string, kind string")
    names = spark.createDataFrame([("steel mill", "orgs"), ("mill", "orgs"), ("none", "orgs")], "entity string, etype string")
    contexts = spark.createDataFrame([("mill", "a Polished floor"), ("mill", "polished again"), ("steel mill", "made of steel")], "entity string, text string")
    out = {(r.entity, r.sector, r.confidence) for r in cooccur.classify_sectors(names, keywords, contexts).collect()}
    assert out == {("steel mill", "metals", 0.26), ("mill", "finish", 0.06), ("none", "global_events", 0.1)}
