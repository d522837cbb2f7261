"""Steps whose tasks must not grow with the tables: partitions follow the rows, and results stay the same."""

import collections
import datetime
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import cooccur, lag, search
from sparkloom.plans.bindings import mentions
from sparkloom.plans.registry import QUERIES
from sparkloom.sources import scratch

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_mentions_and_weights_in_partitions_that_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "PART_ROWS", 500)
    m = mentions(spark, SF)
    assert m.rdd.getNumPartitions() == cooccur.parts(m.count()) > 10
    pairs = cooccur.entity_pairs(m).count()
    assert cooccur.parts(pairs) <= QUERIES["mentions_pairs"](spark, SF).rdd.getNumPartitions() <= 2 * cooccur.parts(pairs)


@pytest.mark.parametrize("name", ["mentions_pairs", "mentions_pairs_multiset", "pairs_flagged", "mentions_pair_reduction", "entity_graph", "khop", "links_npmi", "links_downstream", "causal_roots", "causal_summary", "overall", "sector_situation", "explorer_totals", "critic_statistics", "agent_briefing", "lag_samples", "bm25"])
def test_the_same_rows_in_small_parts_and_without_broadcast(spark, monkeypatch, name):
    sf = "/root/testdata/sf0.01" if name == "causal_roots" else SF  # which has none in the smallest tables
    want = rows_of(QUERIES[name](spark, sf))
    monkeypatch.setattr(cooccur, "PART_ROWS", 15_000 if sf != SF else 1500)
    monkeypatch.setattr(scratch, "SMALL_ROWS", 5)
    assert rows_of(QUERIES[name](spark, sf)) == want and want


@pytest.mark.parametrize("name", ["overall", "sector_situation", "explorer_totals", "causal_roots", "causal_summary", "critic_statistics", "agent_briefing"])
def test_links_are_made_once(spark, name):
    """The report reads small or stored tables; the mentions' pairs are not in its plan once for each part of it."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "/mentions-" not in plan and "/documents-" not in plan


def test_lags_store_the_ends_only(spark, monkeypatch):
    """Mentions of entities that are in no pair are left out before anything is stored; the lags are the same as by hand."""
    held, put = {}, lag.stored

    def counted(df, what, *a):
        out = put(df, what, *a)
        held[what] = out.count()
        return out

    monkeypatch.setattr(lag, "stored", counted)
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, f"e{i % 50}", "s", day + datetime.timedelta(hours=7 * i)) for i in range(1000)]
    m = spark.createDataFrame(rows, "doc_id long, entity string, source string, ts timestamp")
    pairs = spark.createDataFrame([("e1", "e2"), ("e7", "e3")], "e1 string, e2 string")
    got = {(r.e1, r.e2): (r.n1, r.n2) for r in lag.lag_sums(m, pairs).collect()}
    near = lambda a, b: sum(6 <= (y - x) * 7 <= 14 * 24 for x in range(a, 1000, 50) for y in range(b, 1000, 50))
    assert got == {("e1", "e2"): (near(1, 2), near(2, 1)), ("e7", "e3"): (near(7, 3), near(3, 7))}
    assert held["lag-times"] == 80


def test_words_are_counted_in_parts_that_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "PART_ROWS", 100)
    files, put = {}, search.stored

    def counted(df, what, *a):
        out = put(df, what, *a)
        files[what] = out.select(F.input_file_name()).distinct().count()
        return out

    monkeypatch.setattr(search, "stored", counted)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 90}" for j in range(50))) for i in range(400)], "id long, text string")
    q = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w89 nothing"), (3, None)], "query_id long, text string")
    assert search.bm25(docs, q).where("rank <= 3").count() == 6
    assert files["bm25-tf"] > 50


def test_summaries_are_made_where_the_text_is_read(spark):
    """No shuffle, and a row for each row: equal and null ids don't merge texts, empty sentences and ties keep their places."""
    rng = random.Random(8)
    words = ["Été", "naïve", "of", "the", "STORM", "storm", "ﬁn", "42", "Ⅷ", "x"]
    texts = [None, "", "A. B. C. D.", " ".join(" ".join(rng.choice(words) for _ in range(6)) + "." for _ in range(400))]
    texts += [" ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) + rng.choice([".", "!", "?", ".  \n", ""]) for _ in range(rng.randint(1, 20))) for _ in range(200)]
    rows = [(rng.choice([None, 1, 2, 3]), t) for t in texts]

    def by_hand(t):
        t = t or ""
        parts = [p for p in re.split(r"(?<=[.!?])\s+", t) if p.strip(" ")]
        if len(parts) <= 3 or len(t) < 50:
            return t
        found = [[w for w in re.findall("[a-zéïﬁⅷ]+", p.lower()) if len(w) > 2] for p in parts]
        n = collections.Counter(itertools.chain(*found))
        score = [sum(n[w] for w in ws) / len(ws) if ws else 0 for ws in found]
        return " ".join(parts[i] for i in sorted(sorted(range(len(parts)), key=lambda i: (-score[i], i))[:3]))

    out = text.summary(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(str((i, by_hand(t))) for i, t in rows)
    assert "Exchange" not in QUERIES["summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_odd_documents(spark):
    """Nulls, repeated mentions, several sources of an entity, equal ord, and a hub document."""
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *"abcdefgh"]), rng.choice([None, "s", "t"]), rng.choice([None, 1, 2, 3])) for _ in range(400)]
    rows += [(99, f"x{i % 300:03d}", "s", i) for i in range(400)]
    m = spark.createDataFrame(rows, "doc_id long, entity string, source string, ord long")
    docs = {}
    for d, e, _, o in rows:
        if d is not None:
            docs.setdefault(d, []).append((e, o))
    want = sorted((d, a, b) for d, es in docs.items() for a, b in itertools.combinations(sorted({e for e, _ in es if e is not None}), 2))
    assert sorted((r.doc_id, r.e1, r.e2) for r in cooccur.entity_pairs(m).collect()) == want
    least = lambda f, *x: f((y for y in x if y is not None), default=None)
    multi = [(d, least(min, a[0], b[0]), least(max, a[0], b[0])) for d, es in docs.items() for a, b in itertools.permutations(es, 2) if None not in (a[1], b[1]) and a[1] < b[1]]
    assert sorted(map(str, multi)) == sorted(str((r.doc_id, r.e1, r.e2)) for r in cooccur.entity_pairs(m, multiset=True).collect())
    assert sum(r.weight for r in cooccur.pair_weights(m, multiset=True).collect()) == len(multi)
