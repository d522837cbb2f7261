import re
import zlib
from collections import Counter, defaultdict

import pytest

from sparkloom.llm.common import read
from sparkloom.llm.spelling import LONG, near_words, op11_spelling, roots

SF = "/root/testdata/sf0.001"


def counts(rows):
    found = Counter()
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            found[run if h % 31 else run[:at] + run[at + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def neighbours(words):
    """All pairs one edit apart, by deletions kept in a dictionary."""
    near, same = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            same[i, less].add(w)
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(rows):
    n = counts(rows)
    near = neighbours(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def result(docs):
    rows = op11_spelling(docs).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert result(docs) == want and any(v[0] for v in want.values())


def test_edits_in_every_place_and_length(spark):
    base = ["abcdefg", "mississippi", "aaaaaaaa", "ÿéàabcÀ", "x" * (LONG - 1), "y" * LONG, "z" * (LONG + 1), "ab" * 60]
    words = set(base)
    for w in base:
        for i in range(len(w) + 1):
            words |= {w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "é" + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 7)
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = defaultdict(set)
    for r in near_words(df).collect():
        assert r.other not in got[r.word]
        got[r.word].add(r.other)
    want = {w: v for w, v in neighbours(dict.fromkeys(words)).items() if v}
    assert dict(got) == want


def test_chain_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("a", "w3")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert set(got.values()) == {"w40"} and len(got) == 41


@pytest.mark.parametrize("rows", [
    [],
    [(1, None), (2, ""), (3, "short words only")],
    [(None, "Receive RECEIVE receive Récéive"), (4, "receive " * 30 + "recieve recieve receve receve"), (4, "receive"), (4, "receive")],
    [(i, "k" * 70_000 + " " + "k" * 69_999) for i in (7, 8)],
])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, word string, n int")
    assert result(docs) == brute(rows)
