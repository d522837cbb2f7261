import hashlib
import re

from pyspark.sql import functions as F

from sparkloom.llm.common import read
from sparkloom.llm.disclosure import op2_disclosure, sanitised

SF01 = "/root/testdata/sf0.01"
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def fits(kind, s):
    d = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    spans = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if fits(k, m[0])] for k, p in RULES}
    base = ",".join(f"{k}:{a}:{b}" for k, _ in RULES for a, b in spans[k])
    return (*(len(spans[k]) for k, _ in RULES), hashlib.sha256(base.encode()).hexdigest(), base)


def check(df, texts):
    for r in df.collect():
        *want, base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == want, r
        assert r.spans == base or re.match(re.escape(base + "," if base else "") + "(generalise|remove):", r.spans), r


def test_base_against_brute_force(spark):
    docs = read(spark, SF01, "documents")
    check(op2_disclosure(docs), {r.doc_id: r.text for r in docs.collect()})


def test_edge_cases(spark):
    texts = [
        None, "", "a@b.com._x@y.org é\U0001f600 z@w.de", "a@b@c.com", "\x01 a@b.co \x01 1.2.3.4", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.255 256.1.1.1",
        "4111 1111 1111 1111 and 4111-1111-1111-1111-1 5555555555554444", "+1 (555) 010-9999. +12 +1234567890123456 +49-30-123456-",
        "a" * 50000 + "@" + "b." * 20000 + "c", "1" * 60000, "1." * 60000, "+" * 2000 + "1 2" * 5000, "a.a@a.a" * 3000, "x@y.z " * 3000,
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, texts[2], 2)], "doc_id long, text string, spans int")
    check(op2_disclosure(docs), dict(enumerate(texts)))
    assert op2_disclosure(docs).count() == len(texts) + 1
    assert op2_disclosure(docs.limit(0)).count() == 0
    assert op2_disclosure(spark.createDataFrame([(None, "a@b.co"), (None, None)], "doc_id long, text string")).count() == 2


def test_terms_that_name_an_entity(spark):
    rows = [(i, f"number {i} we met Zorblax, a friend of all who lives here and writes from jo@ex{0}.org near the town today") for i in range(6)]
    rows += [(100 + i, f"we met someone near the town today as number {i} did") for i in range(60)]
    rows += [(200, "zorblax alone tells as much"), (None, "so does (Zorblax)"), (200, "zorblax alone tells as much"), (201, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, terms string")
    out = {r.doc_id: r for r in op2_disclosure(docs).collect()}
    assert all(r.spans == "" for i, r in out.items() if i and 100 <= i < 200) and out[200].spans.endswith(":0:7") and out[201].spans == ""
    assert all(out[i].n_remove + out[i].n_generalise > 0 and out[i].n_email == 1 for i in range(6))
    new = sanitised(docs)
    assert new.columns == docs.columns and new.count() == len(rows)
    text = {r.doc_id: r.text for r in new.collect()}
    assert "Zorblax" not in text[3] and "[EMAIL]" in text[3] and "near the town today" in text[3] and text[103] == rows[9][1]
    assert "orblax" not in text[200] and "orblax" not in text[None] and text[201] is None


def planted(seed, n, people):
    """Documents of common words, some about a person: an address, and far from it three words that only they go with."""
    import random

    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(400)]
    rows, hidden = [], {}
    for i in range(n):
        words = rng.sample(common, 80)
        who = i % people if i % 4 == 0 else None
        if who is not None:
            clues = [f"{w}{letters[who % 26]}{letters[who // 26]}" for w in ("nick", "firm", "street")]
            for c in clues:
                words[rng.randrange(60)] = c
            if i % 16 != 12:
                words.append(f"p{who}@mail.example")
            hidden[i] = {c for c in clues if c in words}
        rows.append((i, " ".join(words)))
    return rows, hidden


def test_planted_terms_are_found_wherever_they_stand(spark):
    rows, hidden = planted(11, 2400, 30)
    out = {r.doc_id: r for r in op2_disclosure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text, caught, total, wrong = dict(rows), 0, 0, 0
    for i, r in out.items():
        found = {text[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k in ("generalise", "remove")}
        if i in hidden:
            caught, total = caught + len(found & hidden[i]), total + len(hidden[i])
        wrong += len(found - hidden.get(i, set()))
    assert total > 500 and caught >= 0.95 * total and wrong == 0
    assert any(out[i].n_generalise + out[i].n_remove for i in hidden if out[i].n_email == 0)  # terms alone disclose


def test_disclosure_against_brute_force(spark):
    import math

    import regex

    from sparkloom.llm.disclosure import disclosing_pairs, entities_of

    texts = [r.text for r in read(spark, SF01, "documents").select("text").collect() if r.text is not None]
    docs = spark.createDataFrame([(hashlib.md5(t.encode()).hexdigest(), t) for t in texts], "key string, text string")
    rows = []
    for t in texts:
        names = {f"{k}:{m[0].lower()}" for k, p in RULES for m in re.finditer(p, t) if fits(k, m[0])}
        terms = {regex.sub(r"[^\p{L}]+", "", w).lower() for w in regex.findall(r"(?<![^\s])[\p{P}\p{S}]*+\p{L}{3,}+[\p{P}\p{S}]*+(?![^\s])", t)}
        rows.append((t, names, terms))
    n, held, of_term, both, kinds = len(rows), {}, {}, {}, {}
    for t, names, terms in rows:
        for x in terms:
            of_term[x] = of_term.get(x, 0) + 1
        for e in names:
            held[e] = held.get(e, 0) + 1
            for x in terms:
                both[e, x] = both.get((e, x), 0) + 1
                kinds.setdefault((e, x), set()).add(t)
    for least, threshold, bits in ((1, 0.9, 40.0), (1, 0.4, 3.0), (1, 0.8, 1.0), (2, 0.01, 40.0)):
        want = {}
        for (e, x), c in both.items():
            value = min(1.0, math.log2(n * c / of_term[x] / held[e]) / math.log2(n / held[e]))
            if len(kinds[e, x]) >= least and value >= threshold and math.log2(of_term[x] / c) <= bits + 1e-9:
                want[e, x] = value
        found = disclosing_pairs(docs, entities_of(docs), least, threshold, bits).collect()
        got = {(r.entity, r.term): r.disclosure for r in found}
        edge = {k for k in got.keys() ^ want.keys() if abs(got.get(k, want.get(k)) - threshold) > 1e-9}
        assert not edge and all(abs(got[k] - want[k]) < 1e-9 for k in got.keys() & want.keys()) and (want or least == 2)


def test_many_matches_in_one_text(spark):
    import time

    def took(k):
        docs = spark.createDataFrame([(1, " ".join(f"u{i}@x.org" for i in range(k)))], "doc_id long, text string")
        start = time.time()
        assert op2_disclosure(docs).first().n_email == k
        assert sanitised(docs).first().text == " ".join(["[EMAIL]"] * k)
        return time.time() - start

    took(100)
    assert took(40_000) < took(4_000) + 30
