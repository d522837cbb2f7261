"""The brute force below reads words with its own rules; it shares only the fixed word lists."""

import itertools
import random
import re

from sparkloom.llm.common import read
from sparkloom.llm.templates import COMMON, NUMBER_WORDS, UNITS, decontaminated, op5_templates

SF01 = "/root/testdata/sf0.01"


def tokens(text):
    """[(sort, what it is compared by, stripped words)] with names and number words in a row made one."""
    out, broken = [], True
    for raw in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        if re.fullmatch(r"[-+*/=<>^×÷±≤≥≠]+", raw):
            core = raw
        else:
            core = raw
            while core and not (re.match(r"[\w$€£+-]", core[0])):
                core = core[1:]
            while core and not re.match(r"[\w%]", core[-1]):
                core = core[:-1]
        low = core.lower()
        if not core:
            broken = True
            continue
        if low in UNITS:
            sort = "unit"
        elif re.fullmatch(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?", core):
            sort = "number"
        elif all(x in NUMBER_WORDS for x in low.split("-")):
            sort = "counting"
        elif core[0].upper() == core[0] != core[0].lower() and core.upper() != core and low not in COMMON:
            sort = "name"
        else:
            sort = "word"
        before = out[-1][0] if out and not broken else None
        if sort == "name" == before or sort == "counting" and before in ("number", "counting"):
            out[-1][2].append(core)
            out[-1][0] = sort
        else:
            out.append([sort, low, [core]])
        broken = not raw.endswith(core)
    out = [("number" if sort == "counting" else sort, low, " ".join(w)) for sort, low, w in out]
    return [(sort, low if sort == "word" else sort, w) for sort, low, w in out]


def brute(docs, items, width=8):
    out = {}
    items = [(i, tokens(t)) for i, t in items]
    items = [(i, t, min(width, len(t))) for i, t in items if t]

    def forms(stretch):
        slots = sum(k != "word" for k, _, _ in stretch)
        if slots * 8 <= len(stretch) * 5:
            yield tuple(c for _, c, _ in stretch)
        if 2 * slots > len(stretch):
            yield ("own", *(w.lower() for _, _, w in stretch))

    starts = {}
    for i, t, size in items:
        for q in range(len(t) - size + 1):
            for f in forms(t[q : q + size]):
                starts.setdefault((size, f), []).append((i, q))
    of_item = {i: t for i, t, _ in items}
    sizes = {size for _, _, size in items}
    for d, text in docs:
        t, lines = tokens(text), {}
        for size in sizes:
            for p in range(len(t) - size + 1):
                for f in forms(t[p : p + size]):
                    for i, q in starts.get((size, f), ()):
                        lines.setdefault((i, p - q), set()).update(range(q, q + size))
        covered = {}
        for (i, line), places in lines.items():
            values = {}
            for q in places:
                kind, _, a = of_item[i][q]
                if kind != "word":
                    b = t[q + line][2]
                    values.setdefault((kind == "name", a), set()).add(a if b.endswith(" " + a) or b.startswith(a + " ") else b)
            if 10 * sum((len(v) > 1) * (1 if name else 0.25) for (name, _), v in values.items()) <= len(values):
                covered.setdefault(i, set()).update(places)
        for i, places in covered.items():
            if 2 * len(places) >= len(of_item[i]):
                out[d, i] = (len(places), len(of_item[i]))
    return out


def test_against_brute_force(spark):
    docs, bench = read(spark, SF01, "documents"), read(spark, SF01, "benchmark")
    got = {(r.doc_id, r.item_id): (r.covered, r.item_words) for r in op5_templates(docs, bench).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got == want and want


def test_fuzzed_texts_against_brute_force(spark):
    rng = random.Random(3)
    words = "Alice Bob Mary Ann has gives 3 7 12 two hundred kg apples. to the and, + = NASA Zürich été (see) - then -- 5% $4 twenty-five".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(2, 14)))) for i in range(60)]
    items += [(100 + i, " ".join(docs[i * 7][1].split()[3:20])) for i in range(40)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.item_words) for r in op5_templates(*frames).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 40


NAMES = "Alice Bob Carla Dmitri Elena Farid Greta Hugo Ines Jonas Mary-Ann Kofi".split() + ["Mary Ann", "Juan Carlos", "Van Dyke"]
THINGS = "apples marbles coins stamps books pencils tickets cookies shells ribbons".split()
QUESTIONS = [
    "{a} has {n} {t} and buys {m} more. {b} has {k} {t}. How many {t} do {a} and {b} have together?",
    "A train leaves {p} at {n} and travels {m} km in {k} hours. At what speed does it travel on its way from {p}?",
    "{a} gives {b} {n} {t}. Then {b} gives {m} of these {t} to {c}. If {b} keeps {k} {t}, how many did {b} own before?",
    "In a shop {t} cost {n} dollars each. {a} pays {m} dollars for some {t} and gets {k} dollars back; how many {t} does {a} buy?",
    "{a} reads {n} pages of a long novel every day. After {m} days {a} has {k} pages left. How long is the novel that {a} reads?",
]


def filled(rng, i, t):
    a, b, c = rng.sample(NAMES, 3)
    n, m, k = (rng.choice([str(rng.randrange(2, 900)), rng.choice(["two", "nine", "twelve", "twenty-five", "three hundred"])]) for _ in range(3))
    return QUESTIONS[i].format(a=a, b=b, c=c, n=n, m=m, k=k, t=t, p=rng.choice(["Boston", "Lima", "New York", "Oslo"]))


def test_recall_of_re_parameterised_questions(spark):
    rng = random.Random(8)
    pairs = list(itertools.product(range(len(QUESTIONS)), THINGS))
    items = [(j, filled(rng, i, t)) for j, (i, t) in enumerate(pairs)]
    noise = [r.text for r in read(spark, SF01, "documents").where("lang = 'en'").limit(100).collect()]
    docs, planted = [], set()
    for j, (i, t) in enumerate(pairs):
        for copy in range(4):
            docs.append((1000 + 10 * j + copy, f"{rng.choice(noise)[:400]}\n{filled(rng, i, t)}\n{rng.choice(noise)[:400]}"))
            planted.add((1000 + 10 * j + copy, j))
    docs += [(k, t) for k, t in enumerate(noise)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op5_templates(*frames).collect()}
    assert len(got & planted) >= 0.95 * len(planted)
    assert not any(d < 1000 for d, _ in got)


def test_reparameterised_question(spark):
    item = "A train leaves Boston at 9 and travels 120 km in 2 hours before it meets Anna at the old station"
    docs = [
        (1, "Intro here. A train leaves Denver at 7 and travels 300 miles in 5 hours before it meets Peter at the old station. More text"),
        (2, "A train is late today and nobody at the old station knows why it has not left the city yet"),
        (3, None), (4, ""), (None, item), (5, item), (5, item),
    ]
    docs = spark.createDataFrame([(*r, 9) for r in docs], "doc_id long, text string, covered int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "too short")], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in op5_templates(docs, bench).collect()}
    assert set(out) == {(1, 7), (5, 7)} and out[5, 7].exact_slots == out[5, 7].n_slots > out[1, 7].exact_slots
    assert sorted(str(r.doc_id) for r in decontaminated(docs, bench).collect()) == ["2", "3", "4", "None"]
    assert op5_templates(docs.limit(0), bench).count() == 0 and op5_templates(docs, bench.limit(0)).count() == 0


def test_inconsistent_slots_are_no_leak(spark):
    item = "give Anna 3 coins then Anna gives 3 coins back so Anna has as many coins as before"
    bad = "give Paul 3 coins then Mary gives 8 coins back so Jane has as many coins as before"
    docs = spark.createDataFrame([(1, "We " + bad), (2, "We " + item.replace("Anna", "Lena"))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "We " + item)], "item_id long, text string")
    assert [r.doc_id for r in op5_templates(docs, bench).collect()] == [2]


def leaked(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs, 1)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items, 101)), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in op5_templates(docs, items).collect())


def test_names_first_dense_windows_and_punctuated_slots(spark):
    names = "Alice has 3 apples. Bob gives Alice 2."
    dense = "12 + 7 = 19, 19 + 5 = 24, 24 + 9 = 33, 33 + 8 = 41, 41 + 6 = 47"
    slots = "we sent the old box to Boston, and then he came back from Boston with a new one"
    docs = [
        "Carol has 7 apples. Dan gives Carol 5.",
        "See below: " + dense + " and so on",
        "13 + 7 = 20, 20 + 4 = 24, 24 + 8 = 32, 32 + 7 = 39, 39 + 5 = 44",
        slots.replace("Boston", "Denver"),
        "Carol has 7 apples. Dan gives Erin 5.",
    ]
    assert leaked(spark, docs, [names, dense, slots]) == [(1, 101), (2, 102), (3, 102), (4, 103)]


def test_names_numbers_and_copies(spark):
    items = [
        "Alice has 5 apples and buys 3 more.", "Does 3 + 5 = 8 or 9 ?", "3 7 12 19 28 41 53 66 70 88",
        "Mary Ann sold 40 tickets to her aunt and then two hundred tickets at school",
    ]
    docs = [
        "Bob has 7 apples and buys 4 more.", "We ask: Does 3 + 5 = 8 or 9 ?", "Row 3 7 12 19 28 41 53 66 70 88 end", "Row 3 7 12 19 28 41 53 66 70 89 end",
        "Alice sold twelve tickets to her aunt and then 95 tickets at school", "near Boston Alice has 5 apples and buys 3 more.", *items,
    ]
    want = [(1, 101), (2, 102), (3, 103), (4, 103), (5, 104), (6, 101), (7, 101), (8, 102), (9, 103), (10, 104)]
    assert leaked(spark, docs, items) == want


def test_a_repeated_stretch_counts_once(spark):
    item = " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(30))
    first = " ".join(item.split()[:8])
    twice = f"{first} other words stand here {first} and {first} at the end"
    half = f"{first} other words stand here " + " ".join(item.split()[12:20])
    assert leaked(spark, [twice, half], [item]) == [(2, 101)]
