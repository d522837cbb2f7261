import math
import unicodedata
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.llm.common import read
from sparkloom.llm.naive_bayes import ALPHA, BUCKETS, op9_language, predict, train

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def grams(text):
    """Buckets of all 1- to 3-grams, character by character."""
    sorts = [unicodedata.category(c)[0] for c in text or ""]
    if "L" not in sorts:
        return []
    line = "".join((c.lower() if len(c.lower()) == 1 else c) if s == "L" else c if s == "M" else " " for c, s in zip(text, sorts))
    line = f" {' '.join(line.split(' '))} "
    while "  " in line:
        line = line.replace("  ", " ")
    out = []
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            code = 0
            for k in range(n):
                code = (code * 0x110001 + ord(line[i + k]) + k + 1) & MASK
            out.append((code * 0x9E3779B97F4A7C15 & MASK) >> 50)
    return out


def brute(rows):
    counts, texts = {}, Counter()
    for doc, text, lang in rows:
        found = grams(text)
        if lang is not None and zlib.crc32(str(doc).encode()) % 3 != 1 and found:
            counts.setdefault(lang, Counter()).update(found)
            texts[lang] += 1
    sums = {c: sum(n.values()) + ALPHA * BUCKETS for c, n in counts.items()}

    def judge(text):
        found = Counter(grams(text))
        if not found or not counts:
            return "und", 0.0
        total = {c: math.log(texts[c] / sum(texts.values())) + sum(n * math.log((counts[c][g] + ALPHA) / sums[c]) for g, n in found.items()) for c in counts}
        best = max(sorted(total), key=total.get)
        size = sum(found.values())
        return best, 1 / sum(math.exp((t - total[best]) * 20 / size) for t in total.values())

    return [judge(text) for _, text, _ in rows]


def test_accuracy_and_brute_force(spark):
    docs = read(spark, SF, "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    out = {r.doc_id: r for r in op9_language(docs).collect()}
    right = held = 0
    for (doc, text, lang), (want, score) in zip(rows, brute(rows)):
        assert out[doc].lang_pred == want and abs(out[doc].score - score) < 1e-4
        assert out[doc].held_out == (zlib.crc32(str(doc).encode()) % 3 == 1)
        if out[doc].held_out and len(text.split()) > 5:
            held += 1
            right += want == lang
    assert right >= 0.95 * held


def test_letters_and_marks(spark):
    texts = ["½ ² ³", "Ⅷ ①", "_ - 7", "\u0301\u0308", "नमस्ते दुनिया", "q\u0308ux", "İstanbul ǅ ß", "日本語", "x", " \x1c "]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(50 + i, "der hund und die katze", "de") for i in range(6)] + [(70 + i, "नमस्ते जी", "hi") for i in range(6)]
    out = {r.doc_id: r for r in op9_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for (doc, _, _), (want, score) in zip(rows, brute(rows)):
        assert out[doc].lang_pred == want and abs(out[doc].score - score) < 1e-4
    assert {out[i].lang_pred for i in range(4)} == {"und"} and out[4].lang_pred == "hi"


def test_more_labels_than_one_matrix_holds(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}x " * 5, f"l{i:03}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    whole, parts = train(docs), train(docs, max_cells=40 * BUCKETS)
    assert [len(m[0]) for m in parts] == [40, 40, 40, 30] and len(whole) == 1
    found = {r.doc_id: r["__lang"] for r in predict(docs, parts).collect()}
    once = {r.doc_id: r["__lang"] for r in predict(docs, whole).collect()}
    assert all(found[i].lang_pred == f"l{i:03}" == once[i].lang_pred and abs(found[i].score - once[i].score) < 1e-9 for i in found)


def test_edge_cases(spark):
    rows = [(None, "der die das", "de"), (1, None, "de"), (2, "123 !!", "de"), (3, "the cat", None), (4, "the dog " * 9000, "en"), (4, "the dog", "en"), (5, "", "fr"), (6, "der hund die katze", "de")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    out = op9_language(docs).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id in (1, 2, 5)} == {1: ("und", 0.0), 2: ("und", 0.0), 5: ("und", 0.0)}
    assert op9_language(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in op9_language(docs.withColumn("lang", docs.lang.cast("string")).where("lang is null")).collect()} == {"und"}
