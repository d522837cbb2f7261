import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import compression
from sparkloom.llm.common import read
from sparkloom.llm.compression import Distance, chained, isotonic, op12_compression, pieces, scores, spaced, train, windows

SF = "/root/testdata/sf0.1"
MASK = (1 << 64) - 1


def slow_chain(line):
    out = []
    for word in re.findall(b"[^ ]* ", line):
        h = 0
        for i, byte in enumerate(word):
            h = (h + (byte + 1) * pow(compression.MUL, i, 1 << 64)) & MASK
            x = h ^ (h >> 32)
            out.append((x * int(compression.MIX) & MASK) >> 56)
    return bytes(out)


def test_chained_bytes_and_windows():
    text = "Straße, ÉTÉ idiot_idiots (idiotic)!  42 " + "w" * 900 + " end"
    line = spaced(text).encode()
    assert line.startswith("straße été idiot idiots idiotic 42 www".encode()) and chained(line).tobytes() == slow_chain(line)
    cut = list(windows(line, 40))
    assert b"".join(cut) == slow_chain(line)
    assert [len(w) for w in cut] == [38, 901, 4]
    assert list(windows(b"")) == [] and list(pieces(None)) == [] and list(pieces(" .,_ ")) == []
    long = "word " * 300_000
    assert b"".join(pieces(long)) == long.encode() and len(list(pieces(long))) > 2


def test_words_match_only_from_their_start():
    mark = bytes(range(64))
    words = lambda s: chained(s.encode()).tobytes()
    d = Distance(words("nastiest horrible ") + mark, b"\0" * 18 + mark)
    assert d("you nastiest and horrible thing") > 0 and d("thenastiest unhorrible") == 0 and d("") == 0 and d(None) == 0
    assert min(d("nastiest " * 3000), d("nastiest and calm words of another kind " * 600)) > 0.01


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(1)
    for n in [1, 2, 5, 40] * 5:
        x, y, w = rng.integers(0, 9, n) * 1.0, rng.integers(0, 2, n) * 1.0, rng.integers(1, 4, n) * 1.0
        at, level = isotonic(x, y, w)
        points = sorted(set(x))
        mean = lambda a, b: (y * w)[(x >= a) & (x <= b)].sum() / w[(x >= a) & (x <= b)].sum()
        want = [max(min(mean(a, b) for b in points if b >= p) for a in points if a <= p) for p in points]
        assert (np.diff(at) > 0).all() and (np.diff(level) > 0).all()
        assert np.allclose(sorted(set(np.round(want, 9))), level)
        blocks = [[p for p, v in zip(points, want) if abs(v - lv) < 1e-9] for lv in level]
        assert np.allclose(at, [(x * w)[np.isin(x, b)].sum() / w[np.isin(x, b)].sum() for b in blocks])


def test_held_out_quality(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    out = op12_compression(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert out.count() == docs.count() and {0 <= r.score <= 1 for r in rows} == {True}
    caught = sum(r.predicted and r.toxic for r in rows)
    assert caught >= 0.9 * sum(r.toxic for r in rows)
    assert caught >= 0.88 * sum(r.predicted for r in rows)
    assert all(r.predicted == (r.score >= 0.3) and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)


def test_scores_do_not_depend_on_their_batch_and_held_out_labels_are_not_read(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    once = {r.doc_id: r.score for r in op12_compression(docs, labels).collect()}
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = docs.repartition(7, "text").withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert once == {r.doc_id: r.score for r in op12_compression(moved, flipped).collect()}
    assert len(set(once.values())) > 2


def test_bounded_sample_keeps_the_classes_sizes(spark):
    texts = [(i, f"calm ordinary words number {i}" if i % 4 else "utterly vile insult here") for i in range(400)]
    docs = spark.createDataFrame(texts, "id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "id long, toxic int")
    few = train(docs, labels, rows=60)
    got = {r.id: r.score for r in scores(docs, few).collect()}
    assert all((got[i] > 0.5) == (i % 4 == 0) for i in got)
    assert few[3].min() >= 0 and few[3].max() <= 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x", 1), (1, None, 1), (2, "", 1), (3, "a " * 200_000, 1), (3, "b", 1), (4, "z" * 300_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 0), (3, 1), (4, 0), (99, 1)], "doc_id long, toxic int")
    for known in (labels, labels.where("toxic = 0"), labels.where("toxic = 1"), labels.limit(0)):
        out = op12_compression(docs, known).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert op12_compression(docs.limit(0), labels).count() == 0
    assert {r.score for r in op12_compression(docs, labels.where("toxic = 0")).collect()} == {0.0}
