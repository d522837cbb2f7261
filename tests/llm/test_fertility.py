import random
import re
from collections import Counter

from sparkloom.llm.common import read
from sparkloom.llm.fertility import fertility, main_script, op1_fertility

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, script string, n_words long"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed)


def rows_of(df):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.orderBy("doc_id").collect()]


def test_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    expected = [brute(r.text) for r in docs.orderBy("doc_id").collect()]
    assert rows_of(op1_fertility(docs)) == expected


def test_edge_cases(spark):
    texts = [None, "", " \t\n", "a b c a b c", "x\x1cy z  w", "a\n\na\n b\na ", "word " * 5000, "y" * 50000, "你好 " * 80]
    docs = spark.createDataFrame([(i, t, None, "clash", 7) for i, t in enumerate(texts)] + [(0, None, None, None, None)], SCHEMA)
    out = op1_fertility(docs).orderBy("doc_id").collect()
    assert rows_of(op1_fertility(docs)) == [brute(t) for t in [None, *texts]]
    assert not any(r.kept for r in out if r.base_failed)
    assert op1_fertility(docs.limit(0)).count() == 0


def test_clean_prose_stays_and_noise_goes(spark):
    clean = read(spark, "/root/testdata/sf0.01", "documents").join(
        read(spark, "/root/testdata/sf0.01", "labels").where("quality = 1"), "doc_id", "left_semi"
    )
    out = op1_fertility(clean).where("not base_failed")
    assert out.where("not kept").count() <= 0.005 * out.count()
    noise = spark.createDataFrame([(1, " ".join("\U0001f600꧂" + str(i) for i in range(80)), "en")], "doc_id long, text string, lang string")
    assert [r.kept for r in op1_fertility(noise).collect()] == [False]


def test_long_words_are_encoded_whole(spark):
    import base64

    import sentencepiece
    import tiktoken

    rng = random.Random(4)
    folder = "/opt/tokenizers"
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{folder}/byte_bpe_50k.tiktoken", "rb"))}
    split = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    bpe = tiktoken.Encoding("whole", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    letters = "abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/é你"
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (1999, 2001, 6002, 100_000)] + ["a" * 1_000_000]
    docs = spark.createDataFrame([(i, f"see {w} here", "en") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.f.n_tokens, r.f.n_bpe_tokens) for r in fertility(docs, out="f").collect()}
    for i, w in enumerate(words):
        line = ["see", w, "here"]
        assert got[i] == (sum(len(pieces.encode(x)) for x in line), sum(len(bpe.encode_ordinary(" " + x)) for x in line))


def test_scripts():
    texts = {"latin": "plain Łódź", "cyrillic": "привет мир", "greek": "καλημέρα", "arabic": "مرحبا", "indic": "नमस्ते", "cjk": "你好 こんにちは 안녕", "other": "שלום"}
    assert {name: main_script(t) for name, t in texts.items()} == {name: name for name in texts}
