"""Operator 11, spelling variants: words one edit apart, found by a trie's frontier as joins.

Words are spelt into two tries, one from the front and one from the back, kept as a distributed
edge table (depth, node, ch, child).  A word's unedited states are its own prefixes, so they
enter the frontier where the edit may stand: in the second half of the word in the forward trie
(the first half is then exact), in the first half in the backward one.  There a state branches
once: into the node's other letters (a replaced letter) or past its own letter (a deleted one; an
inserted letter is the other word's deleted one).  Edited states then meet the edges of their
depth by joins on (node, letter), level by level; a state that ends where a word ends is a
link.  Each edge knows the letters that follow it and how long the words below it are, so that
states that lead nowhere are not even written.

Nodes are 64-bit hashes of prefixes.  Nodes that collide only add states: links are confirmed
on the words themselves.  Words of LONG code points up, whose levels would be too many, meet by
the hashes of their one-letter deletions, one row a letter, likewise confirmed.

Defined results: null and empty texts have no words; a null id counts as empty text before the
colon; repeated rows count as often as they stand; ties in n go to the smaller word in
code-point order; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored

# Fixed values of the word rule.
LETTERS = "A-Za-zÀ-ÿ"
MIN_POINTS, MIN_COUNT, TIMES, LOSES = 7, 2, 10, 31

#: Words of this many code points up are compared by hashes of deletions.
LONG = 48
#: Different words that a counting task holds at once.
OPEN_WORDS = 300_000
MUL = 0x9E3779B97F4A7C15
ENDS = 1 << 62  # bit of a word's end in an edge's letters


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> word, n: runs of letters, some with one letter lost as the contract asks, of
    MIN_POINTS code points and MIN_COUNT occurrences up."""
    runs = re.compile(f"[{LETTERS}]{{{MIN_POINTS},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(sums: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("id"), batch.column("text")):
                # Lower-casing bytes changes A-Z alone.
                low = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                start = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
                for word, n in Counter(runs.findall(low)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % LOSES == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < MIN_POINTS:
                            continue
                    sums[word] += n
                if len(sums) > OPEN_WORDS:
                    yield rows(sums)
                    sums = Counter()
        yield rows(sums)

    counted = docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def _bit(letter: str) -> str:
    """SQL: the bit of a letter in a set of letters; letters that share a bit only prune less."""
    return f"shiftleft(1L, pmod(ascii({letter}), 62))"


def _leads(rest: str, edge: str = "") -> str:
    """SQL: whether a word below edge can end with rest."""
    return (
        f"IF({rest} = '', ({edge}follow & {ENDS}L) <> 0, ({edge}follow & {_bit(rest)}) <> 0 AND char_length({rest}) BETWEEN {edge}least AND {edge}most)"
    )


def trie_steps(words: DataFrame) -> DataFrame:
    """words(word) -> word, spelt, depth, node, ch, child: each word's steps down both tries from
    the middle of the word on.  Shorter words begin no later, so no partner's edge is missing."""
    half = F.expr("char_length(word) div 2")
    ways = F.array(
        F.struct(F.lit(0).alias("way"), F.col("word").alias("spelt"), half.alias("first")),
        F.struct(F.lit(1).alias("way"), F.reverse("word").alias("spelt"), (F.char_length("word") - half).alias("first")),
    )
    spelt = words.select("word", F.explode(ways).alias("w")).select("word", "w.*")
    steps = spelt.select("word", "way", "spelt", F.explode(F.expr("sequence(int(first), char_length(word) - 1)")).alias("depth"))
    return steps.select(
        "word", "spelt", "depth", F.expr("xxhash64(way, left(spelt, depth))").alias("node"), F.expr("substr(spelt, depth + 1, 1)").alias("ch"),
        F.expr("xxhash64(way, left(spelt, depth + 1))").alias("child"),
    )


def trie_edges(steps: DataFrame) -> DataFrame:
    """depth, node, ch, child, follow (letters after it), least and most (lengths below it)."""
    follow = F.expr(f"IF(depth + 1 = char_length(spelt), {ENDS}L, {_bit('substr(spelt, depth + 2, 1)')})")
    left = F.expr("char_length(spelt) - depth - 1")
    return steps.groupBy("depth", "node", "ch", "child").agg(F.bit_or(follow).alias("follow"), F.min(left).alias("least"), F.max(left).alias("most"))


def first_edits(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """The states right behind their edit: word, rest (letters to come), node, depth.

    Edits need a node with two letters or more; those letters are few and come as one array.
    """
    fan = edges.groupBy("node").agg(F.collect_list(F.struct("ch", "child", "follow", "least", "most")).alias("fan")).where("size(fan) > 1")
    fan = stored(fan, "trie-fans")
    at = stored(steps.select("word", "spelt", "depth", "node", "ch"), "trie-steps").join(fan.hint("shuffle_merge"), "node")
    replaced = f"transform(filter(fan, x -> x.ch > ch AND {_leads('substr(spelt, depth + 2)', 'x.')}), x -> struct(substr(spelt, depth + 2) AS rest, x.child AS node))"
    deleted = f"transform(filter(fan, x -> x.ch <> ch AND x.ch = substr(spelt, depth + 2, 1) AND {_leads('substr(spelt, depth + 3)', 'x.')}), x -> struct(substr(spelt, depth + 3) AS rest, x.child AS node))"
    return at.select("word", (F.col("depth") + 1).alias("depth"), F.explode(F.expr(f"concat({replaced}, {deleted})")).alias("s")).select("word", "s.rest", "s.node", "depth")


def frontier_links(words: DataFrame, longest: int) -> DataFrame:
    """words(word) of less than LONG code points -> word, id: candidates, id being a node hash of the
    partner's spelling in the one trie or the other."""
    # Sorted words share prefixes, so each task meets most of an edge's words itself.
    steps = trie_steps(words.repartitionByRange("word"))
    edges = stored(trie_edges(steps).repartitionByRange("depth", "node").sortWithinPartitions("depth"), "trie-edges")
    entering = stored(first_edits(steps, edges).repartitionByRange("depth", "node").sortWithinPartitions("depth"), "trie-entering")
    cut = F.expr("left(word, char_length(word) - 1)"), F.expr("left(reverse(word), char_length(word) - 1)")
    # A word without its last letter, in either spelling, ends where it stands.
    ended = words.select("word", F.explode(F.array(F.xxhash64(F.lit(0), cut[0]), F.xxhash64(F.lit(1), cut[1]))).alias("id"))
    last = entering.agg(F.max("depth")).first()[0] or 0
    before = None
    for depth in range(MIN_POINTS // 2 + 1, longest + 1):
        if depth > last and (before is None or before.isEmpty()):
            break
        now = entering.where(F.col("depth") == depth).select("word", "rest", "node")
        if before is not None:
            now = now.unionByName(before)
        ended = ended.unionByName(now.where("rest = ''").select("word", F.col("node").alias("id")))
        if depth < longest:
            step = edges.where(F.col("depth") == depth).select("node", "ch", "child", "follow", "least", "most")
            met = now.where("rest <> ''").withColumn("ch", F.expr("left(rest, 1)")).join(step.hint("shuffle_merge"), ["node", "ch"])
            met = met.select("word", F.expr("substr(rest, 2)").alias("rest"), "child", "follow", "least", "most").where(_leads("rest"))
            before = stored(met.select("word", "rest", F.col("child").alias("node")), "trie-frontier")
    return ended


def long_links(words: DataFrame) -> DataFrame:
    """words(word) of LONG code points up -> word, id: candidates, id being the partner's forward hash.

    Words that differ in one letter are equal without it, at the same place; words that differ
    by one letter more are equal where the longer one goes without it.  Sums over prefixes give
    the hashes of all of a word's deletions in time in proportion to its length.
    """
    schema = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("key", pa.int64())])
    back = np.uint64(pow(MUL, -1, 1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                points = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
                power = np.full(len(points), MUL, dtype=np.uint64)
                power[0] = 1
                power = np.cumprod(power, dtype=np.uint64)
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(points * power, dtype=np.uint64)])
                keys = np.concatenate([sums[-1:], sums[:-1] + (sums[-1] - sums[1:]) * back]).astype(np.int64)
                for i in range(0, len(keys), 10_000):
                    part = keys[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), one)), pa.array(np.arange(i - 1, i - 1 + len(part))), pa.array(part)], schema=schema)

    named = words.select(F.xxhash64(F.lit(0), "word").alias("id"), "word")
    forms = stored(named.mapInArrow(run, "id long, at long, key long"), "long-forms")
    less = forms.where("at >= 0")
    whole = forms.where("at < 0").select(F.col("id").alias("other"), "key")
    same = less.select(F.col("id").alias("other"), "at", "key")
    pairs = less.join(whole.hint("shuffle_merge"), "key").select("id", "other")
    pairs = pairs.unionByName(less.join(same.hint("shuffle_merge"), ["at", "key"]).where("id < other").select("id", "other")).distinct()
    return pairs.join(named.hint("shuffle_merge"), "id").select("word", F.col("other").alias("id"))


def near_words(words: DataFrame) -> DataFrame:
    """words(word, n) -> word, other, n, n_other: all words one edit apart, each pair both ways."""
    size = F.char_length("word")
    longest, deepest = words.agg(F.max(size), F.max(F.when(size <= LONG, size))).first()
    found = frontier_links(words.where(size <= LONG).select("word"), deepest or 0)
    if (longest or 0) >= LONG:
        found = found.unionByName(long_links(words.where(size >= LONG).select("word")))
    found = stored(found, "near-candidates")
    ids = F.array_distinct(F.array(F.xxhash64(F.lit(0), "word"), F.xxhash64(F.lit(1), F.reverse("word"))))
    names = stored(words.select(F.explode(ids).alias("id"), F.col("word").alias("other")), "near-names")
    pairs = found.join(names.hint("shuffle_merge"), "id").where(F.levenshtein("word", "other", 1) == 1)
    pairs = pairs.select(F.least("word", "other").alias("word"), F.greatest("word", "other").alias("other")).distinct()
    counted = words.select(F.col("word").alias("other"), F.col("n").alias("n_other"))
    pairs = stored(pairs.join(words.hint("shuffle_merge"), "word").join(counted.hint("shuffle_merge"), "other"), "near-pairs")
    return pairs.select("word", "other", "n", "n_other").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n_other").alias("n"), F.col("n").alias("n_other")))


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """forms(word, form) -> word, root, by pointer jumping: each round doubles the steps taken.
    A form is more frequent than its word, so there is no cycle."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(on.hint("shuffle_merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """One row per word: word, n, n_near, form and form_n (its near word of largest n, if that is
    at least times its own n) and root (the last of its forms)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = stored(word_counts(texts), "spelling-words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("m"), "other")).alias("best"))
    near = stored(near.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.m")).alias("n_other")), "spelling-near")
    known = words.join(near.hint("shuffle_merge"), "word", "left")
    taken = F.col("n_other") >= times * F.col("n")
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("other")).alias("form"), F.when(taken, F.col("n_other")).alias("form_n")), "spelling-forms")
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(ends.hint("shuffle_merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(docs: DataFrame) -> DataFrame:
    return spelling_variants(docs.select("doc_id", "text"))
