"""Operator 4, near-duplicates by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so half as many permutations fill the signature.  Bands of the signature find
candidate pairs; candidates are confirmed on the full shingle sets.

The plan never lists all pairs of a bucket:
1. documents with equal shingle sets form one class (aggregated before anything is shuffled);
2. every member of a bucket is compared with one leader, the member that shares most buckets;
3. where members of one leader are still in two components, pairs are compared only if they
   share one of the rarest shingles in which they differ from the leader, and where in both
   lists it stands allows a link (rarest_first(), possible_pairs()); this loses no link.
Links lost by banding alone: (1 - s^rows)^bands for similarity s, 5 in a million at s = 0.8.

Defined results: null texts and texts without a word have an empty set and stay alone; equal
sets are one class whatever the texts' layout; rows with the same id are one document; a null
id takes the component of its class; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import named, numbered, only_ids, plain_names, quoted, stored
from sparkloom.llm.components import connected_components

BANDS, ROWS = 40, 6
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word -> 64-bit hash; emptied when it holds too many words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the whole text."""
    tokens = text.encode("utf-8").lower().split() if text else []
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    k = min(words, len(h))
    acc = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        acc = acc * MIX_A + mixed(h[i : len(h) - k + 1 + i] + np.uint64(i))
    return np.unique(mixed(acc))


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every permutation x -> x * factor, side by side."""
    low, high = np.full(len(factors), 2**64 - 1, dtype=np.uint64), np.zeros(len(factors), dtype=np.uint64)
    for i in range(0, len(shingles), 512):
        grid = shingles[i : i + 512, None] * factors[None, :]
        np.minimum(low, grid.min(axis=0), out=low)
        np.maximum(high, grid.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = mixed(sig.reshape(bands, rows))
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        acc = mixed(acc * MIX_B + grid[:, r])
    return acc


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """docs(id, text) -> id, n, lo, hi, keys: set size, 128-bit digest of the set, band keys."""
    factors = np.random.default_rng(2024).integers(0, 2**63, bands * rows // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            sizes, los, his, keys = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), words, cache)
                sizes.append(len(s))
                los.append(s.sum(dtype=np.uint64).astype(np.int64) if len(s) else None)
                his.append(np.bitwise_xor.reduce(mixed(s + MIX_B)).astype(np.int64) if len(s) else None)
                keys.append(band_keys(signature(s, factors), bands, rows).astype(np.int64) if len(s) else np.zeros(0, dtype=np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(los, pa.int64()), pa.array(his, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                schema=schema,
            )

    return docs.mapInArrow(run, "id long, n long, lo long, hi long, keys array<long>")


def shingle_table(docs: DataFrame, words: int) -> DataFrame:
    """docs(id, text) -> id, shingles."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingle_set(t.as_py(), words, cache).astype(np.int64) for t in part.column("text")]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], schema=schema)

    return docs.mapInArrow(run, "id long, shingles array<long>")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with linked, by the full sets.

    pairs and sets are stored tables, so that Spark can split the joins of a hot id.
    """
    shared = F.size(F.array_intersect("sa", "sb"))
    return with_sets(pairs, sets).select("a", "b", (100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).alias("linked"))


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with the full sets of a and b, as sa and sb."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b")


def rarest_first(group: DataFrame, sets: DataFrame) -> DataFrame:
    """group(a, b, n, component) -> one row for each shingle e in which member a and leader b
    differ and another member of b differs too, with n, component, d and rank.

    d counts all shingles in which a and b differ; rank is e's place among them, those first that
    the fewest members of b have.  Shingles of one member alone are counted, not listed: they
    come before all others.
    """
    differ = F.array_union(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    each = with_sets(group, sets).withColumn("differ", differ).select("a", "b", "n", "component", F.size("differ").alias("d"), F.explode("differ").alias("e"))
    each = stored(each, "dup-differ")
    often = stored(each.groupBy("b", "e").agg(F.count("*").alias("often")).where("often > 1"), "dup-often")
    common = stored(each.join(often.hint("shuffle_merge"), ["b", "e"]), "dup-common")
    one = Window.partitionBy("b", "a")
    rank = F.col("d") - F.count("*").over(one) + F.row_number().over(one.orderBy("often", "e"))
    return common.select("a", "b", "n", "component", "d", "e", rank.alias("rank"))


def possible_pairs(ranked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one leader that may be linked, from rarest_first().

    Two members differ where exactly one of them differs from the leader, so linked members
    share at least (d + d' - h) / 2 of their differences, h being what linked texts of their
    sizes may differ in.  If one of the two isn't linked with the leader, that is above 0:
    they meet in the first of the differences they share, which is early in the shorter list.
    """
    early = ranked.where(2 * percent * (F.col("rank") - 1) <= (100 - percent) * F.col("n"))
    x, y = early.alias("x"), ranked.alias("y")
    most = 1 + F.least(F.col("x.d") - F.col("x.rank"), F.col("y.d") - F.col("y.rank"))
    pair = x.join(
        y.hint("shuffle_merge"),
        (F.col("x.b") == F.col("y.b"))
        & (F.col("x.e") == F.col("y.e"))
        & (F.col("x.component") != F.col("y.component"))
        & ((F.col("x.d") < F.col("y.d")) | ((F.col("x.d") == F.col("y.d")) & (F.col("x.a") < F.col("y.a"))))
        & fair("x.n", "y.n", percent)
        & ((100 + percent) * (F.col("x.d") + F.col("y.d") - 2 * most) <= (100 - percent) * (F.col("x.n") + F.col("y.n"))),
    )
    return pair.select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b")).distinct()


def near_duplicate_links(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes(id, n, keys) that suffice for the components."""
    members = classes.select("id", "n", F.explode("keys").alias("key"))
    shared = stored(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "dup-keys")
    held = stored(members.join(shared.hint("shuffle_merge"), "key"), "dup-members")
    weight = stored(held.groupBy("id").agg(F.sum("size").alias("weight")), "dup-weight")
    sets = stored(shingle_table(only_ids(docs, weight.select("id"), "id"), words), "dup-sets")

    weighed = stored(held.join(weight.hint("shuffle_merge"), "id"), "dup-weighed")
    leader = weighed.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id", "n")).alias("top"))
    leader = stored(leader.select("key", F.col("top.id").alias("b"), F.col("top.n").alias("nb")), "dup-leaders")
    led = weighed.join(leader.hint("shuffle_merge"), "key").where("id <> b")
    group = stored(led.select(F.col("id").alias("a"), "b", "n", "nb").distinct(), "dup-groups")
    first = group.where(fair("n", "nb", percent)).select("a", "b")
    tried = stored(compared(first, sets, percent), "dup-compared")
    links = tried.where("linked").select("a", "b")

    # The rest: leaders whose members are still in more than one component.
    parts = stored(connected_components(links), "dup-parts")
    for end, part in (("a", "component"), ("b", "top")):
        of_end = parts.select(F.col("node").alias(end), F.col("component").alias(part))
        group = group.join(of_end.hint("shuffle_merge"), end, "left").withColumn(part, F.coalesce(part, end))
    placed = stored(group.select("a", "b", "n", "component", "top"), "dup-placed")
    split = stored(placed.where("component <> top").select("b").distinct(), "dup-split")
    open_ = stored(placed.join(split.hint("shuffle_merge"), "b").select("a", "b", "n", "component"), "dup-open")
    ranked = stored(rarest_first(open_, sets), "dup-ranked")
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = stored(possible_pairs(ranked, percent).join(done.hint("shuffle_merge"), ["a", "b"], "left_anti"), "dup-pairs")
    more = compared(second, sets, percent).where("linked").select("a", "b")
    return stored(links.unionByName(more).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "dup-links")


def fair(n: str, m: str, percent: int) -> Column:
    """Sizes that allow the similarity: the smaller is at least percent of the larger."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id and kept; ids may be of any type that has an order."""
    texts, names = numbered(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "id")
    sig = stored(signatures(texts, words, bands, rows), "dup-signatures")
    full = sig.where("n > 0")
    classes = full.groupBy("lo", "hi").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.min_by("keys", "id").alias("keys"))
    classes = stored(classes, "dup-classes")
    links = near_duplicate_links(classes.where("id is not null"), texts, words, percent)
    parts = connected_components(links).withColumnRenamed("node", "id")
    home = classes.select("id", "lo", "hi").join(parts.hint("shuffle_merge"), "id", "left")
    home = stored(home.select("lo", "hi", F.coalesce("component", "id").alias("component")), "dup-home")
    found = full.select("id", "n", "lo", "hi").join(home.hint("shuffle_merge"), ["lo", "hi"])
    alone = sig.where("n = 0").select("id", "n", F.col("id").alias("component"))
    every = found.select("id", "n", "component").unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull())
    every = named(every.select("id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept")), names, "id", "component_id")
    return every.withColumnRenamed("id", id_col)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group: the one with the smallest id."""
    rows = plain_names(docs, id_col, text_col)
    verdict = stored(near_duplicates(rows.toDF(*("id" if c == id_col else "text" if c == text_col else c for c in rows.columns)), "id", "text", words, percent), "dup-verdict")
    out = verdict.where("not kept AND id IS NOT NULL").select("id").distinct()
    rows = rows.withColumnRenamed(id_col, "id")
    rest = rows.join(stored(out, "dup-dropped").hint("shuffle_merge"), "id", "left_anti").select(*map(quoted, rows.columns))
    # Rows that repeat an id are one document; only those few are compared as whole rows.
    twice = stored(verdict.where("kept").groupBy("id").count().where("count > 1").select("id"), "dup-twice")
    if not twice.isEmpty():
        one = rest.join(twice.hint("shuffle_merge"), "id", "left_semi").dropDuplicates(["id"])
        rest = rest.join(twice.hint("shuffle_merge"), "id", "left_anti").unionByName(one, allowMissingColumns=False).select(*map(quoted, rows.columns))
    return rest.toDF(*docs.columns)


def op4_minmax(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), words=2, percent=80)
