"""Deduplication: exact, by word set, by shingle similarity and by TF-IDF cosine; keep-first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sparkloom.functions import grams
from sparkloom.functions.text import fuzzy_hash
from sparkloom.sources.scratch import side, stored


#: Groups of a partition in which sets meet, at most: some 50 MB.
GROUPS = 8

#: Vectors of a block, or about so many, and terms that are multiplied at once: 16 MB for two blocks.
BLOCK = 1_000
COLUMNS = 1_000


def keep_first(df: DataFrame, key: Column, order: str = "doc_id") -> DataFrame:
    """The row of least order of each key: rows are aggregated where they are before they are shuffled."""
    first = F.min_by(F.struct(*df.columns), F.struct(order)).alias("__row")
    return df.groupBy(key.alias("__key")).agg(first).select("__row.*")


def dedup_exact(df: DataFrame, column: str = "title", order: str = "doc_id") -> DataFrame:
    return keep_first(df, F.col(column), order)


def dedup_fuzzy(df: DataFrame, column: str = "title", order: str = "doc_id") -> DataFrame:
    return keep_first(df, fuzzy_hash(F.col(column)), order)


def similar_pairs(df: DataFrame, column: str = "title", threshold: float = 0.85, k: int = 5, order: str = "doc_id") -> DataFrame:
    """(a, b, similarity), a < b: all pairs of distinct character k-gram sets with that Jaccard similarity, exactly.

    Equal sets are compared once, through their first row; sets without a k-gram take no part.
    Only texts are stored and shuffled; their sets are made anew where they are needed, as 64-bit hashes.
    """
    t = df.select(F.col(order).alias("id"), F.lower(F.col(column)).alias("t"))
    t = t.withColumn("key", grams.set_key(k)("t")).where("key IS NOT NULL")
    t = stored(t.groupBy("key").agg(F.min(F.struct("id", "t")).alias("x")).select("x.*"), "sets")
    pairs = candidate_pairs(t.select("id", grams.hashed_set(k)("t").alias("s")), threshold)
    both = pairs.join(t.select(F.col("id").alias("a"), F.col("t").alias("ta")).hint("shuffle_merge"), "a").join(t.select(F.col("id").alias("b"), F.col("t").alias("tb")).hint("shuffle_merge"), "b")
    return both.select("a", "b", grams.jaccard(k)("ta", "tb").alias("similarity")).where(F.col("similarity") >= threshold)


def set_copies(df: DataFrame, column: str = "title", k: int = 5, order: str = "doc_id") -> DataFrame:
    """(first, id): each further row of an equal character k-gram set with the set's first row; sets without a k-gram take no part."""
    keyed = stored(df.select(F.col(order).alias("id"), grams.set_key(k)(F.lower(F.col(column))).alias("key")).where("key IS NOT NULL"), "set-keys")
    firsts = stored(keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "set-firsts")
    # A join, which skew handling can deal anew where a class is large, and not a window.
    return keyed.join(firsts.hint("shuffle_merge"), "key").where(F.col("id") > F.col("first")).select("first", "id")


def candidate_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """sets(id, s: array<long>) -> (a, b), a < b: pairs that may reach the Jaccard threshold; none is lost.

    Prefix filtering: a set's elements stand from the rarest to the commonest.  Two sets of n <= m
    elements that reach threshold t share at least t / (1 + t) * (n + m).  As m >= n that is
    2t / (1 + t) * n at least, and as n >= t * m it is t * m: so the first element that they share
    stands among the first n - 2t / (1 + t) * n + 1 of the smaller set and the first m - t * m + 1
    of the larger one.  What is left behind that element must be enough, too.  Elements that
    most sets have stand last, so sets meet on them only if they are similar.

    Sets that meet on an element are compared there by their sketches, which bound from below in how many
    elements they differ, so hardly more than the similar pairs leave a task.  Sets too large for sketches
    have prefixes longer by `longer` elements, and as many must be met there (all that are needed, if these
    are fewer): the first `longer` + 1 shared elements stand in them as the first does in the shorter ones.

    Any one order of all elements will do; here it is by the counts of grams.BUCKETS buckets of
    elements, then by element.  So sets are ordered where they are, and only prefixes are shuffled.
    """
    slack = 1e-9
    rows, groups = grams.dealt(stored(grams.prefixes(sets, threshold, slack), "set-prefixes"))
    parts = min(groups, max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // GROUPS + 1))
    out = StructType([StructField("a", sets.schema["id"].dataType), StructField("b", sets.schema["id"].dataType), StructField("enough", IntegerType())])
    met = rows.repartition(parts, "g").groupBy("g").applyInArrow(grams.meet(threshold, slack), out)
    found = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("met"), F.first("enough").alias("enough"))
    return stored(found.where("met >= enough").select("a", "b"), "set-pairs")


def greedy_drops(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Ids dropped by keep-first: an id goes if a kept smaller one is similar to it.

    In rounds: ids whose smaller neighbours are all decided and none of them kept are kept, and
    their larger neighbours go; undecided edges shrink every round.
    """
    open_ = stored(edges.select("a", "b").where("a < b").distinct(), "greedy")
    dropped = None
    for _ in range(rounds):
        if open_.isEmpty():
            break
        keep = open_.select(F.col("a").alias("x")).distinct().join(open_.select(F.col("b").alias("x")), "x", "left_anti")
        out = stored(open_.join(keep.withColumnRenamed("x", "a"), "a", "left_semi").select(F.col("b").alias("x")).distinct(), "greedy-out")
        dropped = out if dropped is None else dropped.unionByName(out)
        keep = stored(keep, "greedy-keep")
        gone = out.unionByName(keep)
        open_ = stored(open_.join(gone.withColumnRenamed("x", "a"), "a", "left_anti").join(out.withColumnRenamed("x", "b"), "b", "left_anti"), "greedy")
    else:
        raise RuntimeError(f"keep-first did not settle in {rounds} rounds")
    return dropped if dropped is not None else edges.select(F.col("b").alias("x")).limit(0)


def dedup_similar(df: DataFrame, column: str = "title", threshold: float = 0.85, order: str = "doc_id", edges: DataFrame | None = None) -> DataFrame:
    """Rows that keep-first leaves; rows with equal k-gram sets count as similar."""
    e = edges if edges is not None else similar_pairs(df, column, threshold, order=order)
    tagged = df.withColumn("__s", grams.set_key(5)(F.lower(F.col(column))))
    one = keep_first(tagged.where("__s IS NOT NULL"), F.col("__s"), order).unionByName(tagged.where("__s IS NULL")).drop("__s")
    return one.join(greedy_drops(e).withColumnRenamed("x", order), order, "left_anti").select(*df.columns)


def duplicate_groups(edges: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(root, member): each dropped row with the smallest kept row similar to it.

    copies(first, id): rows that equal a first row, which edges leave out.  A copy goes where its first row
    goes, or to it: no kept row can be similar to a kept one.
    """
    gone = stored(greedy_drops(edges).withColumnRenamed("x", "member"), "groups")
    e = edges.select(F.col("a").alias("root"), F.col("b").alias("member")).join(gone, "member", "left_semi")
    kept = e.join(gone.withColumnRenamed("member", "root"), "root", "left_anti")
    groups = kept.groupBy("member").agg(F.min("root").alias("root")).select("root", "member")
    if copies is None:
        return groups
    groups = stored(groups, "groups-of-firsts")
    of_copies = copies.join(groups.withColumnRenamed("member", "first").hint("shuffle_merge"), "first", "left")
    return groups.unionByName(of_copies.select(F.coalesce("root", "first").alias("root"), F.col("id").alias("member")))


def tfidf(df: DataFrame, column: str = "text", key: str = "doc_id", features: int | None = 5000, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, w): L2-normalised sublinear TF-IDF over 1- and 2-grams of words of two characters up."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"(?U)\b(\w\w+)\b"), 1), lambda w: ~w.isin(*stop_words) if stop_words else F.lit(True))
    d = df.select(F.col(key).alias("id"), words.alias("w"))
    n = F.size("w")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    tf = d.select("id", F.explode(F.concat("w", pairs)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    tf = stored(tf, "tf")
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    if features:
        df_ = df_.orderBy(F.desc("cf"), "term").limit(features)  # the vocabulary's size is the feature
    total = df.agg(F.count("*").alias("n"))
    idf = stored(df_.crossJoin(total).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    w = tf.join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def near_here(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Rows (id, block, i, j, terms, ws) of the blocks i and j -> a, b, similarity: the near pairs of a vector of i and one of j.

    Products of matrices, a run of COLUMNS terms at a time: memory is bounded whatever the vectors hold.
    """

    def multiply(rows: pa.Table) -> pa.Table:
        ids, block = rows.column("id").combine_chunks(), rows.column("block").to_numpy()
        terms, ws = rows.column("terms").combine_chunks(), rows.column("ws").combine_chunks()
        code, w = terms.flatten().to_numpy(), ws.flatten().to_numpy()
        row = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
        term = np.unique(code, return_inverse=True)[1]
        order = np.argsort(term, kind="stable")
        term, row, w = term[order], row[order], w[order]
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        mine, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
        total = np.zeros((len(mine), len(other)))
        for start in range(0, int(term[-1]) + 1, COLUMNS):
            part = slice(*np.searchsorted(term, (start, start + COLUMNS)))
            m = np.zeros((len(ids), min(COLUMNS, int(term[-1]) + 1 - start)))
            m[row[part], term[part] - start] = w[part]
            total += m[mine] @ m[other].T
        a, b = np.nonzero(total >= threshold)
        similarity = total[a, b]
        a, b = mine[a], other[b]
        kept = a < b if i == j else np.ones(len(a), dtype=bool)
        return pa.table([ids.take(pa.array(a[kept])), ids.take(pa.array(b[kept])), pa.array(similarity[kept])], names=["a", "b", "similarity"])

    return multiply


def tfidf_pairs(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, similarity), a < b: the pairs of normalised vectors(id, term, w) with that cosine, exactly.

    Equal vectors (weights to nine digits) are compared once, through their first row; each further
    one is listed with that first row only, at similarity 1, so copies make rows in proportion.
    """
    near, copies = near_and_copies(vectors, threshold)
    return near.unionByName(copies)


def tfidf_drops(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Ids dropped by keep-first of vectors(id, term, w): an id goes if a kept smaller one is near to it.

    A further row of an equal vector always goes: its first row is kept, or what drops that drops it too.
    So no further row drops anything, and the pairs of first rows decide.
    """
    near, copies = near_and_copies(vectors, threshold)
    return greedy_drops(stored(near, "near")).unionByName(copies.select(F.col("b").alias("x")))


def near_and_copies(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity), a < b, twice: near pairs of the first rows of different vectors; each further row with its first.

    Prefix filtering: with terms from the rarest to the commonest, each vector is indexed by its
    terms up to where the norm of the rest falls below the threshold.  Two vectors that share
    none of these reach less than the threshold by Cauchy and Schwarz.

    The vectors that share a term of their prefixes are multiplied where they meet, in blocks of about
    BLOCK vectors, so only pairs that are near leave a task.
    """
    v = stored(vectors, "vectors")
    whole = v.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", F.round("w", 9).alias("w")))).alias("v"))
    classes = stored(whole.select("id", F.sha2(F.to_json("v"), 256).alias("v")), "vector-keys")
    firsts = stored(classes.groupBy("v").agg(F.min("id").alias("first")), "vector-classes")
    # A join, which skew handling can deal anew where a class is large, and not a window.
    copies = classes.join(firsts.hint("shuffle_merge"), "v").where(F.col("id") > F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    one = stored(v.join(firsts.select(F.col("first").alias("id")).hint("shuffle_merge"), "id", "left_semi"), "vector-firsts")
    df_ = stored(one.groupBy("term").agg(F.count("*").alias("df")).withColumn("code", F.monotonically_increasing_id()), "vector-terms")
    left = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, -1))
    coded = one.join(df_.hint("shuffle_merge"), "term")
    r = coded.withColumn("from2", F.coalesce(left, F.lit(0.0)) + F.col("w") * F.col("w"))
    # A term is in the prefix if what stands from it on can still reach the threshold; floats get some slack.
    slack = 1e-9
    r = stored(r.where((F.sqrt("from2") >= threshold - slack) & (F.col("df") > 1)).select("id", "code"), "prefixes")
    many = r.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    r = r.join(side(stored(many, "blocks")), "code").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    ways = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    lists = coded.groupBy("id").agg(F.collect_list(F.struct("code", "w")).alias("v")).select("id", F.col("v.code").alias("terms"), F.col("v.w").alias("ws"))
    r = r.select("id", "code", "block", F.explode(ways).alias("way")).select("id", "code", "block", "way.*").join(lists.hint("shuffle_merge"), "id")
    out = StructType([StructField("a", v.schema["id"].dataType), StructField("b", v.schema["id"].dataType), StructField("similarity", DoubleType())])
    near = r.groupBy("code", "i", "j").applyInArrow(near_here(threshold), out)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return near, copies


def dedup_step(df: DataFrame, column: str = "title", min_rows: int = 10) -> tuple[DataFrame, DataFrame]:
    """Exact, then similarity dedup if more than min_rows are left; and a one-row report."""
    first = stored(dedup_exact(df, column), "exact")
    out = first if first.limit(min_rows + 1).count() <= min_rows else dedup_similar(first, column)
    report = df.agg(F.count("*").alias("n_before")).crossJoin(first.agg(F.count("*").alias("n_exact"))).crossJoin(out.agg(F.count("*").alias("n_after")))
    return out, report
