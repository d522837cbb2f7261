"""Search: vector top-k, BM25, reciprocal-rank fusion, re-ranking and hashed embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkloom.operators.cooccur import parts
from sparkloom.sources.scratch import looked_up, side, stored

MAX_QUERIES = 10_000

#: Characters of a word, about.
CHARS = 6

#: Vectors that a task takes at once, and scores that it holds at once (32 MB).
RUN_ROWS = 50_000
TILE = 4_000_000


def ranked(df: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return df.withColumn("rank", r.cast("long")).where(F.col("rank") <= k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, rank: the k nearest by cosine; score = 10 * (1 - distance), 0 beyond 1.

    A stated query set meets all rows, exactly: in blocks of about MAX_QUERIES queries, each sent to
    every task.  Each task keeps its own best of a query before anything is shuffled.
    `vector_index` finds nearly the same from an index.
    """
    q = queries.select("query_id", F.col("embedding").alias("q"))
    blocks = -(-q.count() // MAX_QUERIES)
    if blocks <= 1:
        return ranked(nearest_here(vectors, q, k), k)
    q = stored(q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
    best = [nearest_here(vectors, q.where(F.col("block") == b).drop("block"), k) for b in range(blocks)]
    return ranked(reduce(DataFrame.unionByName, best), k)


def nearest_here(vectors: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: of each run of RUN_ROWS vectors the k nearest of each query in q, a block of bounded size.

    Scores are products of matrices.  Rows whose rounded score may be among the best k are kept; Spark rounds and ranks.
    """
    block = q.toArrow()
    sent = q.sparkSession.sparkContext.broadcast((block.column("query_id").combine_chunks(), by_length(block.column("q").combine_chunks())))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_id, queries = sent.value
        for rows in runs(batches):
            ids, units = rows.column("id").combine_chunks(), by_length(rows.column("embedding").combine_chunks())
            order = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            step = max(1, TILE // max(1, len(ids)))
            for start in range(0, len(query_id), step):
                score = np.zeros((min(step, len(query_id) - start), len(ids)))
                for length, (qi, qv) in queries.items():
                    mine = (qi >= start) & (qi < start + step)
                    if length in units and mine.any():
                        score[np.ix_(qi[mine] - start, units[length][0])] = qv[mine] @ units[length][1].T
                score = np.where(np.isnan(score), np.inf, np.maximum(10 * score, 0.0))
                # Scores that round alike lie within 0.001.
                least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] - 0.0011 if len(ids) > k else np.full(len(score), -1.0)
                r, c = np.nonzero(score >= least[:, None])
                s = score[r, c]
                at = np.lexsort((order[c], -s, r))
                r, c, s = r[at], c[at], s[at]
                # Of one score, the first k by id.
                new = np.ones(len(s), dtype=bool)
                new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
                i = np.arange(len(s))
                kept = i - np.maximum.accumulate(np.where(new, i, 0)) < k
                r, c, s = r[kept], c[kept], s[kept]
                yield pa.RecordBatch.from_arrays([query_id.take(pa.array(r + start)), ids.take(pa.array(c)), pa.array(np.where(np.isinf(s), np.nan, s))], ["query_id", "id", "score"])

    out = StructType([q.schema["query_id"], vectors.schema["id"], StructField("score", DoubleType())])
    return vectors.select("id", "embedding").mapInArrow(nearest, out).withColumn("score", F.round("score", 3))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to RUN_ROWS rows or so."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(len(x) for x in held) >= RUN_ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if sum(len(x) for x in held):
        yield pa.Table.from_batches(held)


def by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> the rows with so many numbers and their unit vectors; rows that are null, hold a null
    or have no length are in none: their cosine is 0."""
    if len(vectors) == 0:
        return {}
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten()
    missing = np.asarray(values.is_null())
    x, ends = values.to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths)
    found = {}
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        at = (ends[rows] - n)[:, None] + np.arange(n)
        v = x[at]
        norm = np.sqrt((v * v).sum(axis=1))
        good = ~missing[at].any(axis=1) & (norm != 0)
        found[int(n)] = rows[good], v[good] / norm[good, None]
    return found


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """query_id, id, score, rank by Okapi BM25 over lower-case words; negative idf becomes
    epsilon times the mean idf.  The index is met by the queries' terms only."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    # All words of a document are counted in one task, which takes about PART_ROWS words.
    n = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    d = docs.select("id", "text").repartition(parts(n.chars // CHARS), "id").select("id", words(F.col("text")).alias("w")).select("id", F.size("w").alias("dl"), "w")
    tf = stored(d.select("id", "dl", F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), "bm25-tf")
    # Each text is split once: the index knows how many words there are in all.
    words_of_all = tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
    stats = docs.agg(F.count("*").alias("n")).crossJoin(words_of_all).select("n", (F.col("words") / F.col("n")).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    raw = stored(df.select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "bm25-idf")
    mean = raw.agg(F.avg("idf").alias("mean"))
    q = queries.select("query_id", F.explode(words(F.col("text"))).alias("term"))
    idf = raw.join(side(q.select("term").distinct()), "term", "left_semi").crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    known = stored(q.join(idf.hint("shuffle_merge"), "term"), "bm25-queries")
    # Scores are added up where a document's words are, in a partition for about PART_ROWS of all queries' documents.
    into = parts(n.docs * queries.count())
    found = tf.join(side(known.select("term").distinct()), "term", "left_semi").repartition(into, "id")
    hit = looked_up(found, known, "term", into).repartition(into, "id")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    s = hit.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return ranked(s, k)


def fuse(*ranked: DataFrame, k: int = 60, top: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, id, score, rank) lists."""
    every = ranked[0].select("query_id", "id", "score", "rank")
    for r in ranked[1:]:
        every = every.unionByName(r.select("query_id", "id", "score", "rank"))
    s = every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("rrf"), F.max("score").alias("best"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "id"))
    return s.withColumn("rank", r.cast("long")).where(F.col("rank") <= top)


def rerank(results: DataFrame, scores: DataFrame, top: int = 10) -> DataFrame:
    """results re-ordered by scores(query_id, id, pair_score) where there is one."""
    s = results.join(scores, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("pair_score", "score").alias("score"))
    return ranked(s, top)


def hybrid_search(vectors: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """queries(query_id, text, embedding): 2k vector and k keyword candidates, fused."""
    return fuse(vector_search(vectors, queries, 2 * k), bm25(docs, queries, k), top=k)


def hashed_embeddings(docs: DataFrame, dim: int = 256, text: str = "text") -> DataFrame:
    """docs with an L2-normalised hashing TF-IDF vector as array<double> embedding."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = docs.withColumn("__w", F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != ""))
    tf = HashingTF(numFeatures=dim, inputCol="__w", outputCol="__tf").transform(words)
    out = Normalizer(inputCol="__idf", outputCol="__v").transform(IDF(inputCol="__tf", outputCol="__idf").fit(tf).transform(tf))
    return out.withColumn("embedding", vector_to_array("__v")).drop("__w", "__tf", "__idf", "__v")
