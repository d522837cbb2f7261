"""Vector top-k by an index: inverted-file cells, one-byte codes, exact re-scoring, measured recall.

Centroids are fitted on a bounded sample; every row is indexed.  Rows of one cell are cut into parts
of bounded size, so a cell that holds a third of all rows is many groups.  A query visits the
parts of its nearest cells: there it is compared with codes (each component of the unit vector
as one byte) in one matrix product, and the best of these candidates are scored exactly from the
stored vectors.  How many cells are visited is found by `probes_for`: the fewest in which a
sample of queries has the wanted share of its true neighbours.  Vectors without direction in
common (noise in many dimensions) need most cells; clustered ones need few.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.cooccur import cosine
from sparkloom.operators.search import ranked, vector_search
from sparkloom.sources.scratch import side, stored

SAMPLE_ROWS = 20_000  # rows that the centroids are fitted on, at most
PART_ROWS = 8_192  # rows of a cell that are compared in one step
BLOCK_QUERIES = 8_192  # queries that meet a part in one step
WIDER = 4  # candidates that are re-scored, as a multiple of k


@dataclass
class VectorIndex:
    """rows(cell, part, id, code) and parts(cell, part), stored; vectors as given; unit centroids."""

    vectors: DataFrame
    rows: DataFrame
    parts: DataFrame
    centroids: np.ndarray


def unit(vectors: list) -> np.ndarray:
    """Vectors as rows of length 1; without direction, of zeros."""
    grid = np.stack(vectors).astype(np.float32) if len(vectors) else np.zeros((0, 1), np.float32)
    size = np.linalg.norm(grid, axis=1, keepdims=True)
    return grid / np.where(size > 0, size, 1)


def _centroids(vectors: DataFrame, cells: int, sample_rows: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    has_length = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x) > 0
    sample = vectors.where(has_length).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    sample = stored(sample.repartition(8), "index-sample")
    if sample.isEmpty():
        return np.zeros((1, 1), np.float32)
    model = KMeans(k=max(2, cells), seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample)
    return unit(model.clusterCenters())


def _products(vectors: list, centroids: np.ndarray) -> np.ndarray:
    """Of each vector with each centroid; an index of nothing has one of another length."""
    x = unit(vectors)
    return x @ centroids.T if x.shape[1] == centroids.shape[1] else np.zeros((len(x), len(centroids)), np.float32)


def build(vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, seed: int = 42) -> VectorIndex:
    """Index of vectors(id, embedding); about the square root of the rows is the number of cells.
    Null vectors are in no result and not indexed."""
    vectors = vectors.select("id", "embedding").where("embedding IS NOT NULL")
    cells = cells or min(4096, max(2, int(vectors.count() ** 0.5)))
    centroids = _centroids(vectors, cells, sample_rows, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most 4096 vectors
    kind = dict(vectors.dtypes)["id"]

    def assign(batches):
        c = shared.value
        for batch in batches:
            if len(batch):
                cell = _products(batch["embedding"].tolist(), c).argmax(axis=1)
                codes = np.rint(unit(batch["embedding"].tolist()) * 127).astype(np.int8)
                yield pd.DataFrame({"id": batch["id"], "cell": cell, "code": [row.tobytes() for row in codes]})

    rows = stored(vectors.mapInPandas(assign, f"id {kind}, cell int, code binary"), "index-cells")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("n_parts"))  # a row for each cell
    rows = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n_parts")).cast("int")).drop("n_parts")
    rows = stored(rows, "index-rows")
    return VectorIndex(vectors, rows, stored(rows.select("cell", "part").distinct(), "index-parts"), centroids)


def _nearest_cells(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, q, cell, place: each query's nearest cells in order."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)
    kinds = dict(queries.dtypes)

    def nearest(batches):
        c = shared.value
        for batch in batches:
            if len(batch):
                near = np.argsort(-_products(batch["embedding"].tolist(), c), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": batch["query_id"], "q": batch["embedding"], "cells": near.tolist()})

    found = queries.select("query_id", "embedding").where("embedding IS NOT NULL").mapInPandas(nearest, f"query_id {kinds['query_id']}, q array<float>, cells array<int>")
    return found.select("query_id", "q", F.posexplode("cells").alias("place", "cell"))


def probes_for(index: VectorIndex, queries: DataFrame, k: int = 10, recall: float = 0.97, sample: int = 200) -> int:
    """The fewest cells in which a sample of queries has that share of its true k nearest."""
    some = stored(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "index-queries")
    true = vector_search(index.vectors, some, k).select("query_id", "id")
    of_row = true.join(index.rows.select("id", "cell").hint("shuffle_merge"), "id")
    order = stored(_nearest_cells(index, some, len(index.centroids)), "index-orders").select("query_id", "cell", "place")
    places = np.sort([r.place for r in of_row.join(order.hint("shuffle_merge"), ["query_id", "cell"]).select("place").collect()])  # k for each sampled query
    return int(places[min(len(places), int(np.ceil(recall * len(places)))) - 1]) + 1 if len(places) else 1


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, wider: int = WIDER) -> DataFrame:
    """query_id, id, score, rank as by vector_search, from the index: queries(query_id, embedding)."""
    return exact_scores(index, candidates(index, queries, k * wider, probes or probes_for(index, queries, k)), queries, k)


def candidates(index: VectorIndex, queries: DataFrame, keep: int, probes: int) -> DataFrame:
    """query_id, id: the keep best rows of each query by their codes, of the probes nearest cells."""
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    asked = stored(_nearest_cells(index, queries, probes).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "index-asked")
    asked = asked.join(index.parts.hint("shuffle_merge"), "cell").select("cell", "part", "block", "query_id", "q")
    held = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kinds = dict(queries.dtypes)["query_id"], dict(index.rows.dtypes)["id"]

    def compare(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asking):
            return pd.DataFrame({"query_id": [], "id": [], "near": []})
        grid = np.frombuffer(b"".join(rows["code"]), dtype=np.int8).reshape(len(rows), -1).astype(np.float32)
        ids, best, near = rows["id"].to_numpy(), [], []
        top = min(keep, len(rows))
        for i in range(0, len(asking), 256):
            got = unit(asking["q"].iloc[i : i + 256].tolist()) @ grid.T
            at = np.argpartition(-got, top - 1, axis=1)[:, :top]
            best.append(ids[at].ravel())
            near.append(np.take_along_axis(got, at, axis=1).ravel())
        return pd.DataFrame({"query_id": np.repeat(asking["query_id"].to_numpy(), top), "id": np.concatenate(best), "near": np.concatenate(near)})

    key = ["cell", "part", "block"]
    met = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(compare, f"query_id {kinds[0]}, id {kinds[1]}, near float")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))
    return stored(met.withColumn("place", place).where(F.col("place") <= keep).select("query_id", "id"), "index-candidates")


def exact_scores(index: VectorIndex, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of found(query_id, id) by exact cosine, scored and ranked as vector_search does."""
    q = queries.select("query_id", F.col("embedding").alias("q"))
    rows = index.vectors.join(side(found), "id").join(q.hint("shuffle_merge"), "query_id")
    scored = rows.select("query_id", "id", F.round(F.greatest(10 * cosine(F.col("embedding"), F.col("q")), F.lit(0.0)), 3).alias("score"))
    return ranked(scored, k)
