"""The canonical tables (articles, mentions, sectors, vectors) bound to stored Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.cooccur import parts
from sparkloom.sources.scratch import looked_up


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: the first line is the title, and each id is an hour of 2024 on."""
    docs = read(spark, sf_dir, "documents")
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return docs.select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        "source",
        "lang",
        F.timestamp_seconds(F.unix_timestamp(start) + F.col("doc_id") * 3600).alias("ts"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents and their suppliers as the entities that they mention."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderdate")
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    n = parts(items.count())  # by the files' footers
    # Last by order, so that each document is in one partition.
    return (
        looked_up(items, names, "l_suppkey", n)
        .repartition(n, "l_orderkey")
        .join(orders.repartition(n, "l_orderkey").hint("shuffle_merge"), "l_orderkey")
        .select(
            F.col("l_orderkey").alias("doc_id"),
            F.col("s_name").alias("entity"),
            F.lit("orgs").alias("etype"),
            F.col("o_orderpriority").alias("source"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("l_linenumber").cast("long").alias("ord"),
        )
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).select(F.col("s_name").alias("entity"), F.col("r_name").alias("sector"))


def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a time series of mentions, one entity per user."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"))


# The same bindings for the SQL twins.
MENTIONS = """mentions AS (SELECT l_orderkey AS doc_id, s_name AS entity, 'orgs' AS etype, o_orderpriority AS source, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(l_linenumber AS BIGINT) AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""
SECTORS = """sectors AS (SELECT s_name AS entity, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EVENTS = """mentions AS (SELECT event_id AS doc_id, CAST(user_id AS VARCHAR) AS entity, event_type AS source, CAST(ts AS TIMESTAMP) AS ts FROM events)"""
ARTICLES = r"""articles AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text, source, lang, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id AS ts FROM documents)"""
