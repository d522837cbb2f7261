"""From raw documents to packed training sequences: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.

Columns beside doc_id, text, lang and n_chars are passed through whatever their names (with dots
or back-ticks, equal to an internal name, different from another in case alone); an empty
table gives an empty one; ids may be of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import plain_names, quoted, read, scratch, stored
from sparkloom.llm.disclosure import sanitised
from sparkloom.llm.fertility import fertility
from sparkloom.llm.minmax import without_near_duplicates
from sparkloom.llm.packing import packed
from sparkloom.llm.templates import decontaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go, as they have too few words; null ids stay; a null or unknown lang is
    judged by the script's band; repeated rows are judged alike, each for itself.
    """
    rows = plain_names(docs, "doc_id", "text", "lang")
    return fertility(rows).where("__fertility.kept").select(*map(quoted, rows.columns)).toDF(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), that of the least id.

    Texts without a word are no one's duplicates; rows that repeat an id are one document, and one
    of them stays; of a group whose members have no id at all, each stays that no id stands for.
    """
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null texts and null ids stay; rows that repeat an id go together; null items are ignored.
    """
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with placeholders for personal data and what discloses it; n_chars follows the text.

    Null texts stay null, and so do their n_chars; ids play no part.
    """
    out = plain_names(sanitised(docs), "text", "n_chars")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the training sequences; texts without a word get a row and no bin."""
    return packed(docs)


STAGES = [("quality", quality), ("near_dedup", dedup), ("decontaminate", decontaminate), ("pii", private), ("packing", packing)]

#: Tokenisers, min-max signatures and best-fit packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's own scratch tables go when its result is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", kept=True)
    return docs
