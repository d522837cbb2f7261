"""Language of a text by word profiles, and lookups of names in small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import containing
from sparkloom.sources.scratch import side

WORDS = r"[ \t\n\x0b\f\r]+"


def _words(text: str, chars: int | None = None):
    t = F.lower(F.substring(text, 1, chars) if chars else F.col(text))
    return F.filter(F.array_distinct(F.split(t, WORDS)), lambda w: w != "")


def word_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", keep: int = 200) -> DataFrame:
    """lang, word: the keep words that occur in most of a language's texts."""
    n = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(_words(text)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return n.withColumn("r", r).where(F.col("r") <= keep).select("lang", "word")


def detect_language(docs: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text", chars: int | None = None) -> DataFrame:
    """key, detected, hits: the language whose profile holds most of the words (of the first chars
    characters, if given); ties go to the first by name, texts without a hit are unknown."""
    w = docs.select(key, F.explode(_words(text, chars)).alias("word"))
    hits = w.join(side(profiles), "word").groupBy(key, "lang").agg(F.count("*").alias("n"))
    best = hits.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "lang")).alias("b"))
    return docs.select(key).join(best.hint("shuffle_merge"), key, "left").select(key, F.coalesce("b.lang", F.lit("unknown")).alias("detected"), F.coalesce(-F.col("b.m"), F.lit(0).cast("long")).alias("hits"))


def locate(entities: DataFrame, countries: DataFrame) -> DataFrame:
    """entity, country, lat, lon: of countries(country, rank, lat, lon) the first that the name holds."""
    names = countries.withColumn("__name", F.lower("country"))
    hit = containing(entities.withColumn("__text", F.lower("entity")), "__text", names, "__name")
    first = hit.groupBy("entity").agg(F.min(F.struct("rank", "country", "lat", "lon")).alias("b"))
    return first.select("entity", "b.country", "b.lat", "b.lon")
