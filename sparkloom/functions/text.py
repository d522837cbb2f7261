"""Scalar text functions as Columns; register() offers them to SQL as well."""

from __future__ import annotations

import html
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkloom.sources.scratch import side, stored

# Boilerplate patterns, title stop words, sensational words.
BOILERPLATE = [
    r"click here to subscribe", r"subscribe to our newsletter", r"sign up for our newsletter", r"read more", r"related stories",
    r"related articles", r"also read", r"also watch", r"trending now", r"top stories", r"more from", r"follow us on",
    r"share this article", r"comments are closed", r"this article was originally published", r"© \d{4}", r"all rights reserved",
    r"terms of service", r"privacy policy", r"cookie policy", r"advertise with us", r"contact us", r"about us",
    r"your email address", r"email address", r"photo credit", r"image credit", r"source:", r"via:", r"courtesy:",
    r"reuters\s*$", r"associated press\s*$", r"^(i|we)\s+have\s+updated\s+this\s+article",
    r"^(this|the)\s+(story|article|report)\s+(has been|was)", r"^editor'?s?\s+(note|pick)", r"^disclaimer",
]
TITLE_STOP_WORDS = "the a an in of to for on at by with from is are was were".split()
SENSATIONAL = (
    "shocking stunning explosive massive terrifying heartbreaking devastating unbelievable dramatic furious outrage slams "
    "blasts war crisis disaster tragedy horror nightmare chaos panic emergency deadly fatal brutal violent "
    "attack killer destroy collapse plunge crash surge spike epidemic scandal controversy feud rivalry "
    "battle fight clash rift split turmoil upheaval crackdown purge ban oust dump axed fired sacked"
).split()
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}]+"


@F.pandas_udf(StringType())
def unescaped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references decoded and NFKC applied; neither has a built-in function."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(unescaped(F.coalesce(c, F.lit(""))), EMOJI, ""), r"https?://\S+|www\.\S+", ""))


def category(title: Column) -> Column:
    """struct<category, rest>: a short word prefix that a capital or a digit follows."""
    found = F.trim(F.regexp_extract(title, r"^([A-Za-z\s&]+?)(?=[A-Z]|\d)", 1))
    rest = F.trim(F.substr(title, F.length(found) + 1))
    ok = (F.regexp_extract(title, r"^([A-Za-z\s&]+?)(?=[A-Z]|\d)", 1) != "") & (rest != "")
    return F.struct(F.when(ok, found).alias("category"), F.when(ok, rest).otherwise(F.coalesce(title, F.lit(""))).alias("rest"))


def compose(title: Column, description: Column) -> Column:
    return F.concat(title, F.lit(". "), description)


def remove_boilerplate(c: Column, patterns: list[str] = BOILERPLATE, min_chars: int = 15) -> Column:
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x))
    bad = "|".join(f"(?:{p})" for p in patterns)
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= min_chars) & ~F.lower(x).rlike(bad)), " ")


def headline(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    for mark in (r"\|", "-", "–", ":", "«"):
        t = F.regexp_replace(t, rf"\s*{mark}.*$", "")
    return F.trim(t)


def canonical_url(c: Column) -> Column:
    """Lower case, no tracking parameters, no www; the question mark stays where parameters do."""
    u = F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "/+$", ""))
    u = F.regexp_replace(u, r"([?&])(?:(?:utm_[a-z]+|fbclid|ref|source|_[^=&]+)=[^&#]*|amp(?:=[^&#]*)?(?=&|$))(?=&|$)", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"&{2,}", "&"), r"\?&+", "?")
    return F.regexp_replace(F.regexp_replace(u, r"^https?://www\.", "https://"), r"[?&]+$", "")


def normal_title(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s]", "")
    return squeeze(F.regexp_replace(squeeze(t), rf"(?U)\b({'|'.join(TITLE_STOP_WORDS)})\b", ""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), r"(?U)\s+"), lambda w: w != "")


def fuzzy_hash(c: Column) -> Column:
    """MD5 of the sorted distinct words; empty for blank texts."""
    t = F.coalesce(c, F.lit(""))
    return F.when(F.trim(t) == "", "").otherwise(F.md5(F.array_join(F.array_sort(F.array_distinct(tokens(t))), " ").cast("binary")))


def content_hash(c: Column) -> Column:
    return F.md5(F.coalesce(c, F.lit("")).cast("binary"))


def shingles(c: Column, k: int = 5) -> Column:
    """Distinct character k-grams; none for shorter texts.  The text is split into characters once."""
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    grams = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - k + 1), lambda i: F.array_join(F.slice(x, i, F.lit(k)), ""))
    return F.when(F.char_length(c) >= k, F.array_distinct(F.transform(F.array(chars), grams)[0])).otherwise(F.array().cast("array<string>"))


def sensationalism(c: Column, words: list[str] = SENSATIONAL) -> Column:
    own = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), 1))
    return F.when(F.size(own) > 0, F.round(F.size(F.array_intersect(own, F.array(*(F.lit(w) for w in words)))) / F.size(own), 4)).otherwise(0.0)


def sentiment_label(compound: Column) -> Column:
    return F.when(compound >= 0.35, "positive").when(compound <= -0.35, "negative").otherwise("neutral")


def subjectivity(compound: Column, neutral: Column) -> Column:
    return F.abs(compound) * (1 - neutral)


def sentiment(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, neg, neu, compound from a word table lexicon(word, weight): shares of words, and
    the sum of weights squashed to (-1, 1).  Words without an entry are neutral."""
    words = docs.select(key, F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    s = words.join(side(lexicon), "word", "left").groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("weight") > 0).alias("p"), F.count_if(F.col("weight") < 0).alias("m"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    out = docs.select(key).join(s.hint("shuffle_merge"), key, "left")
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    p, m, w = (F.coalesce(c, F.lit(0)) for c in ("p", "m", "w"))
    return out.select(key, F.round(p / n, 4).alias("pos"), F.round(m / n, 4).alias("neg"), F.round(1 - (p + m) / n, 4).alias("neu"), F.round(w / F.sqrt(w * w + 15.0), 4).alias("compound"))


def entity_arrays(c: Column) -> Column:
    """The three entity lists of a JSON text: blanks dropped, malformed texts empty."""
    raw = F.from_json(c, "persons array<string>, orgs array<string>, locations array<string>", {"mode": "PERMISSIVE"})
    tidy = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(*(tidy(raw[k]).alias(k) for k in ("persons", "orgs", "locations")))


def names_in(c: Column, skip: list[str], limit: int | None = None, chars: int | None = None) -> Column:
    """Names of two to four capitalised words, without those that begin with a word to skip: all of
    the whole text, or the first limit of its first chars characters."""
    found = F.regexp_extract_all(F.substring(c, 1, chars) if chars else c, F.lit(r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+){1,3})\b"), 1)
    good = F.filter(found, lambda x: (F.length(x) > 4) & ~F.substring_index(x, " ", 1).isin(skip))
    return F.slice(F.array_distinct(good), 1, limit) if limit else F.array_distinct(good)


#: Entries of a dictionary that each text is searched for one by one; more are compiled into automata.
MAX_SEARCHED = 2_000
#: Characters of the names that one automaton holds, at most: some 100 MB in each task.
AUTOMATON_CHARS = 4_000_000


def containing(rows: DataFrame, text: str, entries: DataFrame, name: str, most: int = MAX_SEARCHED, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """rows joined with the entries whose name their text contains; null and empty names are in no text.

    Up to most entries go to every executor and are searched for in each text.  Beyond that the
    names are compiled into automata that find all of them in one pass over a text; a
    dictionary of more than chars characters makes several, one pass each, so that each task's
    memory is bounded whatever the dictionary.
    """
    entries = entries.where(F.length(name) > 0)
    if entries.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(entries), F.contains(text, name))
    names = stored(entries.select(F.col(name).alias("__name")).distinct(), "names")
    parts = -(-(names.agg(F.sum(F.length("__name"))).first()[0] or 0) // chars)
    found = [rows.withColumn("__name", F.explode(names_found(F.col(text), names.where(F.pmod(F.xxhash64("__name"), F.lit(parts)) == i)))) for i in range(parts)]
    return reduce(DataFrame.unionByName, found).join(entries.withColumn("__name", F.col(name)).hint("shuffle_merge"), "__name").drop("__name")


def names_found(text: Column, names: DataFrame) -> Column:
    """array<string>: which of names(__name), a table of bounded size, the text contains."""
    shared = names.sparkSession.sparkContext.broadcast([r[0] for r in names.collect()])

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for x in shared.value:
            automaton.add_word(x, x)
        automaton.make_automaton()
        for texts in batches:
            yield texts.map(lambda t: list({x for _, x in automaton.iter(t)}) if t else [])

    return found(text)


def gazetteer(docs: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text", limit: int | None = None, chars: int | None = None) -> DataFrame:
    """key, etype, name for entries(name, etype) contained in the text: all of the whole text, or
    the first limit of a type in its first chars characters."""
    low = F.lower(F.substring(text, 1, chars) if chars else F.col(text))
    hit = containing(docs.select(key, low.alias("__t")), "__t", entries.withColumn("__n", F.lower("name")), "__n").select(key, "etype", "name").distinct()
    if limit is None:
        return hit
    rank = F.row_number().over(Window.partitionBy(key, "etype").orderBy("name"))
    return hit.withColumn("r", rank).where(F.col("r") <= limit).drop("r")


def mentions_of(articles: DataFrame, entities: str = "entities", min_length: int = 1) -> DataFrame:
    """One row per mention: names in lower case, persons before organisations before locations."""
    part = lambda k, rank: F.transform(F.col(f"{entities}.{k}"), lambda x: F.struct(F.lower(F.trim(x)).alias("entity"), F.lit(k).alias("etype"), F.lit(rank).alias("rank")))
    rows = articles.select("doc_id", "source", "ts", F.posexplode(F.concat(part("persons", 0), part("orgs", 1), part("locations", 2))).alias("ord", "m"))
    return rows.select("doc_id", F.col("m.entity").alias("entity"), F.col("m.etype").alias("etype"), "source", "ts", F.col("ord").cast("long").alias("ord")).where(F.length("entity") > min_length)


def parse_time(c: Column) -> Column:
    return c.try_cast("timestamp")


def pick_time_column(df: DataFrame, names: tuple[str, ...] = ("published", "scraped_at", "analyzed_at"), share: float = 0.3) -> str | None:
    """The first of names with more than share of its values parseable: one aggregate row."""
    there = [c for c in names if c in df.columns]
    if not there:
        return None
    row = df.agg(*(F.avg(parse_time(F.col(c)).isNotNull().cast("double")).alias(c) for c in there)).first()
    return next((c for c in there if (row[c] or 0) > share), None)


def best_sentences(words: Column, keep: int) -> Column:
    """array<int>: the places of the keep sentences with the highest mean word frequency, in order; words has
    a line for each sentence, with a blank between words.  Ties go to the first; sentences without words come last."""

    @F.pandas_udf("array<int>")
    def best(texts: pd.Series) -> pd.Series:
        def places(text: str) -> list[int]:
            lines = [[w for w in line.split(" ") if len(w) > 2] for line in text.split("\n")]
            n = Counter(chain.from_iterable(lines))
            score = [-sum(map(n.__getitem__, ws)) / len(ws) if ws else 0.0 for ws in lines]
            return sorted(sorted(range(len(lines)), key=score.__getitem__)[:keep])

        return texts.map(places)

    return best(words)


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: int = 3) -> DataFrame:
    """key, summary: the sentences with the highest mean word frequency, in their own order.

    Each text is judged where it is read: nothing is shuffled, and rows with equal or null keys stand for themselves.
    """
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    s = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("whole"), parts.alias("parts"))
    long_ = (F.size("parts") > keep) & (F.length("whole") >= 50)
    words = F.transform("parts", lambda x: F.array_join(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)(\p{Alpha}+)"), 1), " "))
    s = s.withColumn("best", best_sentences(F.when(long_, F.array_join(words, "\n")).otherwise(""), keep))
    chosen = F.array_join(F.transform("best", lambda i: F.col("parts")[i]), " ")
    return s.select(key, F.when(long_, chosen).otherwise(F.col("whole")).alias("summary"))


def register(spark: SparkSession) -> None:
    """SQL functions for the one expression without a built-in; the rest are SQL already."""
    spark.udf.register("unescaped", unescaped)
