"""Sources and ingest: pages and feeds to articles, merging, backfill, validation and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_SCHEMA = "source string, title string, description string, link string, image string, published string, scraped_at string, source_country string, full_text string, full_text_fetched_at string"
RESULT_COLUMNS = {
    "source_entity": "Source Entity", "target_entity": "Target Entity", "source_sector": "Source Sector", "target_sector": "Target Sector",
    "cooccurrence_count": "Co-occurrences", "source_diversity": "Source Diversity", "strength": "Strength", "confidence": "Confidence",
    "confidence_label": "Confidence Label", "explanation": "Explanation", "impact_level": "Impact",
}


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))


def page_cards(pages: DataFrame, card: str = "article", title: tuple[str, ...] = ("h1", "h2", "h3"), min_title: int = 16, min_card: int = 21, min_description: int = 11) -> DataFrame:
    """Cards of raw pages(page_id, url, html): source, title, description, link, image.

    The title is the first selector with enough text, else the card's own text; relative links
    are resolved against the page; one card per source and lower-cased title stays.
    """
    cards = F.regexp_extract_all("html", F.lit(rf"(?s)<{card}\b[^>]*>(.*?)</{card}>"), 1)
    rows = pages.select("page_id", "url", F.posexplode(cards).alias("pos", "c"))
    inner = lambda tag: strip_tags(F.regexp_extract("c", rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    long_enough = [F.when(F.length(inner(t)) >= min_title, inner(t)) for t in title]
    whole = strip_tags(F.col("c"))
    name = F.coalesce(*long_enough, F.when(F.length(whole) >= min_card, whole))
    text = inner("p")
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    href = F.regexp_extract("c", r"""<a\b[^>]*\bhref=["']?([^"' >]+)""", 1)
    link = F.when(href == "", F.col("url")).when(href.rlike("^[a-z]+://"), href).otherwise(F.concat(base, F.when(href.startswith("/"), F.lit("")).otherwise(F.lit("/")), href))
    out = rows.select("page_id", "pos", F.regexp_extract("url", r"://([^/?#]+)", 1).alias("source"), name.alias("title"), F.when((F.length(text) >= min_description) & (text != name), text).otherwise("").alias("description"), link.alias("link"), F.regexp_extract("c", r"""<img\b[^>]*\bsrc=["']?([^"' >]+)""", 1).alias("image"))
    first = F.row_number().over(Window.partitionBy("source", F.lower("title")).orderBy("page_id", "pos"))
    return out.where("title IS NOT NULL").withColumn("r", first).where("r = 1").drop("r", "pos")


def page_body(html: Column, min_chars: int = 31, keep: int = 30) -> Column:
    """The first paragraphs with enough text, joined by spaces."""
    parts = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), 1), strip_tags)
    return F.array_join(F.slice(F.filter(parts, lambda p: F.length(p) >= min_chars), 1, keep), " ")


def feed_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Articles of landed RSS documents feeds(source, country, xml): title and link are required."""
    kind = "channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string, updated: string>>>"
    rows = feeds.select("source", "country", F.explode(F.from_xml(xml, F.lit(kind))["channel"]["item"]).alias("e"))
    text = F.substring(strip_tags(F.coalesce("e.description", F.lit(""))), 1, 500)
    when = F.coalesce("e.pubDate", "e.updated", F.lit(""))
    out = rows.select("source", F.col("country").alias("source_country"), strip_tags(F.col("e.title")).alias("title"), F.trim("e.link").alias("link"), text.alias("description"), when.alias("published"), when.alias("scraped_at"))
    return out.where("title <> '' AND link <> ''")


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__r", r).where("__r = 1").drop("__r")


def feeds_by_country(feeds: DataFrame) -> DataFrame:
    return feeds.groupBy("country").agg(F.count("*").alias("n_feeds"), F.array_sort(F.collect_list("url")).alias("urls"))


def cap_per_source(df: DataFrame, n: int, order: str, source: str = "source", total: int | None = None) -> DataFrame:
    """The first n rows of each source, and at most total of all: the caps are the feature."""
    r = F.row_number().over(Window.partitionBy(source).orderBy(order))
    out = df.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")
    return out.orderBy(order).limit(total) if total else out


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=RAW_SCHEMA, header=True, multiLine=True, escape='"')


def save_raw(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def load_analyzed(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV where that is what the folder holds."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.read.csv(path, header=True, multiLine=True, escape='"')


def save_analyzed(df: DataFrame, path: str, time: str = "ts") -> None:
    df.withColumn("day", F.to_date(time)).write.mode("overwrite").partitionBy("day").parquet(path)


def validation_report(df: DataFrame, columns: tuple[str, ...] = ("title", "link"), limit: float = 0.5) -> DataFrame:
    """column, null_fraction, ok: one pass."""
    there = [c for c in columns if c in df.columns]
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in there))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.round(c, 4).alias("null_fraction")) for c in there))).alias("x")).select("x.*", (F.col("x.null_fraction") <= limit).alias("ok"))


def article_key() -> list[Column]:
    """Lower-cased title, source and link, trimmed; nulls count as empty."""
    tidy = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return [F.lower(tidy("title")).alias("k_title"), tidy("source").alias("k_source"), tidy("link").alias("k_link")]


def merge_new(stored: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New rows whose key is not stored, one per key."""
    keys = ["k_title", "k_source", "k_link"]
    fresh = first_per_key(new.select("*", *article_key()), keys, [order])
    return fresh.join(stored.select(*article_key()), keys, "left_anti").drop(*keys)


def not_yet_analyzed(raw: DataFrame, analyzed: DataFrame) -> DataFrame:
    keys = ["k_title", "k_source", "k_link"]
    return raw.select("*", *article_key()).join(analyzed.select(*article_key()).distinct(), keys, "left_anti").drop(*keys)


def backfill(df: DataFrame, details: DataFrame, key: str = "link", column: str = "full_text", min_chars: int = 100) -> DataFrame:
    """Short or missing texts replaced by the details' of the same link (the longest of several)."""
    best = details.groupBy(key).agg(F.max(F.struct(F.length(column).alias("n"), F.col(column).alias("v")))["v"].alias("__new"))
    short = F.coalesce(F.length(column), F.lit(0)) < min_chars
    return df.join(best, key, "left").withColumn(column, F.when(short, F.coalesce("__new", column)).otherwise(F.col(column))).drop("__new")


def drop_temporary(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.endswith("_tmp") and c not in keep))


def categorical_profile(df: DataFrame, share: float = 0.05, most: int = 50) -> DataFrame:
    """column, distinct_values, categorical: string columns with few values, in one pass."""
    names = [c for c, t in df.dtypes if t == "string"]
    one = df.agg(F.count("*").alias("__n"), *(F.approx_count_distinct(c).alias(c) for c in names))
    rows = one.select("__n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct_values")) for c in names))).alias("x"))
    return rows.select("x.*", ((F.col("x.distinct_values") / F.col("__n") < share) & (F.col("x.distinct_values") < most)).alias("categorical"))


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null in all floating columns."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def write_result(df: DataFrame, path: str) -> None:
    """JSON lines; Spark's commit protocol shows readers the whole result or none."""
    df.write.mode("overwrite").json(path)


def export_bundle(results: dict[str, DataFrame]) -> DataFrame:
    """(result, row): all result sets in one table of JSON rows."""
    out = None
    for name, df in results.items():
        one = df.select(F.lit(name).alias("result"), F.to_json(F.struct("*")).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


def write_bundle(results: dict[str, DataFrame], path: str) -> None:
    """Each result as JSON lines in a folder of its own; a result is replaced as a whole."""
    for name, df in results.items():
        write_result(df, f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(result, row) of the named results that write_bundle wrote."""
    return reduce(DataFrame.unionByName, (spark.read.text(f"{path}/{name}").select(F.lit(name).alias("result"), F.col("value").alias("row")) for name in names))


def export_links_csv(links: DataFrame, path: str) -> None:
    link_export(links).write.mode("overwrite").csv(path, header=True)


def link_export(links: DataFrame) -> DataFrame:
    return links.select(*(F.col(c).alias(new) for c, new in RESULT_COLUMNS.items() if c in links.columns))


def index_rows(articles: DataFrame, min_chars: int = 30) -> DataFrame:
    """id, text and metadata of the rows to index: one per link."""
    text = F.concat_ws(". ", "title", "description")
    rows = articles.withColumn("text", text).where(F.length("text") >= min_chars)
    rows = rows.withColumn("id", F.concat(F.lit("article_"), F.substring(F.md5(F.col("link").cast("binary")), 1, 12)))
    return first_per_key(rows.select("id", "text", "title", "source", "link"), ["id"], ["title", "source"])


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out
