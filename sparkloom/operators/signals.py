"""Signals and alerts: spikes of words and entities, new pairs, ranked and summarised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = (
    "reuters bbc news cnn associated press afp commentary opinion analysis report update breaking developing live "
    "video photos gallery subscribe newsletter click readmore privacy policy terms cookies copyright"
).split()
STRIP = ".,!?\"'():;[]{}"
SEVERITY = {"high": 0, "medium": 1, "low": 2}


def words(c: Column) -> Column:
    """Lower-case words without surrounding punctuation."""
    return F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(STRIP)))


def is_noise(w: Column) -> Column:
    return (F.length(w) <= 3) | w.rlike("^[0-9]+$") | w.isin(STOP_WORDS) | w.startswith("http") | w.startswith("www")


def _recent(df: DataFrame, hours: int) -> DataFrame:
    """df with __recent: whether ts lies within hours of the latest ts."""
    last = df.agg(F.max("ts").alias("__last"))
    return df.crossJoin(F.broadcast(last)).withColumn("__recent", F.unix_micros("ts") >= F.unix_micros("__last") - hours * 3_600_000_000).drop("__last")  # one row


def keyword_spikes(articles: DataFrame, hours: int = 48, top: int = 100, min_count: int = 5, min_burst: float = 5.0, min_rows: int = 20, min_recent: int = 5) -> DataFrame:
    """Words of the last hours whose frequency leaps over that of all earlier articles."""
    d = _recent(articles.where(F.col("ts").isNotNull()), hours)
    sizes = d.agg(F.count("*").alias("rows"), F.count_if("__recent").alias("recent_rows"))
    w = d.select("__recent", F.explode(words(F.col("text"))).alias("keyword")).where(~is_noise(F.col("keyword")))
    c = w.groupBy("keyword").agg(F.count_if("__recent").alias("n"), F.count_if(~F.col("__recent")).alias("old"))
    older = c.agg(F.greatest(F.sum("old"), F.lit(1)).alias("total_old"))
    lead = c.where("n > 0").orderBy(F.desc("n"), "keyword").limit(top)
    burst = (F.col("n") / F.greatest("recent_rows", F.lit(1))) / F.greatest(F.col("old") / F.col("total_old"), F.lit(0.0001))
    j = lead.crossJoin(F.broadcast(older)).crossJoin(F.broadcast(sizes)).where((F.col("rows") >= min_rows) & (F.col("recent_rows") >= min_recent))  # one row each
    return j.withColumn("b", burst).where((F.col("b") > min_burst) & (F.col("n") >= min_count)).select(F.lit("cross_domain_spillover").alias("type"), "keyword", F.round("b", 1).alias("burst_factor"), F.col("n").alias("recent_count"), F.round(F.col("n") * F.col("b"), 1).alias("score"))


def entity_spikes(mentions: DataFrame, hours: int = 48, min_count: int = 2, min_burst: float = 3.0) -> DataFrame:
    d = _recent(mentions.where(F.col("ts").isNotNull()), hours)
    docs = d.agg(F.countDistinct(F.when(F.col("__recent"), F.col("doc_id"))).alias("recent_rows"))
    c = d.groupBy("entity").agg(F.count_if("__recent").alias("n"), F.count_if(~F.col("__recent")).alias("old"))
    older = c.agg(F.greatest(F.sum("old"), F.lit(1)).alias("total_old"))
    j = c.where(F.col("n") >= min_count).crossJoin(F.broadcast(older)).crossJoin(F.broadcast(docs))  # one row each
    burst = F.col("n") / F.greatest(F.col("old") / F.col("total_old") * F.col("recent_rows"), F.lit(0.001))
    return j.withColumn("b", burst).where(F.col("b") > min_burst).select(F.lit("anomaly").alias("type"), "entity", F.round("b", 1).alias("burst_factor"), F.col("n").alias("recent_count"), F.round(F.col("n") * F.col("b"), 1).alias("score"))


def new_pair_signals(pairs: DataFrame, previous: DataFrame, top: int = 20) -> DataFrame:
    """Pairs that the previous links lack, by their first document."""
    first = pairs.groupBy("e1", "e2").agg(F.min("doc_id").alias("first_doc"))
    new = first.join(previous.select(F.col("source_entity").alias("e1"), F.col("target_entity").alias("e2")), ["e1", "e2"], "left_anti")
    return new.orderBy("first_doc", "e1", "e2").limit(top).select(F.lit("emerging_relationship").alias("type"), F.col("e1").alias("entity_a"), F.col("e2").alias("entity_b"), "first_doc", F.lit(0.7).alias("score"), F.lit(0.5).alias("confidence"))


def rank_signals(*parts: DataFrame, top: int = 20) -> DataFrame:
    """All detectors' signals, one per text, by score; columns that a detector lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    r = F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("score"), "type"))
    return out.withColumn("__r", r).where("__r = 1").drop("__r").orderBy(F.desc("score"), "signal").limit(top)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """(dimension, value, n): counts by each key in one pass over grouping sets."""
    g = df.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(F.count("*").alias("n"), F.grouping_id().alias("__g"))
    k = len(keys)
    name = F.coalesce(*(F.when(F.col("__g") == (2**k - 1) - 2 ** (k - 1 - i), F.lit(x)) for i, x in enumerate(keys)))
    return g.select(name.alias("dimension"), F.coalesce(*(F.col(x).cast("string") for x in keys)).alias("value"), "n")


def relationship_alerts(links: DataFrame, previous: DataFrame) -> DataFrame:
    new = links.join(previous.select("source_entity", "target_entity"), ["source_entity", "target_entity"], "left_anti")
    title = F.concat_ws(" <-> ", "source_entity", "target_entity")
    row = lambda kind, severity: [F.lit(kind).alias("type"), F.lit(severity).alias("severity"), title.alias("title"), F.col("confidence").cast("double").alias("value")]
    high = new.where("confidence >= 0.8").select(*row("high_confidence_relationship", "high"))
    if "verified" not in links.columns:
        return high
    return high.unionByName(new.where("confidence >= 0.7 AND verified").select(*row("verified_relationship", "medium")))


def velocity_alerts(v: DataFrame, acceleration: float = 3.0, velocity: float = 2.0) -> DataFrame:
    hit = v.where((F.abs("acceleration") > acceleration) & (F.abs("velocity") > velocity))
    return hit.select(F.lit("velocity_spike").alias("type"), F.lit("high").alias("severity"), F.col("entity").alias("title"), F.col("acceleration").alias("value"))


def burst_alerts(b: DataFrame, threshold: float = 3.0) -> DataFrame:
    return b.where(F.col("burst_factor") >= threshold).select(F.lit("citation_burst").alias("type"), F.lit("high").alias("severity"), F.concat_ws(" ", "entity", F.col("day").cast("string")).alias("title"), F.col("burst_factor").alias("value"))


def phase_alerts(t: DataFrame, threshold: float = 0.7) -> DataFrame:
    return t.where(F.col("confidence") >= threshold).select(F.lit("phase_transition").alias("type"), F.lit("medium").alias("severity"), F.format_string("%s: %s -> %s", "entity", "current_phase", "predicted_phase").alias("title"), F.col("confidence").alias("value"))


def all_alerts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("severity")), F.lit(9))
    return out.orderBy(rank, "type", "title")
