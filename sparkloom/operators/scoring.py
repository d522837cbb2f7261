"""Scores of links, narratives and signals; expected impact; explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.cooccur import parts
from sparkloom.sources.scratch import looked_up, side

# Sector baselines, source reliability, phase and signal priors, impact patterns.
SECTOR_BASELINES = {"politics": 0.55, "finance": 0.60, "technology": 0.50, "energy": 0.55, "military": 0.50, "startups": 0.45, "social": 0.50, "global_events": 0.40}
SOURCE_RELIABILITY = {
    "reuters": 0.85, "ap": 0.85, "bbc": 0.80, "bloomberg": 0.80, "wsj": 0.80, "ft": 0.80, "cnn": 0.70, "nytimes": 0.75,
    "guardian": 0.70, "washington post": 0.75, "economist": 0.80, "al jazeera": 0.65, "npr": 0.75, "dw": 0.70,
}
PHASE_PRIORS = {"emerging": 0.3, "accelerating": 0.6, "growing": 0.7, "peaked": 0.8, "declining": 0.6, "fading": 0.4, "resurging": 0.5, "stable": 0.5, "dormant": 0.2}
SIGNAL_PRIORS = {"emerging_relationship": 0.3, "cross_domain_spillover": 0.5, "anomaly": 0.4, "narrative_acceleration": 0.6}
IMPACT_PATTERNS = [
    ("politics", "finance", 0.85, "short", "Market volatility"),
    ("politics", "technology", 0.75, "medium", "Regulatory shift"),
    ("politics", "energy", 0.80, "short", "Energy price adjustment"),
    ("politics", "military", 0.90, "short", "Defense posture change"),
    ("finance", "technology", 0.70, "medium", "Capital reallocation"),
    ("finance", "energy", 0.75, "short", "Commodity price shift"),
    ("technology", "energy", 0.65, "long", "Infrastructure evolution"),
    ("technology", "military", 0.80, "medium", "Capability advantage"),
    ("technology", "startups", 0.85, "short", "Innovation velocity"),
    ("finance", "startups", 0.80, "short", "Funding environment"),
    ("energy", "military", 0.75, "medium", "Strategic resource shift"),
    ("social", "politics", 0.70, "medium", "Policy agenda change"),
]
DEFAULT_EFFECT = "Cross-domain propagation"
# Why two sectors are connected ({a} and {b} are the link's ends), for pairs in either order.
WHY_CONNECTED = [
    ("politics", "finance", "Political decisions involving {a} create direct fiscal and market consequences for {b}."),
    ("politics", "technology", "Regulatory and policy actions ({a}) shape the technology landscape ({b}) through legislation and funding."),
    ("politics", "energy", "Government policy ({a}) directly impacts energy markets, extraction rights, and climate targets ({b})."),
    ("politics", "military", "Political leadership and diplomacy ({a}) drive military posture and defense strategy ({b})."),
    ("finance", "technology", "Capital markets and investment flows ({a}) fund or constrain technology development ({b})."),
    ("finance", "energy", "Energy prices ({b}) directly affect inflation, trade balances, and market stability ({a})."),
    ("technology", "energy", "Technology sector ({a}) drives energy demand, grid modernization, and renewable innovation ({b})."),
    ("technology", "military", "Technology capabilities ({a}) directly enable military advantage in cyber, AI, and autonomous systems ({b})."),
    ("energy", "military", "Energy security ({a}) is a strategic military concern; conflicts often center on energy resources ({b})."),
    ("technology", "startups", "Technology infrastructure and platforms ({a}) create the foundation for startup innovation and funding ({b})."),
    ("finance", "startups", "Investment capital and market conditions ({a}) directly determine startup viability and growth ({b})."),
    ("social", "politics", "Social movements and public opinion ({a}) drive political agenda-setting and policy change ({b})."),
]
WHY_OTHERWISE = "Entities in {s} and {t} are connected through shared dependencies. Changes in {s} create measurable effects in {t} through cross-domain propagation channels."
DEFAULT_DOWNSTREAM = ("Cross-domain propagation between {s} and {t}", "Secondary effects in connected sectors", "Potential narrative amplification across sources")


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.element_at(table, key), F.lit(default))


def label(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")


def mean_reliability(*names: str) -> Column:
    """Mean reliability of the sources that a name contains; 0.5 if none."""
    hits = F.array_compact(F.array(*(F.when(F.greatest(*(F.lower(F.coalesce(F.col(n), F.lit(""))).contains(s) for n in names)), F.lit(r)) for s, r in SOURCE_RELIABILITY.items())))
    return F.when(F.size(hits) > 0, F.aggregate(hits, F.lit(0.0), lambda s, v: s + v) / F.size(hits)).otherwise(0.5)


def calibrate_links(links: DataFrame) -> DataFrame:
    """links with confidence, confidence_label and the map confidence_signals.

    Optional columns verified, verdict_confidence, causal_direction and causal_mechanism add
    their signals where they are present.
    """
    has = set(links.columns)
    c = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    semantic = F.coalesce(F.nanvl(c("semantic_similarity", "double"), F.lit(0.0)), F.lit(0.0))
    base = (lookup(SECTOR_BASELINES, F.col("source_sector"), 0.5) + lookup(SECTOR_BASELINES, F.col("target_sector"), 0.5)) / 2.0
    verified = c("verified", "boolean")
    causal = c("causal_direction", "string").isNotNull() & c("causal_mechanism", "string").isNotNull()
    signals = {
        "statistical": (F.least(F.col("cooccurrence_count") * 0.25 + F.col("source_diversity") * 0.15, F.lit(1.0)), F.lit(0.35)),
        "source_reliability": (mean_reliability("source_entity", "target_entity"), F.lit(0.10)),
        "semantic": (F.least(semantic * 1.5, F.lit(1.0)), F.lit(0.15)),
        "sector_baseline": (base, F.lit(0.10)),
        "verification": (F.when(verified.isNotNull(), F.coalesce(c("verdict_confidence", "double"), F.lit(0.5))), F.when(verified, 0.20).when(~verified, 0.10)),
        "causal_evidence": (F.when(causal, 0.75), F.when(causal, 0.10)),
    }
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in signals.values()), F.lit(0.0))
    weight = sum((F.coalesce(w, F.lit(0.0)) for _, w in signals.values()), F.lit(0.0))
    confidence = F.greatest(F.lit(0.05), F.least(F.lit(0.99), total / weight))
    named = F.create_map(*(x for k, (s, _) in signals.items() for x in (F.lit(k), F.round(s, 3))))
    return links.withColumn("confidence", F.round(confidence, 3)).withColumn("confidence_label", label(confidence)).withColumn("confidence_signals", F.map_filter(named, lambda k, v: v.isNotNull()))


def calibrate_narratives(df: DataFrame) -> DataFrame:
    """confidence and label of narratives(phase, acceleration, total_mentions, recent_7_days)."""
    speed = F.least(F.abs(F.coalesce("acceleration", F.lit(0))) * 0.3 + F.coalesce("total_mentions", F.lit(0)) * 0.05 + F.coalesce("recent_7_days", F.lit(0)) * 0.1, F.lit(1.0))
    x = F.greatest(F.lit(0.1), F.least(F.lit(0.98), lookup(PHASE_PRIORS, F.col("phase"), 0.4) * 0.5 + speed * 0.5))
    return df.withColumn("confidence", F.round(x, 3)).withColumn("confidence_label", label(x))


def calibrate_signals(df: DataFrame) -> DataFrame:
    """confidence and label of signals(type, score, burst_factor, recent_count)."""
    s = F.least(F.coalesce("score", F.lit(0.0)) / 10.0 + F.abs(F.coalesce("burst_factor", F.lit(0.0))) * 0.2 + F.coalesce("recent_count", F.lit(0)) * 0.03, F.lit(1.0))
    x = F.greatest(F.lit(0.1), F.least(F.lit(0.98), lookup(SIGNAL_PRIORS, F.col("type"), 0.4) * 0.4 + s * 0.6))
    return df.withColumn("confidence", F.round(x, 3)).withColumn("confidence_label", label(x))


def impact_table(spark) -> DataFrame:
    return spark.createDataFrame(IMPACT_PATTERNS, "p1 string, p2 string, likelihood double, timeframe string, effect string")


def _either_way(links: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """links with the columns of table(p1, p2, ...) for their pair of sectors: the forward row wins,
    then the backward one; of rows that repeat a pair one counts."""
    one = table.groupBy("p1", "p2").agg(F.min(F.struct(*columns)).alias("__x"))
    ahead = one.select(F.col("p1").alias("source_sector"), F.col("p2").alias("target_sector"), F.col("__x").alias("__f"))
    back = one.select(F.col("p2").alias("source_sector"), F.col("p1").alias("target_sector"), F.col("__x").alias("__b"))
    j = links.join(side(ahead), ["source_sector", "target_sector"], "left").join(side(back), ["source_sector", "target_sector"], "left")
    return j.withColumn("__x", F.coalesce("__f", "__b")).select(*links.columns, *(F.col(f"__x.{c}").alias(c) for c in columns))


def predict_impact(links: DataFrame, patterns: DataFrame) -> DataFrame:
    """links with struct impact: the sector pair's pattern (the forward one wins), or the default."""
    joined = _either_way(links, patterns, ["likelihood", "timeframe", "effect"])
    adjusted = F.coalesce(F.col("likelihood") * F.least(F.col("confidence") * 1.2, F.lit(1.0)), F.lit(0.5) * F.col("confidence"))
    weighted = F.when(F.col("likelihood").isNotNull(), adjusted * F.col("confidence")).otherwise(adjusted)
    impact = F.struct(F.coalesce("effect", F.lit(DEFAULT_EFFECT)).alias("predicted_effect"), F.round(adjusted, 3).alias("likelihood"), F.coalesce("timeframe", F.lit("medium")).alias("timeframe"), F.round(weighted, 3).alias("confidence_weighted"))
    return joined.withColumn("impact", impact).select(*links.columns, "impact")


def merge_verdicts(links: DataFrame, verdicts: DataFrame) -> DataFrame:
    """External verdicts (source_entity, target_entity, verified, verdict_confidence, causal_direction,
    causal_mechanism, explanation) joined to the links; links without one keep nulls."""
    return looked_up(links, verdicts, ["source_entity", "target_entity"], lambda: parts(links.count()), "left")


def verification_candidates(links: DataFrame, threshold: float = 0.5, n: int = 20) -> DataFrame:
    return links.where(F.col("strength") >= threshold).orderBy(F.desc("strength"), "source_entity", "target_entity").limit(n)


def filled(template: Column | str) -> Column:
    """A sentence with the link's ends for {a} and {b} and its sectors for {s} and {t}."""
    out = F.lit(template) if isinstance(template, str) else template
    for mark, name in (("{a}", "source_entity"), ("{b}", "target_entity"), ("{s}", "source_sector"), ("{t}", "target_sector")):
        out = F.replace(out, F.lit(mark), F.col(name))
    return out


def why_table(spark) -> DataFrame:
    return spark.createDataFrame(WHY_CONNECTED, "p1 string, p2 string, template string")


def explain_links(links: DataFrame, why: DataFrame | None = None, examples: DataFrame | None = None) -> DataFrame:
    """Impact level and score, a sentence for links without an explanation, and with why(p1, p2, template)
    also why_connected and the struct evidence: counts, strength, confidence (if links have it) and
    of examples(source_entity, target_entity, rank, doc_id) the first three documents."""
    score = F.least(F.col("strength") * 10 + F.col("cooccurrence_count") * 0.5 + F.col("source_diversity") * 2, F.lit(100.0))
    text = F.format_string("%s (%s) and %s (%s) appear together in %d documents from %d sources", "source_entity", "source_sector", "target_entity", "target_sector", "cooccurrence_count", "source_diversity")
    own = F.col("explanation") if "explanation" in links.columns else F.lit(None).cast("string")
    out = links.withColumn("impact_score", F.round(score, 2)).withColumn("impact_level", F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")).withColumn("explanation", F.coalesce(own, text))
    if why is None:
        return out
    ends = ["source_entity", "target_entity"]
    none = F.lit(None).cast("array<bigint>")
    if examples is not None:
        first = examples.where(F.col("rank") <= 3).groupBy(*ends).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("__docs"))
        out = out.join(first.hint("shuffle_merge"), ends, "left")
        none = F.col("__docs")
    confidence = F.round("confidence", 3) if "confidence" in links.columns else F.lit(None).cast("double")
    evidence = F.struct("cooccurrence_count", "source_diversity", F.round("strength", 2).alias("relationship_strength"), confidence.alias("confidence"), F.coalesce(none, F.array().cast("array<bigint>")).alias("examples"))
    told = _either_way(out.withColumn("evidence", evidence), why, ["template"])
    return told.withColumn("why_connected", filled(F.coalesce("template", F.lit(WHY_OTHERWISE)))).drop("template", "__docs")


def downstream_effects(links: DataFrame, effects: DataFrame) -> DataFrame:
    """links with the array downstream: the sector pair's effects in either order (the forward one
    wins), or three sentences made of the two sectors."""
    j = _either_way(links, effects, ["effects"])
    return j.select(*links.columns, F.coalesce("effects", F.array(*(filled(x) for x in DEFAULT_DOWNSTREAM))).alias("downstream"))


def narrative_sentence(name: str = "entity") -> Column:
    return F.format_string("%s is %s: %d mentions, %d of them recent", F.col(name), F.col("phase"), F.col("total_mentions"), F.col("recent_7_days"))


def signal_sentence(name: str = "entity") -> Column:
    return F.format_string("%s: %s (%d mentions, burst %.1fx)", F.col("type"), F.col(name), F.col("recent_count"), F.col("burst_factor"))


def find_link(links: DataFrame, source: str, target: str) -> DataFrame:
    return links.where(((F.col("source_entity") == source) & (F.col("target_entity") == target)) | ((F.col("source_entity") == target) & (F.col("target_entity") == source)))


def search_links(links: DataFrame, text: str = "", sectors: list[str] | None = None) -> DataFrame:
    """Links with an end whose name contains text, and an end in one of the sectors."""
    hit = F.lower("source_entity").contains(text.lower()) | F.lower("target_entity").contains(text.lower())
    if sectors:
        hit = hit & (F.col("source_sector").isin(sectors) | F.col("target_sector").isin(sectors))
    return links.where(hit)
