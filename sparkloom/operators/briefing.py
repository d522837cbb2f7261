"""Briefing tables: situations, watch items, predictions, findings, feeds and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.scratch import stored


def _sides(links: DataFrame) -> DataFrame:
    """Each link once for each of its ends: sector, partner sector, entity."""
    side = F.explode(F.array(F.struct(F.col("source_sector").alias("sector"), F.col("target_sector").alias("partner"), F.col("source_entity").alias("entity")), F.struct(F.col("target_sector").alias("sector"), F.col("source_sector").alias("partner"), F.col("target_entity").alias("entity"))))
    return links.select("*", side.alias("side")).select("side.*", "confidence", "strength", "cooccurrence_count")


def link_summary(links: DataFrame) -> DataFrame:
    """Counts and means; links may have verified and causal_direction."""
    has = lambda c, test: F.count_if(test) if c in links.columns else F.lit(0).cast("long")
    return links.agg(
        F.count("*").alias("total_links"), F.count_if(F.col("confidence") >= 0.7).alias("high_confidence"), F.round(F.avg("confidence"), 3).alias("mean_confidence"), F.round(F.avg("strength"), 3).alias("mean_strength"),
        has("verified", F.expr("verified")).alias("verified"), has("causal_direction", F.expr("causal_direction IS NOT NULL")).alias("causal"),
    )


def sector_situation(links: DataFrame, sectors: DataFrame, partners: int = 3) -> DataFrame:
    """One row per sector, stable where no link touches it."""
    # Links are met once: all else follows from a row for each two sectors.
    s = stored(_sides(links).groupBy("sector", "partner").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"), F.count("confidence").alias("known"), F.count_if(F.col("confidence") >= 0.7).alias("high"), F.sum("cooccurrence_count").alias("c")), "situation")
    base = s.groupBy("sector").agg(F.sum("n").alias("n_links"), F.round(F.try_divide(F.sum("confidence"), F.sum("known")), 3).alias("avg_confidence"), F.sum("high").alias("high_confidence"), F.sum("c").alias("cooccurrences"))
    r = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("n"), "partner"))
    top = s.withColumn("r", r).where(F.col("r") <= partners).groupBy("sector").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "partner"))), lambda x: x["partner"]), ",").alias("partners"))
    names = sectors.groupBy("sector").agg(F.count("*").alias("n_entities"))
    out = names.join(base.hint("shuffle_merge"), "sector", "left").join(top.hint("shuffle_merge"), "sector", "left").fillna(0, ["n_links", "high_confidence", "cooccurrences"])
    status = F.when(F.col("n_links") == 0, "stable").when((F.col("avg_confidence") > 0.6) | (F.col("high_confidence") > 3), "active").otherwise("monitoring")
    return out.withColumn("status", status)


def watch_items(links: DataFrame, anomalies: DataFrame, transitions: DataFrame, each: int = 5, top: int = 20) -> DataFrame:
    weak = links.where("confidence < 0.5 AND cooccurrence_count >= 3").orderBy("confidence", "source_entity", "target_entity").limit(each).select(F.lit("weak_link").alias("kind"), F.concat_ws(" - ", "source_entity", "target_entity").alias("item"), F.lit(2).alias("priority"), F.col("confidence").alias("value"))
    odd = anomalies.orderBy(F.desc(F.abs("z_score")), "entity").limit(each).select(F.lit("anomaly").alias("kind"), F.col("entity").alias("item"), F.lit(1).alias("priority"), F.col("z_score").alias("value"))
    change = transitions.orderBy(F.desc("confidence"), "entity").limit(each).select(F.lit("transition").alias("kind"), F.col("entity").alias("item"), F.lit(3).alias("priority"), F.col("confidence").alias("value"))
    return odd.unionByName(weak).unionByName(change).orderBy("priority", "item").limit(top)


def predictions(links: DataFrame, transitions: DataFrame, top: int = 20) -> DataFrame:
    """links need their impact struct."""
    a = links.where("impact.likelihood > 0.5").select(F.lit("impact").alias("kind"), F.concat_ws(" - ", "source_entity", "target_entity").alias("item"), F.col("impact.predicted_effect").alias("prediction"), F.col("impact.likelihood").alias("likelihood"))
    b = transitions.orderBy(F.desc("confidence"), "entity").limit(5).select(F.lit("transition").alias("kind"), F.col("entity").alias("item"), F.col("predicted_phase").alias("prediction"), F.col("confidence").alias("likelihood"))
    return a.unionByName(b).orderBy(F.desc("likelihood"), "kind", "item").limit(top)


def key_connections(links: DataFrame, n: int = 5) -> DataFrame:
    return links.orderBy(F.desc("confidence"), F.desc("cooccurrence_count"), "source_entity", "target_entity").limit(n).select("source_entity", "target_entity", "confidence", "cooccurrence_count")


def overall(links: DataFrame) -> DataFrame:
    """One row: totals, overall label, and the list of sectors."""
    # Links are met once: all else follows from a row for each two sectors.
    by = stored(links.groupBy("source_sector", "target_sector").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count("confidence").alias("known")), "overall")
    names = by.select(F.explode(F.array("source_sector", "target_sector")).alias("sector")).agg(F.array_join(F.array_sort(F.collect_set("sector")), ",").alias("sectors"))
    one = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.round(F.coalesce(F.try_divide(F.sum("c"), F.sum("known")), F.lit(0.0)), 3).alias("confidence"))
    return one.crossJoin(names).withColumn("label", F.when(F.col("confidence") >= 0.6, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low"))


def executive_summary(links: DataFrame, situation: DataFrame, named: int = 4) -> DataFrame:
    """One row with the sentence over all links and the active sectors of sector_situation()."""
    verified = F.count_if("verified") if "verified" in links.columns else F.lit(0)
    one = links.agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.7).alias("high"), verified.alias("verified"))
    active = situation.where("status = 'active'").agg(F.count("*").alias("k"), F.array_join(F.slice(F.array_sort(F.collect_list("sector")), 1, named), ", ").alias("names"))  # a row for each sector
    text = "Intelligence assessment covering %d cross-domain relationships across %d active sectors. %d high-confidence connections identified, %d LLM-verified. Primary intelligence activity detected in: %s."
    return one.crossJoin(F.broadcast(active)).select(F.format_string(text, "n", "k", "high", "verified", "names").alias("summary"))


def findings(links: DataFrame, chains: DataFrame | None = None, n: int = 3, n_chains: int = 5) -> DataFrame:
    """finding_index, kind, title, description, significance, entities, sectors, confidence: the first n links
    by confidence, then of chains(chain_key, chain, hops, total_weight) the n_chains with most hops."""
    top = links.orderBy(F.desc("confidence"), F.desc("cooccurrence_count"), "source_entity", "target_entity").limit(n)
    of_links = top.select(
        F.lit("link").alias("kind"), F.format_string("Cross-domain activity: %s-%s", "source_sector", "target_sector").alias("title"),
        F.format_string("%s and %s show %d co-occurrences across %d sources.", "source_entity", "target_entity", "cooccurrence_count", "source_diversity").alias("description"),
        F.when(F.col("confidence") > 0.7, "high").otherwise("medium").alias("significance"), F.array_join(F.array("source_entity", "target_entity"), ",").alias("entities"),
        F.array_join(F.array("source_sector", "target_sector"), ",").alias("sectors"), "confidence", F.struct((-F.col("confidence")).alias("a"), (-F.col("cooccurrence_count").cast("double")).alias("b"), F.concat_ws(" ", "source_entity", "target_entity").alias("c")).alias("__order"),
    )
    if chains is not None:
        best = chains.orderBy(F.desc("hops"), F.desc("total_weight"), "chain").limit(n_chains)
        of_links = of_links.unionByName(best.select(
            F.lit("chain").alias("kind"), F.format_string("Impact chain: %s", F.replace("chain_key", F.lit("->"), F.lit(" -> "))).alias("title"), F.format_string("%d hops, weight %.0f", "hops", "total_weight").alias("description"), F.lit("medium").alias("significance"),
            F.replace("chain", F.lit("->"), F.lit(",")).alias("entities"), F.replace("chain_key", F.lit("->"), F.lit(",")).alias("sectors"), F.lit(None).cast("double").alias("confidence"), F.struct((-F.col("hops").cast("double")).alias("a"), (-F.col("total_weight")).alias("b"), F.col("chain").alias("c")).alias("__order"),
        ))
    place = F.row_number().over(Window.orderBy(F.desc("kind"), "__order"))  # n + n_chains rows
    return of_links.withColumn("finding_index", place - 1).select("finding_index", "kind", "title", "description", "significance", "entities", "sectors", "confidence")


def critic_statistics(links: DataFrame) -> DataFrame:
    """One row over links(confidence, verified): the verified share, mean confidence, quality and the gap in words."""
    one = links.agg(F.count("*").alias("n_links"), F.count_if("verified").alias("n_verified"), F.round(F.avg("confidence"), 3).alias("mean_confidence"), (F.avg("confidence") > 0.5).alias("good"))
    share = F.when(F.col("n_links") > 0, F.round(F.col("n_verified") / F.col("n_links"), 4))
    gap = F.format_string("Only %d/%d relationships LLM-verified", "n_verified", "n_links")
    return one.select("n_links", "n_verified", share.alias("verified_share"), "mean_confidence", F.when(F.col("good"), "medium").otherwise("low").alias("quality"), gap.alias("gap"))


ISSUE = "Finding based on correlation, not proven causation"


def critique(found: DataFrame, links: DataFrame) -> DataFrame:
    """A row per finding: finding_index, title, issue, severity, and the quality and gap of all links; the
    first three findings are the key developments."""
    rows = found.select("finding_index", "title", F.lit(ISSUE).alias("issue"), F.lit("medium").alias("severity"), (F.col("finding_index") < 3).alias("key_development"))
    return rows.crossJoin(F.broadcast(critic_statistics(links).select("quality", "gap")))  # one row


def agent_briefing(found: DataFrame, links: DataFrame) -> DataFrame:
    """One row: the sentence over findings, their different sectors in order, and the quality."""
    named = found.select(F.explode(F.split("sectors", ",")).alias("s")).agg(F.array_join(F.array_sort(F.collect_set("s")), ", ").alias("names"))  # sectors of a few findings
    one = found.agg(F.count("*").alias("n")).crossJoin(F.broadcast(named)).crossJoin(F.broadcast(critic_statistics(links).select("quality")))
    return one.select(F.format_string("Analysis of %d intelligence findings. Key sectors: %s. Confidence quality: %s.", "n", "names", "quality").alias("briefing"))


def discovery_feed(links: DataFrame, signals: DataFrame, topics: DataFrame, chains: DataFrame | None = None, per_kind: int = 10, top: int = 30, min_strength: float = 0.0) -> DataFrame:
    """kind, item, value: the strongest links (strength / 30), signals (score / 100), topics (acceleration / 10) and
    chains (weight / 100), each at most 1, together by value."""
    share = lambda c, whole: F.least(c / F.lit(float(whole)), F.lit(1.0)).alias("value")
    every = links.where(F.col("strength") >= min_strength).select(F.lit("link").alias("kind"), F.concat_ws(" - ", "source_entity", "target_entity").alias("item"), share(F.col("strength"), 30))
    every = every.unionByName(signals.select(F.lit("signal").alias("kind"), F.coalesce("keyword", "entity").alias("item"), share(F.col("score"), 100)))
    every = every.unionByName(topics.select(F.lit("topic").alias("kind"), F.col("topic").alias("item"), share(F.abs("acceleration"), 10)))
    if chains is not None:
        every = every.unionByName(chains.select(F.lit("chain").alias("kind"), F.col("chain").alias("item"), share(F.col("total_weight"), 100)))
    r = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("value"), "item"))
    every = every.withColumn("r", r).where(F.col("r") <= per_kind).drop("r")
    return every.select("kind", "item", F.round("value", 4).alias("value")).orderBy(F.desc("value"), "kind", "item").limit(top)


def timeline(entities: DataFrame, clusters: DataFrame, chains: DataFrame | None = None, n: int = 25, n_chains: int = 10) -> DataFrame:
    """kind, topic, acceleration, phase: the n topics that move most, and of chains of two nodes up the first n_chains."""
    e = entities.select(F.lit("entity").alias("kind"), F.col("entity").cast("string").alias("topic"), "acceleration", "phase")
    c = clusters.select(F.lit("cluster").alias("kind"), F.col("cluster").cast("string").alias("topic"), "acceleration", "phase")
    out = e.unionByName(c).orderBy(F.desc(F.abs("acceleration")), "kind", "topic").limit(n)
    if chains is None:
        return out
    long_ = chains.where(F.contains("chain", F.lit("->"))).orderBy(F.desc("hops"), F.desc("total_weight"), "chain").limit(n_chains)
    return out.unionByName(long_.select(F.lit("chain").alias("kind"), F.col("chain").alias("topic"), F.lit(None).cast("long").alias("acceleration"), F.lit(None).cast("string").alias("phase")))


def explorer_entities(links: DataFrame) -> DataFrame:
    """sector, entity: total strength and number of links."""
    return _sides(links).groupBy("sector", "entity").agg(F.round(F.sum("strength"), 3).alias("total_strength"), F.count("*").alias("n_links"))


def explorer_totals(links: DataFrame, n: int = 4) -> DataFrame:
    """One row: different entities and sectors, and the n sectors with most links."""
    # Links are met once: all else follows from a row for each entity of a sector.
    s = stored(_sides(links).groupBy("sector", "entity").agg(F.count("*").alias("k")), "totals")
    by = s.groupBy("sector").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "sector").limit(n)
    first = by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "sector"))), lambda x: x["sector"]), ",").alias("top_sectors"))  # n rows
    return s.agg(F.countDistinct("entity").alias("n_entities"), F.countDistinct("sector").alias("n_sectors")).crossJoin(F.broadcast(first))


def entity_stats(links: DataFrame) -> DataFrame:
    """Per entity: mean and largest strength, the strongest link (the first by name of equals) and number of links."""
    ends = [F.struct(F.col(f"{a}_entity").alias("entity"), F.col(f"{b}_entity").alias("other")) for a, b in (("source", "target"), ("target", "source"))]
    s = links.select("strength", F.explode(F.array(*ends)).alias("e")).select("strength", "e.*")
    top = F.min(F.struct((-F.col("strength")).alias("s"), "other"))["other"]
    return s.groupBy("entity").agg(F.round(F.avg("strength"), 8).alias("mean_strength"), F.round(F.max("strength"), 4).alias("max_strength"), top.alias("strongest"), F.count("*").alias("n_links"))


def source_reliability(docs: DataFrame) -> DataFrame:
    """docs(source, sensationalism, clickbait, emotional): counts, means and the score per source."""
    s = docs.groupBy("source").agg(F.count("*").alias("n_articles"), F.avg("sensationalism").alias("s"), F.avg("clickbait").alias("c"), F.avg("emotional").alias("e"))
    return s.select("source", "n_articles", F.round("s", 4).alias("sensationalism"), F.round("c", 4).alias("clickbait"), F.round("e", 4).alias("emotional"), F.round(100 - 200 * F.col("s") - 100 * F.col("c") - 50 * F.col("e"), 2).alias("score"))
