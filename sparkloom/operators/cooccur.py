"""Co-occurrence: entity frequencies, pairs inside documents and sector links scored by NPMI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import containing
from sparkloom.sources.scratch import looked_up, stored


def per_document(mentions: DataFrame) -> DataFrame:
    """One row for each (document, entity)."""
    return mentions.select("doc_id", "entity", "source", "ts").dropDuplicates(["doc_id", "entity"])


def entity_frequency(mentions: DataFrame) -> DataFrame:
    """entity, n_mentions, n_sources."""
    return mentions.groupBy("entity").agg(F.count("*").alias("n_mentions"), F.countDistinct("source").alias("n_sources"))


def important_entities(mentions: DataFrame, min_mentions: int = 2, min_sources: int = 1) -> DataFrame:
    return entity_frequency(mentions).where((F.col("n_mentions") >= min_mentions) & (F.col("n_sources") >= min_sources))


def only_important(mentions: DataFrame, important: DataFrame) -> DataFrame:
    """Semi-join before pairing, so that rare entities never reach the self-join."""
    return looked_up(mentions, stored(important.select("entity"), "important"), "entity", lambda: parts(mentions.count()), "left_semi")


#: Rows that one task joins, pairs or counts, or about so many.
PART_ROWS = 200_000


def parts(rows: int) -> int:
    """Partitions of so many rows: more for more rows, so a task needs the same memory whatever the input."""
    return -(-rows // PART_ROWS) or 1


def by_document(mentions: DataFrame) -> DataFrame:
    """mentions with each document in one partition, and more partitions for more mentions: so a task that
    pairs them and counts pairs needs the same memory whatever the input."""
    return mentions.repartition(parts(mentions.count()), "doc_id")


def documents(mentions: DataFrame, multiset: bool = False) -> DataFrame:
    """doc_id, found: the document's different entities with a source each, in order; with multiset, all its mentions."""
    if multiset:
        m = by_document(mentions.select("doc_id", "ord", "entity", "source").where("doc_id IS NOT NULL AND ord IS NOT NULL"))
        return m.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "entity", "source"))).alias("found"))
    m = by_document(mentions.select("doc_id", "entity", "source").where("doc_id IS NOT NULL"))
    every = m.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("entity", "source"))).alias("found"))
    new = lambda x, i: (i == 0) | ~x["entity"].eqNullSafe(F.col("found")[F.greatest(i - 1, F.lit(0))]["entity"])
    return every.select("doc_id", F.filter("found", new).alias("found"))


def pairs_of(docs: DataFrame, multiset: bool = False) -> DataFrame:
    """The pairs of documents(): each entity with those behind it, a row at a time."""
    first = docs.select("doc_id", "found", F.posexplode("found").alias("i", "a"))
    pair = first.select("doc_id", "a", F.explode(F.slice("found", F.col("i") + 2, F.size("found"))).alias("b"))
    if multiset:
        return pair.where("a.ord < b.ord").select("doc_id", "a.source", F.least("a.entity", "b.entity").alias("e1"), F.greatest("a.entity", "b.entity").alias("e2"))
    return pair.where("a.entity IS NOT NULL AND b.entity IS NOT NULL").select("doc_id", "a.source", F.col("a.entity").alias("e1"), F.col("b.entity").alias("e2"))


def entity_pairs(mentions: DataFrame, multiset: bool = False, max_per_doc: int | None = None) -> DataFrame:
    """doc_id, source, e1, e2 with e1 < e2: all pairs inside a document.

    With multiset, repeated mentions make repeated pairs, and pairs of an entity with itself.
    max_per_doc keeps a hub document's most frequent entities only (an option, off by default).
    """
    if max_per_doc:
        m = mentions if multiset else mentions.dropDuplicates(["doc_id", "entity"])
        often = mentions.groupBy("entity").agg(F.count("*").alias("n"))
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "entity"))
        mentions = m.join(often, "entity").withColumn("r", rank).where(F.col("r") <= max_per_doc).drop("r", "n")
    return pairs_of(documents(mentions, multiset), multiset)


def counted_pairs(docs: DataFrame, aggregates: list[Column], multiset: bool = False) -> tuple[DataFrame, int]:
    """e1, e2 and aggregates over their pairs in stored documents(), and the number of partitions, which grows with the pairs."""
    size = F.size("found").cast("long")
    n = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("m"), F.coalesce(F.sum(F.expr("size(found) * (size(found) - 1L) div 2")), F.lit(0)).alias("p")).first()
    pairs = pairs_of(docs.repartition(parts(n.m), "doc_id"), multiset)
    return pairs.repartition(parts(n.p), "e1", "e2").groupBy("e1", "e2").agg(*aggregates), parts(n.p)


def pair_weights(mentions: DataFrame, multiset: bool = False) -> DataFrame:
    """e1, e2, weight: weighted_pairs(entity_pairs(mentions)), counted in partitions that grow with the pairs."""
    return counted_pairs(stored(documents(mentions, multiset), "documents"), [F.count("*").alias("weight")], multiset)[0]


def weighted_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("e1", "e2").agg(F.count("*").alias("weight"))


def flagged_pairs(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    """e1, e2, weight, cross_domain of stored weights: whether both ends have sectors and these differ."""
    n = parts(weights.count())
    s1, s2 = (sectors.select(F.col("entity").alias(e), F.col("sector").alias(s)) for e, s in (("e1", "s1"), ("e2", "s2")))
    both = looked_up(looked_up(weights, s1, "e1", n, "left"), s2, "e2", n, "left")
    return both.select("e1", "e2", "weight", F.coalesce(F.col("s1") != F.col("s2"), F.lit(False)).alias("cross_domain"))


def npmi_strength(count: Column, f1: Column, f2: Column, n: Column, diversity: Column) -> Column:
    p = count / n
    raw = F.log(F.greatest(p / ((f1 / n) * (f2 / n)), F.lit(1e-10)))
    span = -F.log(F.greatest(p, F.lit(1e-10)))
    npmi = F.when(span > 1e-10, raw / span).otherwise(1.0)
    return F.round(F.greatest(npmi, F.lit(0.0)) * 0.6 + F.least(diversity / 5.0, F.lit(1.0)) * 0.4, 3)


def sector_links(mentions: DataFrame, sectors: DataFrame, min_count: int = 2) -> DataFrame:
    """All cross-sector links: counts, source diversity and NPMI strength.

    Pairs are counted before sectors and frequencies are attached, so the lookups meet one row
    a pair.  N and the frequencies are over documents with two entities or more.
    """
    docs = stored(documents(mentions).where(F.size("found") >= 2), "documents")
    n = docs.agg(F.count("*").alias("n"))
    freq = docs.select(F.explode("found.entity").alias("entity")).groupBy("entity").agg(F.count("*").alias("f"))
    ends = stored(sectors.join(freq.hint("shuffle_merge"), "entity").select("entity", "sector", "f"), "ends")
    pair, into = counted_pairs(docs, [F.count("*").alias("cooccurrence_count"), F.countDistinct("source").alias("source_diversity")])
    pair = looked_up(pair.where(F.col("cooccurrence_count") >= min_count), ends.toDF("e1", "s1", "f1"), "e1", into)
    pair = looked_up(pair, ends.toDF("e2", "s2", "f2"), "e2", into).where("s1 <> s2")
    pair = pair.crossJoin(F.broadcast(n))  # one row
    strength = npmi_strength(F.col("cooccurrence_count"), F.col("f1"), F.col("f2"), F.col("n"), F.col("source_diversity"))
    return pair.select(
        F.col("e1").alias("source_entity"), F.col("e2").alias("target_entity"), F.col("s1").alias("source_sector"), F.col("s2").alias("target_sector"),
        "cooccurrence_count", "source_diversity", strength.alias("strength"), F.lit(0.0).alias("semantic_similarity"),
    )


def top_links(links: DataFrame, n: int = 200) -> DataFrame:
    return links.orderBy(F.desc("strength"), "source_entity", "target_entity").limit(n)


def new_links(links: DataFrame, previous: DataFrame) -> DataFrame:
    """Links whose pair the previous snapshot does not have."""
    return links.join(previous.select("source_entity", "target_entity"), ["source_entity", "target_entity"], "left_anti")


def link_documents(links: DataFrame, mentions: DataFrame, keep: int) -> DataFrame:
    """source_entity, target_entity, rank, doc_id: the first documents that hold both ends."""
    m = per_document(mentions)
    a = m.select("doc_id", F.col("entity").alias("source_entity"))
    b = m.select("doc_id", F.col("entity").alias("target_entity"))
    both = links.select("source_entity", "target_entity").join(a, "source_entity").join(b, ["doc_id", "target_entity"])
    rank = F.row_number().over(Window.partitionBy("source_entity", "target_entity").orderBy("doc_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= keep).select("source_entity", "target_entity", "rank", "doc_id")


def link_contexts(links: DataFrame, mentions: DataFrame, texts: DataFrame, keep: int = 5, chars: int = 1000) -> DataFrame:
    """source_entity, target_entity, rank, doc_id, context: the first texts that hold both ends."""
    first = link_documents(links, mentions, keep)
    return first.join(texts, "doc_id").select("source_entity", "target_entity", "rank", "doc_id", F.substring("text", 1, chars).alias("context"))


def semantic_links(links: DataFrame, mentions: DataFrame, vectors: DataFrame, keep: int = 20) -> DataFrame:
    """links whose semantic_similarity is the mean cosine of the vectors(doc_id, embedding) of the first
    keep documents that hold both ends; 0 with less than two."""
    ends = ["source_entity", "target_entity"]
    found = stored(link_documents(links, mentions, keep), "link-documents").join(vectors.hint("shuffle_merge"), "doc_id")
    mean = mean_pairwise_cosine(found.withColumn("link", F.struct(*ends)), "link", digits=3).select("link.*", F.col("mean_cosine").alias("__mean"))
    joined = links.join(stored(mean, "link-semantics").hint("shuffle_merge"), ends, "left")
    return joined.withColumn("semantic_similarity", F.coalesce("__mean", F.lit(0.0))).select(*links.columns)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def mean_pairwise_cosine(vectors: DataFrame, key: str, value: str = "embedding", digits: int = 4) -> DataFrame:
    """Mean cosine over all pairs of a group, from the sum of its unit vectors: no pair is made."""
    unit = vectors.withColumn("norm", F.sqrt(F.aggregate(value, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))).where("norm > 0")
    parts = unit.select(key, "norm", F.posexplode(value)).groupBy(key, "pos").agg(F.sum(F.col("col").cast("double") / F.col("norm")).alias("s"))
    counts = unit.groupBy(key).agg(F.count("*").alias("n"))
    total = parts.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("sq")).join(counts.hint("shuffle_merge"), key).where("n > 1")
    return total.select(key, "n", F.round((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), digits).alias("mean_cosine"))


def pair_reduction(mentions: DataFrame, min_mentions: int = 2) -> DataFrame:
    """Distinct pairs before and after the importance filter: after it are those whose ends both pass it."""
    pairs = stored(pair_weights(mentions).select("e1", "e2"), "pairs")
    n, kept = parts(pairs.count()), stored(important_entities(mentions, min_mentions).select("entity"), "important")
    after = looked_up(looked_up(pairs, kept.toDF("e1"), "e1", n, "left_semi"), kept.toDF("e2"), "e2", n, "left_semi")
    return pairs.agg(F.count("*").alias("pairs_before")).crossJoin(F.broadcast(after.agg(F.count("*").alias("pairs_after"))))  # one row


def classify_sectors(entities: DataFrame, keywords: DataFrame, contexts: DataFrame | None = None, whole_word: bool = False) -> DataFrame:
    """entity, sector, confidence by keywords contained in the name (+1), organisation words in the
    names of organisations (+1.5) and, given contexts(entity, text), keywords in any context (+0.3).

    keywords(sector, rank, keyword, kind): kind is 'keyword' or 'org'.  With whole_word, keywords
    stand between spaces.  Ties go to the sector of lower rank; entities without any score get
    global_events at 0.1.
    """
    gap = F.lit(" " if whole_word else "")
    words = keywords.select("*", F.concat(gap, "keyword", gap).alias("__word"))

    def held(rows: DataFrame, text: str) -> DataFrame:
        return containing(rows.withColumn("__text", F.concat(gap, F.lower(text), gap)), "__text", words, "__word")

    rows = held(entities, "entity").where((F.col("kind") == "keyword") | (F.col("etype") == "orgs"))
    hits = rows.select("entity", "sector", "rank", F.when(F.col("kind") == "org", 1.5).otherwise(1.0).alias("points"))
    if contexts is not None:
        near = held(contexts.select("entity", "text"), "text").where("kind = 'keyword'").select("entity", "sector", "rank", "keyword").distinct()
        hits = hits.unionByName(near.select("entity", "sector", "rank", F.lit(0.3).alias("points")))
    scored = hits.groupBy("entity", "sector", "rank").agg(F.sum("points").alias("score"))
    best = scored.groupBy("entity").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank", "sector")).alias("b"))
    out = entities.select("entity").join(best, "entity", "left")
    return out.select("entity", F.coalesce("b.sector", F.lit("global_events")).alias("sector"), F.when(F.col("b.s").isNull(), 0.1).otherwise(F.round(F.least(-F.col("b.s") / 5.0, F.lit(1.0)), 3)).alias("confidence"))


def sector_map(mentions: DataFrame, sectors: DataFrame) -> DataFrame:
    """entity, etype (of its last mention), sector, mention_count."""
    seen = mentions.groupBy("entity").agg(F.count("*").alias("mention_count"), F.max(F.struct("ts", "doc_id", "ord", "etype"))["etype"].alias("etype"))
    return seen.join(sectors, "entity").select("entity", "etype", "sector", "mention_count")
