"""Registered queries of the core operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import language
from sparkloom.functions import text as T
from sparkloom.operators import briefing, cooccur, dedup, graph, lag, scoring, search, signals, trends, vector_index
from sparkloom.operators import narratives as N
from sparkloom.plans.bindings import ARTICLES, EVENTS, MENTIONS, SECTORS, articles, event_mentions, mentions, read, sectors
from sparkloom.sources import ingest, keyed
from sparkloom.sources.scratch import folder, side, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- shared SQL

DOC = "doc AS (SELECT DISTINCT doc_id, entity, source, ts FROM mentions)"
FREQ = "freq AS (SELECT entity, count(*) AS n_mentions, count(DISTINCT source) AS n_sources FROM mentions GROUP BY entity)"
PAIRS = "pairs AS (SELECT a.doc_id, a.source, a.entity AS e1, b.entity AS e2 FROM doc a JOIN doc b ON a.doc_id = b.doc_id AND a.entity < b.entity)"
LINKS = f"""{MENTIONS}, {SECTORS}, {DOC}, big AS (SELECT * FROM doc WHERE doc_id IN (SELECT doc_id FROM doc GROUP BY doc_id HAVING count(*) >= 2)),
  nn AS (SELECT count(DISTINCT doc_id) AS n FROM big), f AS (SELECT entity, count(*) AS f FROM big GROUP BY entity), {PAIRS},
  cnt AS (SELECT e1, e2, count(*) AS c, count(DISTINCT source) AS d FROM pairs GROUP BY e1, e2 HAVING count(*) >= 2),
  links AS (SELECT e1 AS source_entity, e2 AS target_entity, s1.sector AS source_sector, s2.sector AS target_sector, c AS cooccurrence_count, d AS source_diversity,
    round(greatest(CASE WHEN -ln(c / n) > 1e-10 THEN ln(greatest((c / n) / ((f1.f / n) * (f2.f / n)), 1e-10)) / -ln(c / n) ELSE 1.0 END, 0.0) * 0.6 + least(d / 5.0, 1.0) * 0.4, 3) AS strength,
    CAST(0.0 AS DOUBLE) AS semantic_similarity
  FROM cnt JOIN sectors s1 ON s1.entity = e1 JOIN sectors s2 ON s2.entity = e2 JOIN f f1 ON f1.entity = e1 JOIN f f2 ON f2.entity = e2, nn WHERE s1.sector <> s2.sector),
  lk AS (SELECT *, round(greatest(0.05, least(0.99, (least(CAST(cooccurrence_count * 0.25 + source_diversity * 0.15 AS DOUBLE), 1.0::DOUBLE) * 0.35::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE) / 0.7::DOUBLE)), 3) AS confidence FROM links)"""
DAILY = "daily AS (SELECT entity, CAST(ts AS DATE) AS day, count(*) AS n FROM mentions WHERE ts IS NOT NULL GROUP BY ALL)"
BACK = "bk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS back FROM daily)"
VELOCITY = f"""{EVENTS}, {DAILY}, {BACK},
  vs AS (SELECT entity, CAST(sum(n) AS BIGINT) AS total_mentions, count(*) AS unique_days, sum(CASE WHEN back <= 7 THEN n ELSE 0 END) / least(count(*), 7) AS r, sum(CASE WHEN back > 7 THEN n ELSE 0 END) / greatest(count(*) - 7, 1) AS p
    FROM bk GROUP BY entity HAVING sum(n) >= 3 AND count(*) >= 2),
  velocity AS (SELECT entity, total_mentions, unique_days, round(r, 2) AS recent_rate, round(p, 2) AS prior_rate, round(r - p, 2) AS velocity, round((r - p) / greatest(p, 0.1), 2) AS acceleration,
    CASE WHEN (r - p) / greatest(p, 0.1) > 1.5 THEN 'accelerating' WHEN (r - p) / greatest(p, 0.1) < -1.5 THEN 'decelerating' ELSE 'stable' END AS trend,
    round(abs((r - p) / greatest(p, 0.1)) / greatest(abs(r - p) + 0.1, 1.0), 3) AS anomaly_score FROM vs)"""


def phases_sql(table: str, key: str) -> str:
    return f"""ph0 AS (SELECT {key}, count(*) AS points, max(CASE WHEN back = 1 THEN n END) AS c1, max(CASE WHEN back = 2 THEN n END) AS c2, max(CASE WHEN back = 3 THEN n END) AS c3, avg(CASE WHEN back > 3 THEN n END) AS rest FROM {table} GROUP BY {key}),
  ph1 AS (SELECT {key}, points, (c1 + c2 + c3) / 3 AS r, coalesce(rest, c3) AS o, c1 - 2 * c2 + c3 AS a FROM ph0),
  phases AS (SELECT {key}, points, CASE WHEN points < 3 THEN 'emerging' WHEN r = 0 THEN 'dormant' WHEN o = 0 THEN 'emerging' WHEN a > 0 AND (r - o) / o > 0.5 THEN 'accelerating' WHEN (r - o) / o > 0.2 THEN 'growing'
    WHEN (r - o) / o < -0.2 AND a < 0 THEN 'declining' WHEN (r - o) / o < -0.5 THEN 'fading' WHEN abs((r - o) / o) <= 0.2 AND r > o * 0.5 THEN 'peaked' WHEN a > 0 AND (r - o) / o < 0 THEN 'resurging' ELSE 'stable' END AS phase FROM ph1)"""


def narratives_sql(key: str, min_days: int) -> str:
    return f"""nr AS (SELECT {key}, CAST(sum(n) AS BIGINT) AS total_mentions, count(*) AS active_days, min(day) AS first_seen, max(day) AS last_seen,
    CAST(CASE WHEN count(*) >= 7 THEN sum(CASE WHEN back <= 7 THEN n END) ELSE sum(n) END AS BIGINT) AS recent_7_days, CAST(CASE WHEN count(*) >= 14 THEN sum(CASE WHEN back BETWEEN 8 AND 14 THEN n END) ELSE 0 END AS BIGINT) AS previous_7_days
    FROM bk GROUP BY {key} HAVING count(*) >= {min_days}),
  narr AS (SELECT nr.*, recent_7_days - previous_7_days AS acceleration, phase FROM nr JOIN phases USING ({key}))"""


NARR = f"{EVENTS}, {DAILY}, {BACK}, {phases_sql('bk', 'entity')}, {narratives_sql('entity', 2)}"
TRANSITIONS = f"""{VELOCITY}, {phases_sql('bk', 'entity')}, tr AS (SELECT v.entity, coalesce(phase, 'stable') AS current_phase, velocity, acceleration,
    CASE WHEN phase IN ('emerging', 'growing') AND acceleration > 2.0 AND velocity > 1.0 THEN {{'p': 'accelerating', 'c': round(least(acceleration * 0.15, 0.95), 3), 'r': 'Sustained velocity increase suggests acceleration phase'}}
      WHEN phase IN ('accelerating', 'growing') AND acceleration < -1.0 AND velocity < 0 THEN {{'p': 'peaked', 'c': round(least(abs(acceleration) * 0.2, 0.90), 3), 'r': 'Velocity decrease from high levels suggests peak reached'}}
      WHEN phase IN ('declining', 'peaked') AND acceleration < -1.5 AND velocity < -1.0 THEN {{'p': 'fading', 'c': round(least(abs(acceleration) * 0.15, 0.90), 3), 'r': 'Accelerating decline indicates fading phase'}}
      WHEN phase IN ('fading', 'dormant') AND acceleration > 1.5 AND velocity > 0.5 THEN {{'p': 'resurging', 'c': round(least(acceleration * 0.15, 0.85), 3), 'r': 'Renewed velocity after decline suggests resurgence'}}
      WHEN trend = 'stable' AND abs(velocity) < 0.5 THEN {{'p': 'stable', 'c': CAST(0.6 AS DOUBLE), 'r': 'Consistent mention rate with no significant trend'}} END AS t FROM velocity v LEFT JOIN phases USING (entity)),
  transitions AS (SELECT entity, current_phase, t.p AS predicted_phase, CAST(t.c AS DOUBLE) AS confidence, t.r AS reason, velocity, acceleration FROM tr WHERE t.c > 0.4)"""
BURSTS = f"""{EVENTS}, {DAILY}, dd AS (SELECT count(DISTINCT day) AS d FROM daily), bm AS (SELECT entity, sum(n) / d AS mean, sqrt(CAST(sum(n * n) * d - sum(n) * sum(n) AS DOUBLE)) / d AS sd FROM daily, dd GROUP BY entity, d HAVING sum(n * n) * d > sum(n) * sum(n) AND d >= 5),
  bursts AS (SELECT entity, day, round((n - mean) / sd, 2) AS burst_factor, n AS "count", round(mean, 2) AS expected FROM daily JOIN bm USING (entity) WHERE n >= 2 AND (n - mean) / sd >= 2.5)"""


# ---- mentions, pairs, links

@query(f"WITH {MENTIONS}, {FREQ} SELECT * FROM freq")
def entity_freq(spark, d):
    return cooccur.entity_frequency(mentions(spark, d))


@query(f"WITH {MENTIONS}, {FREQ} SELECT * FROM freq WHERE n_mentions >= 2")
def entity_important(spark, d):
    return cooccur.important_entities(mentions(spark, d))


@query(f"WITH {MENTIONS}, {DOC}, {PAIRS} SELECT e1, e2, count(*) AS weight FROM pairs GROUP BY e1, e2")
def mentions_pairs(spark, d):
    return cooccur.pair_weights(mentions(spark, d))


@query(f"WITH {MENTIONS} SELECT least(a.entity, b.entity) AS e1, greatest(a.entity, b.entity) AS e2, count(*) AS weight FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.ord < b.ord GROUP BY 1, 2")
def mentions_pairs_multiset(spark, d):
    return cooccur.pair_weights(mentions(spark, d), multiset=True)


@query(f"WITH {MENTIONS}, {DOC}, {PAIRS}, {FREQ}, imp AS (SELECT entity FROM freq WHERE n_mentions >= 600) SELECT count(DISTINCT (e1, e2)) AS pairs_before, count(DISTINCT CASE WHEN e1 IN (FROM imp) AND e2 IN (FROM imp) THEN (e1, e2) END) AS pairs_after FROM pairs")
def mentions_pair_reduction(spark, d):
    return cooccur.pair_reduction(mentions(spark, d), 600)


@query(f"WITH {MENTIONS}, {SECTORS} SELECT entity, max_by(etype, (ts, doc_id, ord)) AS etype, any_value(sector) AS sector, count(*) AS mention_count FROM mentions JOIN sectors USING (entity) GROUP BY entity")
def sector_map(spark, d):
    return cooccur.sector_map(mentions(spark, d), sectors(spark, d))


KEYWORDS = [("metals", 0, "steel", "keyword"), ("metals", 0, "copper", "keyword"), ("metals", 0, "brass", "keyword"), ("finish", 1, "polished", "keyword"), ("finish", 1, "brushed", "keyword"), ("grade", 2, "economy", "org"), ("grade", 2, "standard", "org")]
KEYWORD_VALUES = ", ".join(f"('{s}', {r}, '{k}', '{t}')" for s, r, k, t in KEYWORDS)


@query(f"""WITH kw(sector, rank, keyword, kind) AS (VALUES {KEYWORD_VALUES}), ent AS (SELECT DISTINCT p_type AS entity FROM part),
  sc AS (SELECT entity, sector, rank, sum(CASE WHEN kind = 'org' THEN 1.5 ELSE 1.0 END) AS s FROM ent JOIN kw ON contains(lower(entity), keyword) GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s DESC, rank) AS r FROM sc)
  SELECT ent.entity, coalesce(sector, 'global_events') AS sector, CAST(CASE WHEN s IS NULL THEN 0.1 ELSE round(least(s / 5.0, 1.0), 3) END AS DOUBLE) AS confidence FROM ent LEFT JOIN b ON b.entity = ent.entity AND r = 1""")
def sector_classes(spark, d):
    keywords = spark.createDataFrame(KEYWORDS, "sector string, rank int, keyword string, kind string")
    names = read(spark, d, "part").select(F.col("p_type").alias("entity")).distinct().withColumn("etype", F.lit("orgs"))
    return cooccur.classify_sectors(names, keywords)


@query(f"""WITH kw(sector, rank, keyword, kind) AS (VALUES {KEYWORD_VALUES}), ent AS (SELECT DISTINCT p_brand AS entity FROM part), ctx AS (SELECT DISTINCT p_brand AS entity, lower(p_type) AS t FROM part WHERE p_size <= 10),
  sc AS (SELECT entity, sector, rank, 0.3 * count(DISTINCT keyword) AS s FROM ctx JOIN kw ON kind = 'keyword' AND contains(t, keyword) GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s DESC, rank) AS r FROM sc)
  SELECT ent.entity, coalesce(sector, 'global_events') AS sector, CAST(CASE WHEN s IS NULL THEN 0.1 ELSE round(least(s / 5.0, 1.0), 3) END AS DOUBLE) AS confidence FROM ent LEFT JOIN b ON b.entity = ent.entity AND r = 1""")
def sector_contexts(spark, d):
    keywords = spark.createDataFrame(KEYWORDS, "sector string, rank int, keyword string, kind string")
    parts = read(spark, d, "part")
    names = parts.select(F.col("p_brand").alias("entity")).distinct().withColumn("etype", F.lit("orgs"))
    return cooccur.classify_sectors(names, keywords, parts.where("p_size <= 10").select(F.col("p_brand").alias("entity"), F.col("p_type").alias("text")))


@query(f"WITH {LINKS} SELECT * FROM links")
def links_npmi(spark, d):
    return cooccur.sector_links(mentions(spark, d), sectors(spark, d))


@query(f"WITH {LINKS} SELECT * FROM links ORDER BY strength DESC, source_entity, target_entity LIMIT 200")
def links_top(spark, d):
    return cooccur.top_links(links_npmi(spark, d))


def calibrated(spark: SparkSession, d: str) -> DataFrame:
    return scoring.calibrate_links(links_npmi(spark, d))


@query(f"WITH {LINKS} SELECT source_entity, target_entity, confidence, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_label FROM lk")
def links_calibrated(spark, d):
    return calibrated(spark, d).select("source_entity", "target_entity", "confidence", "confidence_label")


REGIONS = [("AMERICA", "ASIA", 0.85, "short", "Trade shift"), ("EUROPE", "ASIA", 0.7, "medium", "Tariff change"), ("AFRICA", "EUROPE", 0.6, "long", "Supply change")]
REGION_VALUES = ", ".join(f"('{a}', '{b}', CAST({x} AS DOUBLE), '{t}', '{e}')" for a, b, x, t, e in REGIONS)


@query(f"""WITH {LINKS}, pat(p1, p2, l, t, e) AS (VALUES {REGION_VALUES}) SELECT source_entity, target_entity, coalesce(e, 'Cross-domain propagation') AS predicted_effect,
  round(coalesce(l * least(confidence * 1.2, 1.0), 0.5 * confidence), 3) AS likelihood, coalesce(t, 'medium') AS timeframe, round(CASE WHEN l IS NULL THEN 0.5 * confidence ELSE l * least(confidence * 1.2, 1.0) * confidence END, 3) AS confidence_weighted
  FROM lk LEFT JOIN pat ON (p1 = source_sector AND p2 = target_sector) OR (p2 = source_sector AND p1 = target_sector)""")
def links_impact(spark, d):
    patterns = spark.createDataFrame(REGIONS, "p1 string, p2 string, likelihood double, timeframe string, effect string")
    return scoring.predict_impact(calibrated(spark, d), patterns).select("source_entity", "target_entity", "impact.*")


@query(f"WITH {LINKS} SELECT source_entity, target_entity, strength FROM links l WHERE NOT EXISTS (SELECT 1 FROM links p WHERE p.source_entity = l.source_entity AND p.target_entity = l.target_entity AND p.strength < 0.4)")
def links_new(spark, d):
    links = links_npmi(spark, d)
    return cooccur.new_links(links, links.where("strength < 0.4")).select("source_entity", "target_entity", "strength")


@query(f"""WITH {LINKS}, top AS (SELECT * FROM links ORDER BY strength DESC, source_entity, target_entity LIMIT 200),
  c AS (SELECT source_entity, target_entity, a.doc_id, row_number() OVER (PARTITION BY source_entity, target_entity ORDER BY a.doc_id) AS rank FROM top JOIN doc a ON a.entity = source_entity JOIN doc b ON b.entity = target_entity AND a.doc_id = b.doc_id)
  SELECT source_entity, target_entity, CAST(rank AS INTEGER) AS rank, doc_id, substring(o_orderstatus || ' ' || o_orderpriority, 1, 12) AS context FROM c JOIN orders ON o_orderkey = doc_id WHERE rank <= 5""")
def links_context(spark, d):
    texts = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("text"))
    return cooccur.link_contexts(links_top(spark, d), mentions(spark, d), texts, chars=12)


WHY_REGIONS = [("AMERICA", "ASIA", "Orders of {a} move the prices of {b}."), ("EUROPE", "ASIA", "{a} ({s}) supplies {b} ({t})."), ("ASIA", "EUROPE", "{b} buys from {a}.")]
WHY_VALUES = ", ".join(f"('{a}', '{b}', '{t}')" for a, b, t in WHY_REGIONS)


def filled_sql(template: str) -> str:
    return f"replace(replace(replace(replace({template}, '{{a}}', source_entity), '{{b}}', target_entity), '{{s}}', source_sector), '{{t}}', target_sector)"


@query(f"""WITH {LINKS}, why(p1, p2, template) AS (VALUES {WHY_VALUES}), x AS (SELECT lk.*, least(strength * 10 + cooccurrence_count * 0.5 + source_diversity * 2, 100.0) AS s FROM lk),
  top AS (SELECT * FROM x ORDER BY strength DESC, source_entity, target_entity LIMIT 200), e AS (SELECT source_entity, target_entity, a.doc_id, row_number() OVER (PARTITION BY source_entity, target_entity ORDER BY a.doc_id) AS rank FROM top JOIN doc a ON a.entity = source_entity JOIN doc b ON b.entity = target_entity AND a.doc_id = b.doc_id),
  ex AS (SELECT source_entity, target_entity, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS examples FROM e WHERE rank <= 3 GROUP BY ALL)
  SELECT source_entity, target_entity, CAST(round(s, 2) AS DOUBLE) AS impact_score, CASE WHEN s >= 70 THEN 'high' WHEN s >= 40 THEN 'medium' ELSE 'low' END AS impact_level,
  source_entity || ' (' || source_sector || ') and ' || target_entity || ' (' || target_sector || ') appear together in ' || cooccurrence_count || ' documents from ' || source_diversity || ' sources' AS explanation,
  {filled_sql("coalesce(f.template, r.template, '" + scoring.WHY_OTHERWISE + "')")} AS why_connected, round(strength, 2) AS relationship_strength, confidence, examples
  FROM top LEFT JOIN why f ON f.p1 = source_sector AND f.p2 = target_sector LEFT JOIN why r ON r.p2 = source_sector AND r.p1 = target_sector JOIN ex USING (source_entity, target_entity)""")
def links_explained(spark, d):
    top = stored(cooccur.top_links(calibrated(spark, d)), "top")
    why = spark.createDataFrame(WHY_REGIONS, "p1 string, p2 string, template string")
    out = scoring.explain_links(top, why, cooccur.link_documents(top, mentions(spark, d), 3))
    return out.select("source_entity", "target_entity", "impact_score", "impact_level", "explanation", "why_connected", "evidence.relationship_strength", "evidence.confidence", F.array_join(F.col("evidence.examples").cast("array<string>"), ",").alias("examples"))


def order_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each order: that of its customer's number, in rounds of a hundred."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 100).alias("vec_id"))
    return o.join(read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id").select("doc_id", "embedding")


SEMANTIC = f"""{LINKS}, top AS (SELECT * FROM links ORDER BY strength DESC, source_entity, target_entity LIMIT 200), ld AS (SELECT source_entity, target_entity, a.doc_id, row_number() OVER (PARTITION BY source_entity, target_entity ORDER BY a.doc_id) AS rank FROM top JOIN doc a ON a.entity = source_entity JOIN doc b ON b.entity = target_entity AND a.doc_id = b.doc_id),
  lv AS (SELECT source_entity, target_entity, rank, embedding::DOUBLE[] AS v FROM ld JOIN orders ON o_orderkey = doc_id JOIN embeddings ON vec_id = o_custkey % 100 WHERE rank <= 20),
  sem AS (SELECT x.source_entity, x.target_entity, round(avg(list_cosine_similarity(x.v, y.v)), 3) AS m FROM lv x JOIN lv y ON x.source_entity = y.source_entity AND x.target_entity = y.target_entity AND x.rank < y.rank GROUP BY ALL)"""


@query(f"""WITH {SEMANTIC} SELECT source_entity, target_entity, coalesce(m, 0) AS semantic_similarity,
  round(greatest(0.05, least(0.99, (least(CAST(cooccurrence_count * 0.25 + source_diversity * 0.15 AS DOUBLE), 1.0::DOUBLE) * 0.35::DOUBLE + least(coalesce(m, 0) * 1.5, 1.0::DOUBLE) * 0.15::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE) / 0.7::DOUBLE)), 3) AS confidence
  FROM top LEFT JOIN sem USING (source_entity, target_entity)""")
def links_semantic(spark, d):
    """The strongest links with the likeness of their documents, and the confidence that this gives."""
    top = stored(links_top(spark, d), "top")
    return scoring.calibrate_links(cooccur.semantic_links(top, mentions(spark, d), order_vectors(spark, d))).select("source_entity", "target_entity", "semantic_similarity", "confidence")


@query(f"WITH {MENTIONS}, {SECTORS}, {DOC}, {PAIRS} SELECT e1, e2, count(*) AS weight, any_value(s1.sector) <> any_value(s2.sector) AS cross_domain FROM pairs JOIN sectors s1 ON s1.entity = e1 JOIN sectors s2 ON s2.entity = e2 GROUP BY e1, e2")
def pairs_flagged(spark, d):
    return cooccur.flagged_pairs(stored(cooccur.pair_weights(mentions(spark, d)), "pairs"), sectors(spark, d))


@query(f"WITH {LINKS} SELECT source_entity, target_entity, strength FROM links WHERE strength >= 0.41 ORDER BY strength DESC, source_entity, target_entity LIMIT 20")
def links_to_verify(spark, d):
    return scoring.verification_candidates(links_npmi(spark, d), 0.41).select("source_entity", "target_entity", "strength")


VERDICT = "CASE WHEN verified THEN {}::DOUBLE WHEN NOT verified THEN {}::DOUBLE END"


@query(f"""WITH {LINKS}, v AS (SELECT source_entity, target_entity, source_diversity = 5 AS verified FROM links WHERE cooccurrence_count >= 20)
  SELECT source_entity, target_entity, verified, round((least(CAST(cooccurrence_count * 0.25 + source_diversity * 0.15 AS DOUBLE), 1.0::DOUBLE) * 0.35 + 0.05 + 0.05 + coalesce({VERDICT.format('0.18', '0.09')}, 0)) / (0.7 + coalesce({VERDICT.format('0.2', '0.1')}, 0)), 3) AS confidence
  FROM links LEFT JOIN v USING (source_entity, target_entity)""")
def links_verified(spark, d):
    return judged(spark, d).select("source_entity", "target_entity", "verified", "confidence")


def verdicts_of(links: DataFrame) -> DataFrame:
    """Verdicts as a caller would bring them: on frequent links, true where five sources agree."""
    return links.where("cooccurrence_count >= 20").select("source_entity", "target_entity", (F.col("source_diversity") == 5).alias("verified"), F.lit(0.9).alias("verdict_confidence"))


@query(f"WITH {LINKS} SELECT source_entity, target_entity, strength FROM links WHERE (contains(lower(source_entity), '0001') OR contains(lower(target_entity), '0001')) AND (source_sector = 'ASIA' OR target_sector = 'ASIA')")
def explorer_search(spark, d):
    return scoring.search_links(links_npmi(spark, d), "0001", ["ASIA"]).select("source_entity", "target_entity", "strength")


# ---- graphs

GRAPH = f"{MENTIONS}, {DOC}, {FREQ}, imp AS (SELECT * FROM freq WHERE n_mentions >= 2), {PAIRS}, g AS (SELECT e1, e2, count(*) AS weight FROM pairs WHERE e1 IN (SELECT entity FROM imp) AND e2 IN (SELECT entity FROM imp) GROUP BY e1, e2 HAVING count(*) >= 2 ORDER BY weight DESC, e1, e2 LIMIT 200)"


@query(f"WITH {GRAPH} SELECT * FROM g")
def entity_graph(spark, d):
    return graph.entity_graph(mentions(spark, d))


@query(f"WITH {GRAPH}, deg AS (SELECT entity, count(*) AS degree FROM (SELECT e1 AS entity FROM g UNION ALL SELECT e2 FROM g) GROUP BY entity) SELECT entity, n_mentions, n_sources, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) / ((SELECT count(*) FROM imp) - 1), 4) AS centrality FROM imp LEFT JOIN deg USING (entity)")
def entity_graph_centrality(spark, d):
    m = mentions(spark, d)
    return graph.degree_centrality(graph.entity_graph(m), cooccur.important_entities(m))


@query(f"WITH {LINKS} SELECT least(source_sector, target_sector) AS sector_1, greatest(source_sector, target_sector) AS sector_2, count(*) AS n_links, CAST(sum(cooccurrence_count) AS BIGINT) AS cooccurrences, round(avg(strength), 4) AS mean_strength, round(avg(confidence), 4) AS mean_confidence FROM lk GROUP BY 1, 2")
def sector_graph(spark, d):
    return graph.sector_graph(calibrated(spark, d))


LAGS = f"""{LINKS}, lp AS (SELECT source_entity AS e1, target_entity AS e2 FROM (SELECT * FROM links ORDER BY strength DESC, source_entity, target_entity LIMIT 200)), dated AS (SELECT DISTINCT entity, doc_id, ts FROM mentions),
  k AS (SELECT entity, count(*) AS k FROM dated GROUP BY entity),
  sm AS (SELECT e1, e2, epoch_us(b.ts) - epoch_us(a.ts) AS g FROM lp JOIN dated a ON a.entity = e1 JOIN dated b ON b.entity = e2),
  st AS (SELECT e1, e2, count(*) FILTER (g BETWEEN 21600000000 AND 1209600000000) AS n1, count(*) FILTER (-g BETWEEN 21600000000 AND 1209600000000) AS n2,
    avg(g / 3600000000) FILTER (g BETWEEN 21600000000 AND 1209600000000) AS l1, avg(-g / 3600000000) FILTER (-g BETWEEN 21600000000 AND 1209600000000) AS l2 FROM sm GROUP BY e1, e2),
  cand AS (SELECT CASE WHEN n1 > 2 * n2 THEN e1 ELSE e2 END AS source, CASE WHEN n1 > 2 * n2 THEN e2 ELSE e1 END AS target, round(CASE WHEN n1 > 2 * n2 THEN l1 ELSE l2 END, 1) AS mean_lag_hours, greatest(n1, n2) AS lag_samples,
    CAST(round(least(greatest(n1, n2) / (k1.k + k2.k) * 0.5 + 0.3, 1.0), 3) AS DOUBLE) AS causal_score, k1.k + k2.k AS evidence_strength
    FROM st JOIN k k1 ON k1.entity = e1 JOIN k k2 ON k2.entity = e2 WHERE k1.k >= 2 AND k2.k >= 2 AND greatest(n1, n2) >= 2 AND (n1 > 2 * n2 OR n2 > 2 * n1))"""


def lagged(spark: SparkSession, d: str) -> DataFrame:
    pairs = links_top(spark, d).select(F.col("source_entity").alias("e1"), F.col("target_entity").alias("e2"))
    return lag.lag_candidates(mentions(spark, d), pairs)


@query(f"WITH {LAGS} SELECT * FROM cand")
def lag_candidates(spark, d):
    return lagged(spark, d)


@query(f"WITH {LAGS} SELECT e1, e2, n1 AS ahead, n2 AS behind FROM st WHERE n1 + n2 > 0")
def lag_samples(spark, d):
    pairs = links_top(spark, d).select(F.col("source_entity").alias("e1"), F.col("target_entity").alias("e2"))
    return lag.lag_samples(mentions(spark, d), pairs).groupBy("e1", "e2").agg(F.count_if("ahead").alias("ahead"), F.count_if(~F.col("ahead")).alias("behind"))


# Directed edges for the path operators: trade between suppliers of different regions, by share.
EDGES = f"{LINKS}, ed AS (SELECT source_entity AS source, target_entity AS target, strength AS causal_score, CAST(cooccurrence_count AS DOUBLE) AS mean_lag_hours FROM links WHERE strength >= 0.415)"


def directed(spark: SparkSession, d: str) -> DataFrame:
    strong = links_npmi(spark, d).where("strength >= 0.415")
    return strong.select(F.col("source_entity").alias("source"), F.col("target_entity").alias("target"), F.col("strength").alias("causal_score"), F.col("cooccurrence_count").cast("double").alias("mean_lag_hours"))


PATTERNS = [("AMERICA", "ASIA", "policy_shock"), ("ASIA", "AMERICA", "demand_shock"), ("EUROPE", "AFRICA", "capital_flow")]
PATTERN_VALUES = ", ".join(f"('{a}', '{b}', '{p}')" for a, b, p in PATTERNS)
CGRAPH = f"""{EDGES}, pat(p1, p2, pattern) AS (VALUES {PATTERN_VALUES}), cg AS (SELECT source, target, causal_score AS weight, coalesce(a.pattern, b.pattern, 'general') AS pattern, mean_lag_hours FROM ed JOIN sectors s ON s.entity = source JOIN sectors t ON t.entity = target
  LEFT JOIN pat a ON a.p1 = s.sector AND a.p2 = t.sector LEFT JOIN pat b ON b.p2 = s.sector AND b.p1 = t.sector),
  pure AS (SELECT DISTINCT source AS node FROM cg WHERE source NOT IN (SELECT target FROM cg)),
  rt AS (SELECT node FROM (SELECT node FROM pure UNION ALL (SELECT node FROM (SELECT source AS node FROM cg UNION SELECT target FROM cg) WHERE NOT EXISTS (FROM pure) ORDER BY node LIMIT 10)) ORDER BY node LIMIT 20)"""


def causal(spark: SparkSession, d: str) -> DataFrame:
    patterns = spark.createDataFrame(PATTERNS, "p1 string, p2 string, pattern string")
    return graph.candidate_graph(directed(spark, d), sectors(spark, d), patterns)


@query(f"WITH {CGRAPH} SELECT * FROM cg")
def causal_edges(spark, d):
    return causal(spark, d)


@query(f"WITH {CGRAPH} SELECT node FROM rt")
def causal_roots(spark, d):
    return graph.roots(stored(causal(spark, d), "causal"))


@query(f"WITH {CGRAPH} SELECT (SELECT count(*) FROM (SELECT source FROM cg UNION SELECT target FROM cg)) AS n_nodes, count(*) AS n_edges, round(coalesce(avg(weight), 0), 3) AS mean_score FROM cg")
def causal_summary(spark, d):
    return graph.graph_summary(stored(causal(spark, d), "causal"))


@query(f"WITH {CGRAPH}, n AS (SELECT source AS node, 1 AS o, weight FROM cg UNION ALL SELECT target, 0, weight FROM cg) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(1 - o) AS BIGINT) AS in_degree, round(avg(weight), 3) AS score FROM n GROUP BY node")
def causal_nodes(spark, d):
    return graph.node_list(causal(spark, d))


@query(f"""WITH RECURSIVE {CGRAPH}, walk AS (SELECT node AS root, node, [node] AS path, CAST(0 AS DOUBLE) AS total, CAST([] AS VARCHAR[]) AS patterns FROM rt
    UNION ALL SELECT root, target, list_append(path, target), total + weight, list_append(patterns, pattern) FROM walk JOIN cg ON source = node WHERE len(path) <= 5 AND NOT list_contains(path, target)),
  best AS (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY len(path), path) AS r FROM walk)
  SELECT root, node, array_to_string(path, '->') AS chain, len(path) AS length, round(total / (len(path) - 1), 3) AS avg_score, array_to_string(patterns, ',') AS patterns FROM best WHERE r = 1 AND len(path) >= 3""")
def causal_chains(spark, d):
    e = stored(causal(spark, d), "causal")
    return graph.shortest_chains(e, graph.roots(e))


def _twice(a: str, b: str) -> str:
    """Cheapest ways (root, node, {d, h}) made of two ways of table a."""
    return f"{b} AS (SELECT x.root, y.node, min({{'d': x.k.d + y.k.d, 'h': x.k.h + y.k.h}}) AS k FROM {a} x JOIN {a} y ON x.node = y.root GROUP BY ALL)"


#: Up to 16 hops by doubling; the steps of a path are found by its costs.
CHAINS = f"""{MENTIONS}, {SECTORS}, {DOC}, {PAIRS}, g AS (SELECT e1, e2, count(*) AS weight FROM pairs GROUP BY e1, e2), b AS (SELECT e1 AS u, e2 AS v, CAST(weight AS DOUBLE) AS c FROM g UNION ALL SELECT e2, e1, CAST(weight AS DOUBLE) FROM g),
  d0 AS (SELECT u AS root, v AS node, {{'d': c, 'h': 1}} AS k FROM b UNION ALL SELECT DISTINCT u, u, {{'d': CAST(0 AS DOUBLE), 'h': 0}} FROM b), {_twice('d0', 'd1')}, {_twice('d1', 'd2')}, {_twice('d2', 'd3')}, {_twice('d3', 'ways')},
  lead AS (SELECT entity, sector FROM (SELECT entity, sector, row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, entity) AS r FROM mentions JOIN sectors USING (entity) GROUP BY entity, sector) WHERE r <= 5),
  prev AS (SELECT w.root, w.node, min(b.u) AS prev FROM ways w JOIN b ON b.v = w.node JOIN ways p ON p.root = w.root AND p.node = b.u WHERE w.root IN (SELECT entity FROM lead) AND p.k.d + b.c = w.k.d AND p.k.h + 1 = w.k.h GROUP BY ALL),
  mine AS (SELECT w.root, w.node, w.k.d AS dist, w.k.h AS h FROM ways w JOIN lead s ON s.entity = w.root JOIN lead e ON e.entity = w.node WHERE s.sector < e.sector AND w.k.h BETWEEN 2 AND 3),
  path AS (SELECT m.*, CASE WHEN h = 2 THEN [m.root, p.prev, m.node] ELSE [m.root, q.prev, p.prev, m.node] END AS path FROM mine m JOIN prev p ON p.root = m.root AND p.node = m.node JOIN prev q ON q.root = m.root AND q.node = p.prev),"""


@query(f"""WITH {CHAINS} named AS (SELECT root, node, dist, path, unnest(path) AS entity, generate_subscripts(path, 1) AS i FROM path), line AS (SELECT dist, path, list(sector ORDER BY i) AS s FROM named JOIN sectors USING (entity) GROUP BY root, node, dist, path),
  keyed AS (SELECT array_to_string(s, '->') AS chain_key, array_to_string(path, '->') AS chain, CAST(len(list_filter(list_zip(s[:-2], s[2:]), lambda x: x[1] <> x[2])) AS BIGINT) AS hops, dist AS total_weight FROM line),
  r AS (SELECT *, row_number() OVER (PARTITION BY chain_key ORDER BY hops DESC, total_weight DESC, chain) AS r FROM keyed) SELECT chain_key, chain, hops, total_weight FROM r WHERE r = 1 ORDER BY hops DESC, total_weight DESC, chain_key LIMIT 50""")
def impact_chains(spark, d):
    m, s = mentions(spark, d), sectors(spark, d)
    return graph.impact_chains(stored(cooccur.pair_weights(m), "pairs"), s, cooccur.sector_map(m, s))


@query(f"""WITH {GRAPH}, b AS (SELECT e1 AS u, e2 AS v, weight AS w FROM g UNION ALL SELECT e2, e1, weight FROM g), c AS (SELECT u FROM b GROUP BY u ORDER BY count(*) DESC, u LIMIT 1),
  p AS (SELECT v AS hop_1, CAST(NULL AS VARCHAR) AS hop_2, w AS weight_1, CAST(NULL AS BIGINT) AS weight_2 FROM b WHERE u = (FROM c) UNION ALL SELECT x.v, y.v, x.w, y.w FROM b x JOIN b y ON x.v = y.u WHERE x.u = (FROM c) AND y.v <> (FROM c))
  SELECT * FROM p ORDER BY hop_1, hop_2 NULLS FIRST LIMIT 100""")
def khop(spark, d):
    edges = stored(graph.entity_graph(mentions(spark, d)), "graph")
    center = edges.select(F.explode(F.array("e1", "e2")).alias("u")).groupBy("u").count().orderBy(F.desc("count"), "u").first()
    return graph.neighbourhood(edges, center.u if center else "")


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def graph_upsert(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return graph.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def table_upsert(spark, d):
    """The same upsert into a table on disk, in three merges that rewrite the buckets they touch."""
    path = f"{folder(spark)}/keyed-{uuid.uuid4().hex}"
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    keyed.create(spark, path)
    for i in (2, 0, 1):
        keyed.merge(spark, path, o.where(f"o_orderkey % 3 = {i}"), ["o_custkey"], "o_orderkey", 16)
    return keyed.read(spark, path, "o_custkey long, o_orderkey long, o_orderstatus string, o_orderdate " + dict(o.dtypes)["o_orderdate"])


# ---- time series

@query(f"WITH {EVENTS}, {DAILY} SELECT * FROM daily")
def daily_counts(spark, d):
    return trends.daily_counts(event_mentions(spark, d))


def events_daily(spark: SparkSession, d: str) -> DataFrame:
    return trends.daily_counts(event_mentions(spark, d))


@query(f"WITH {VELOCITY} SELECT * FROM velocity")
def velocity(spark, d):
    return trends.velocity(events_daily(spark, d))


@query(f"WITH {VELOCITY} SELECT count(*) AS entities, count(*) FILTER (trend = 'accelerating') AS accelerating, count(*) FILTER (trend = 'decelerating') AS decelerating, max(velocity) AS max_velocity, min(velocity) AS min_velocity FROM velocity")
def velocity_summary(spark, d):
    return trends.velocity_summary(velocity(spark, d))


@query(f"WITH {VELOCITY}, m AS (SELECT count(*) AS k, avg(acceleration) AS mean, stddev_pop(acceleration) AS sd FROM velocity) SELECT velocity.*, round((acceleration - mean) / sd, 2) AS z_score, CASE WHEN acceleration > mean THEN 'spike' ELSE 'drop' END AS anomaly_type FROM velocity, m WHERE k >= 5 AND sd > 0 AND abs((acceleration - mean) / sd) >= 2")
def velocity_anomaly(spark, d):
    return trends.velocity_anomalies(velocity(spark, d))


@query(f"WITH {BURSTS} SELECT * FROM bursts")
def bursts(spark, d):
    return trends.bursts(events_daily(spark, d))


@query(f"WITH {EVENTS}, {DAILY}, {BACK}, {phases_sql('bk', 'entity')} SELECT entity, points, phase FROM phases")
def phases(spark, d):
    return trends.phases(events_daily(spark, d))


@query(f"WITH {NARR} SELECT * FROM narr")
def entity_narratives(spark, d):
    return trends.narratives(events_daily(spark, d))


@query(f"WITH {TRANSITIONS} SELECT * FROM transitions")
def phase_transitions(spark, d):
    daily = events_daily(spark, d)
    return trends.phase_transitions(trends.velocity(daily), trends.phases(daily).select("entity", "phase"))


@query(f"WITH {EVENTS}, {DAILY}, l AS (SELECT max(day) AS last FROM daily), s AS (SELECT entity, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN day > last - 7 THEN n ELSE 0 END) AS BIGINT) AS recent, arg_max(day, (n, -date_diff('day', DATE '1970-01-01', day))) AS peak_day FROM daily, l GROUP BY entity) SELECT *, 2 * recent - total AS momentum FROM s")
def entity_trends(spark, d):
    return trends.entity_trends(events_daily(spark, d))


@query(f"WITH {NARR} SELECT phase, count(*) AS n, CAST(sum(total_mentions) AS BIGINT) AS mentions FROM narr GROUP BY phase")
def narrative_summary(spark, d):
    return N.narrative_summary(entity_narratives(spark, d))


@query(f"WITH {NARR} SELECT entity, round(greatest(0.1::DOUBLE, least(0.98::DOUBLE, (CASE phase WHEN 'emerging' THEN 0.3 WHEN 'accelerating' THEN 0.6 WHEN 'growing' THEN 0.7 WHEN 'peaked' THEN 0.8 WHEN 'declining' THEN 0.6 WHEN 'fading' THEN 0.4 WHEN 'resurging' THEN 0.5 WHEN 'stable' THEN 0.5 WHEN 'dormant' THEN 0.2 ELSE 0.4 END)::DOUBLE * 0.5::DOUBLE + least(abs(acceleration) * 0.3::DOUBLE + total_mentions * 0.05::DOUBLE + recent_7_days * 0.1::DOUBLE, 1.0) * 0.5::DOUBLE)), 3) AS confidence FROM narr")
def narrative_confidence(spark, d):
    return scoring.calibrate_narratives(entity_narratives(spark, d)).select("entity", "confidence")


# ---- signals and alerts

SPIKE_ROWS = "e0 AS (SELECT *, epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM mentions) - 172800000000 AS rec FROM mentions)"
E_SPIKES = f"""{EVENTS}, {SPIKE_ROWS}, ec AS (SELECT entity, count(*) FILTER (rec) AS n, count(*) FILTER (NOT rec) AS old FROM e0 GROUP BY entity), et AS (SELECT greatest(sum(old), 1) AS t FROM ec), er AS (SELECT count(DISTINCT doc_id) AS r FROM e0 WHERE rec),
  es AS (SELECT entity, n, n / greatest(old / t * r, 0.001) AS b FROM ec, et, er WHERE n >= 2)"""


@query(f"WITH {E_SPIKES} SELECT 'anomaly' AS type, entity, round(b, 1) AS burst_factor, n AS recent_count, round(n * b, 1) AS score FROM es WHERE b > 1.5")
def entity_spike(spark, d):
    return signals.entity_spikes(event_mentions(spark, d), min_burst=1.5)


K_SPIKES = f"""{ARTICLES}, a0 AS (SELECT *, epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM articles) - 172800000000 AS rec FROM articles), kr AS (SELECT count(*) FILTER (rec) AS r FROM a0),
  kw AS (SELECT rec, trim(unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+')), '.,!?"''():;[]{{}}') AS keyword FROM a0),
  kc AS (SELECT keyword, count(*) FILTER (rec) AS n, count(*) FILTER (NOT rec) AS old FROM kw WHERE length(keyword) > 3 AND NOT regexp_full_match(keyword, '[0-9]+') AND NOT starts_with(keyword, 'http') AND NOT starts_with(keyword, 'www')
    AND keyword NOT IN ({', '.join(f"'{w}'" for w in signals.STOP_WORDS)}) GROUP BY keyword), kt AS (SELECT greatest(sum(old), 1) AS t FROM kc),
  kl AS (SELECT *, (n / greatest(r, 1)) / greatest(old / t, 0.0001) AS b FROM (SELECT * FROM kc WHERE n > 0 ORDER BY n DESC, keyword LIMIT 100), kt, kr WHERE r >= 5)"""


@query(f"WITH {K_SPIKES} SELECT 'cross_domain_spillover' AS type, keyword, round(b, 1) AS burst_factor, n AS recent_count, round(n * b, 1) AS score FROM kl WHERE b > 5 AND n >= 5")
def keyword_spike(spark, d):
    return signals.keyword_spikes(articles(spark, d))


@query(f"WITH {LINKS}, fp AS (SELECT e1, e2, min(doc_id) AS first_doc FROM pairs GROUP BY e1, e2) SELECT 'emerging_relationship' AS type, e1 AS entity_a, e2 AS entity_b, first_doc, 0.7::DOUBLE AS score, 0.5::DOUBLE AS confidence FROM fp WHERE NOT EXISTS (SELECT 1 FROM links WHERE source_entity = e1 AND target_entity = e2) ORDER BY first_doc, e1, e2 LIMIT 20")
def new_pairs(spark, d):
    return signals.new_pair_signals(cooccur.entity_pairs(mentions(spark, d)), links_npmi(spark, d))


@query(f"""WITH {E_SPIKES}, x AS (SELECT 'anomaly' AS type, 'entity ' || entity AS signal, round(n * b, 1) AS score FROM es WHERE b > 1.2 UNION ALL SELECT 'volume', 'entity ' || entity, CAST(n AS DOUBLE) FROM es WHERE n >= 30),
  y AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score DESC, type) AS r FROM x) SELECT type, signal, score FROM y WHERE r = 1 ORDER BY score DESC, signal LIMIT 20""")
def signals_ranked(spark, d):
    text = F.concat(F.lit("entity "), "entity").alias("signal")
    a = signals.entity_spikes(event_mentions(spark, d), min_burst=1.2).select("type", text, "score")
    b = signals.entity_spikes(event_mentions(spark, d), min_count=30, min_burst=-1.0).select(F.lit("volume").alias("type"), text, F.col("recent_count").cast("double").alias("score"))
    return signals.rank_signals(a, b)


@query(f"WITH {VELOCITY} SELECT 'trend' AS dimension, trend AS value, count(*) AS n FROM velocity GROUP BY trend UNION ALL SELECT 'unique_days', CAST(unique_days AS VARCHAR), count(*) FROM velocity GROUP BY unique_days")
def signal_counts(spark, d):
    return signals.count_by(velocity(spark, d), "trend", "unique_days")


@query(f"WITH {LINKS} SELECT 'high_confidence_relationship' AS type, 'high' AS severity, source_entity || ' <-> ' || target_entity AS title, confidence AS value FROM lk WHERE confidence >= 0.8 AND NOT (strength < 0.4)")
def alerts_relationships(spark, d):
    links = calibrated(spark, d)
    return signals.relationship_alerts(links, links.where("strength < 0.4"))


@query(f"""WITH v AS (SELECT * FROM ({ORACLES['links_verified']}) q), {LINKS} SELECT 'high_confidence_relationship' AS type, 'high' AS severity, source_entity || ' <-> ' || target_entity AS title, v.confidence AS value FROM v JOIN links l USING (source_entity, target_entity) WHERE v.confidence >= 0.8 AND NOT (l.strength < 0.4)
  UNION ALL SELECT 'verified_relationship', 'medium', source_entity || ' <-> ' || target_entity, v.confidence FROM v JOIN links l USING (source_entity, target_entity) WHERE v.confidence >= 0.7 AND v.verified AND NOT (l.strength < 0.4)""")
def alerts_verified(spark, d):
    links = stored(judged(spark, d), "links")
    return signals.relationship_alerts(links, links.where("strength < 0.4"))


@query(f"WITH {VELOCITY} SELECT 'velocity_spike' AS type, 'high' AS severity, entity AS title, acceleration AS value FROM velocity WHERE abs(acceleration) > 0.2 AND abs(velocity) > 0.5")
def alerts_velocity(spark, d):
    return signals.velocity_alerts(velocity(spark, d), 0.2, 0.5)


@query(f"WITH {BURSTS} SELECT 'citation_burst' AS type, 'high' AS severity, entity || ' ' || day AS title, burst_factor AS value FROM bursts WHERE burst_factor >= 3")
def alerts_bursts(spark, d):
    return signals.burst_alerts(bursts(spark, d))


@query(f"WITH {TRANSITIONS} SELECT 'phase_transition' AS type, 'medium' AS severity, entity || ': ' || current_phase || ' -> ' || predicted_phase AS title, confidence AS value FROM transitions WHERE confidence >= 0.5")
def alerts_phases(spark, d):
    return signals.phase_alerts(phase_transitions(spark, d), 0.5)


@query(f"WITH {BURSTS}, z AS (SELECT 'citation_burst' AS type, 'high' AS severity, entity || ' ' || day AS title, burst_factor AS value FROM bursts WHERE burst_factor >= 3) SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM z GROUP BY severity UNION ALL SELECT 'type', type, count(*) FROM z GROUP BY type")
def alerts_summary(spark, d):
    return signals.count_by(signals.all_alerts(signals.burst_alerts(bursts(spark, d)), signals.velocity_alerts(velocity(spark, d), 90.0)), "severity", "type")


# ---- texts

@query(None)
def clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


BAD_LINES = "|".join(f"(?:{p})" for p in T.BOILERPLATE).replace("'", "''")


@query(f"SELECT doc_id, coalesce(string_agg(l, ' ' ORDER BY i) FILTER (length(l) >= 15 AND NOT regexp_matches(lower(l), '{BAD_LINES}')), '') AS text FROM (SELECT doc_id, unnest(range(len(ls))) AS i, trim(unnest(ls)) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) GROUP BY doc_id")
def boilerplate(spark, d):
    return read(spark, d, "documents").select("doc_id", T.remove_boilerplate(F.col("text")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(split_part(text, chr(10), 1)), '\s*\|.*$', ''), '\s*-.*$', ''), '\s*–.*$', ''), '\s*:.*$', ''), '\s*«.*$', '')) AS title FROM documents")
def headline(spark, d):
    return articles(spark, d).select("doc_id", T.headline(F.col("title")).alias("title"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(trim(url), '/+$', '')), '([?&])(utm_[a-z]+|ref|source|fbclid)=[^&#]*', '\1', 'g'), '&{2,}', '&', 'g'), '\?&+', '?', 'g'), '^https?://www\.', 'https://'), '[?&]+$', ''), 'NEVER', '') AS url FROM pages")
def canonical_url(spark, d):
    return read(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query(None)
def title_norm(spark, d):
    return articles(spark, d).select("doc_id", T.normal_title(F.col("title")).alias("title"))


@query(r"SELECT doc_id, md5(coalesce((SELECT string_agg(w, ' ' ORDER BY w) FROM (SELECT DISTINCT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+')) AS w) WHERE w <> ''), '')) AS hash FROM documents")
def fuzzy_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", T.fuzzy_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, CAST(count(DISTINCT s) AS INTEGER) AS n FROM (SELECT doc_id, t, substring(t, i, 5) AS s FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 3, 1))) AS i FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents))) GROUP BY doc_id HAVING count(*) > 0")
def shingles(spark, d):
    return articles(spark, d).select("doc_id", F.size(T.shingles(F.col("title"))).alias("n")).where("n > 0")


SENSE = ", ".join(f"'{w}'" for w in T.SENSATIONAL)


@query(rf"SELECT doc_id, coalesce(round(count(DISTINCT w) FILTER (w IN ({SENSE}, 'the', 'les')) / count(DISTINCT w), 4), 0) AS score FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS w FROM documents) GROUP BY doc_id")
def sensationalism(spark, d):
    return read(spark, d, "documents").select("doc_id", T.sensationalism(F.col("text"), [*T.SENSATIONAL, "the", "les"]).alias("score")).where(F.size(F.regexp_extract_all(F.col("text"), F.lit(r"(?U)(\w+)"), 1)) > 0)


LEXICON = [("the", 0.5), ("and", -0.25), ("idiot", -3.0), ("stupid", -2.5), ("worthless", -2.0), ("que", 0.25), ("die", -0.5), ("la", 1.0)]


@query(rf"""WITH lx(word, weight) AS (VALUES {', '.join(f"('{w}', {x}::DOUBLE)" for w, x in LEXICON)}), w AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g'), '\s+')) AS word FROM documents),
  s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (weight > 0) AS p, count(*) FILTER (weight < 0) AS m, coalesce(sum(weight), 0) AS x FROM w LEFT JOIN lx USING (word) WHERE word <> '' GROUP BY doc_id)
  SELECT doc_id, round(p / n, 4) AS pos, round(m / n, 4) AS neg, round(1 - (p + m) / n, 4) AS neu, round(x / sqrt(x * x + 15.0), 4) AS compound, CASE WHEN round(x / sqrt(x * x + 15.0), 4) >= 0.35 THEN 'positive' WHEN round(x / sqrt(x * x + 15.0), 4) <= -0.35 THEN 'negative' ELSE 'neutral' END AS label FROM s""")
def sentiment(spark, d):
    lexicon = spark.createDataFrame(LEXICON, "word string, weight double")
    return T.sentiment(read(spark, d, "documents"), lexicon).withColumn("label", T.sentiment_label(F.col("compound")))


@query(None)
def summary(spark, d):
    return T.summary(read(spark, d, "documents"))


@query(None)
def name_mentions(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(T.names_in(F.col("text"), ["The", "And"])).alias("name"))


GAZETTEER = [("the", "orgs"), ("ation", "orgs"), ("keit", "locations"), ("ción", "locations"), ("eau", "orgs")]


@query(f"""WITH gz(name, etype) AS (VALUES {', '.join(str(g) for g in GAZETTEER)}), h AS (SELECT DISTINCT doc_id, etype, name FROM documents JOIN gz ON contains(lower(text), name)) SELECT doc_id, etype, name FROM h""")
def gazetteer(spark, d):
    return T.gazetteer(read(spark, d, "documents"), spark.createDataFrame(GAZETTEER, "name string, etype string"))


@query(f"""WITH {ARTICLES} SELECT lang, source, count(*) AS n FROM articles WHERE length(title || '. ' || text) > 20 GROUP BY lang, source""")
def composed(spark, d):
    return articles(spark, d).where(F.length(T.compose(F.col("title"), F.col("text"))) > 20).groupBy("lang", "source").agg(F.count("*").alias("n"))


LANGS = [("en", "English"), ("fr", "French"), ("de", "German"), ("hi", "Hindi")]


@query(f"""WITH ln(lang, name) AS (VALUES {', '.join(str(x) for x in LANGS)}) SELECT lang, coalesce(name, lang) AS name, count(*) AS n, count(*) FILTER (lang <> 'en') AS non_english FROM documents LEFT JOIN ln USING (lang) GROUP BY 1, 2""")
def language_names(spark, d):
    names = spark.createDataFrame(LANGS, "lang string, name string")
    j = read(spark, d, "documents").select("lang").join(side(names), "lang", "left")
    return j.groupBy("lang", F.coalesce("name", "lang").alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("lang") != "en").alias("non_english"))


# ---- dedup

@query(f"WITH {ARTICLES} SELECT doc_id, title FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS r FROM articles) WHERE r = 1")
def dedup_exact(spark, d):
    return dedup.dedup_exact(articles(spark, d).select("doc_id", "title"))


@query(r"WITH h AS (SELECT doc_id, coalesce((SELECT string_agg(w, ' ' ORDER BY w) FROM (SELECT DISTINCT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+')) AS w) WHERE w <> ''), '') AS k FROM documents) SELECT min(doc_id) AS doc_id FROM h GROUP BY k")
def dedup_fuzzy(spark, d):
    return dedup.dedup_fuzzy(read(spark, d, "documents"), "text").select("doc_id")


J_PAIRS = """t AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS t FROM documents), s0 AS (SELECT DISTINCT doc_id, substring(t, i, 5) AS s FROM (SELECT doc_id, t, unnest(range(1, length(t) - 3)) AS i FROM t WHERE length(t) >= 5)),
  k AS (SELECT doc_id, string_agg(s, '|' ORDER BY s) AS k, count(*) AS n FROM s0 GROUP BY doc_id), u AS (SELECT min(doc_id) AS doc_id, any_value(n) AS n FROM k GROUP BY k), s1 AS (SELECT s0.*, n FROM s0 JOIN u USING (doc_id)),
  jp AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS similarity FROM s1 x JOIN s1 y ON x.s = y.s AND x.doc_id < y.doc_id AND x.n >= 0.85 * y.n AND y.n >= 0.85 * x.n GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.85)"""


@query(f"WITH {J_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM jp")
def dedup_pairs(spark, d):
    return dedup.similar_pairs(articles(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(None)
def dedup_minhash(spark, d):
    return dedup.dedup_similar(articles(spark, d).select("doc_id", "title"))


@query(None)
def dup_groups(spark, d):
    """Each row that dedup_minhash drops with the smallest kept row similar to it."""
    a = articles(spark, d)
    return dedup.duplicate_groups(stored(dedup.similar_pairs(a), "pairs"), dedup.set_copies(a))


@query(None)
def dedup_tfidf(spark, d):
    return dedup.tfidf_pairs(dedup.tfidf(articles(spark, d), "title")).withColumn("similarity", F.round("similarity", 6))


@query(None)
def dedup_tfidf_kept(spark, d):
    """Rows that keep-first leaves by TF-IDF similarity."""
    a = articles(spark, d)
    gone = dedup.tfidf_drops(dedup.tfidf(a, "title"))
    return a.join(gone.withColumnRenamed("x", "doc_id").hint("shuffle_merge"), "doc_id", "left_anti").select("doc_id", "title")


@query("SELECT count(*) AS n_before, (SELECT count(*) FROM (SELECT DISTINCT split_part(text, chr(10), 1) FROM documents)) AS n_exact FROM documents")
def dedup_report(spark, d):
    """Rows before and after the exact step; n_after, of the similarity step, has its test by brute force."""
    return dedup.dedup_step(articles(spark, d).select("doc_id", "title"))[1].select("n_before", "n_exact")


@query(r"""WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents), m AS (SELECT *, regexp_extract(t, '^([A-Za-z\s&][a-z\s&]*)[A-Z0-9]', 1) AS f FROM t), c AS (SELECT *, trim(f) AS c, trim(substring(t, length(trim(f)) + 1)) AS r FROM m)
  SELECT doc_id, CASE WHEN f <> '' AND r <> '' THEN c END AS category, CASE WHEN f <> '' AND r <> '' THEN r ELSE coalesce(t, '') END AS rest FROM c""")
def title_category(spark, d):
    return articles(spark, d).select("doc_id", T.category(F.col("title")).alias("x")).select("doc_id", "x.category", "x.rest")


# ---- ingest

@query(r"""WITH c AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<article\b[^>]*>(.*?)</article>', 1)) AS c FROM pages),
  t AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS source, trim(regexp_replace(regexp_replace(regexp_extract(c, '(?s)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS h, trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS w FROM c),
  n AS (SELECT page_id, source, CASE WHEN length(h) >= 16 THEN h WHEN length(w) >= 21 THEN w END AS title FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY source, lower(title) ORDER BY page_id) AS r FROM n WHERE title IS NOT NULL) SELECT page_id, source, title FROM r WHERE r = 1""")
def page_cards(spark, d):
    return ingest.page_cards(read(spark, d, "pages"), title=("h1",)).select("page_id", "source", "title")


@query(r"""WITH p AS (SELECT page_id, unnest(range(len(x))) AS i, trim(regexp_replace(regexp_replace(unnest(x), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p\b[^>]*>(.*?)</p>', 1) AS x FROM pages)),
  q AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS r FROM p WHERE length(t) >= 31) SELECT pages.page_id, coalesce(string_agg(t, ' ' ORDER BY i), '') AS body FROM pages LEFT JOIN q ON q.page_id = pages.page_id AND r <= 30 GROUP BY pages.page_id""")
def page_body(spark, d):
    return read(spark, d, "pages").select("page_id", ingest.page_body(F.col("html")).alias("body"))


@query(None)
def feed_entries(spark, d):
    docs = read(spark, d, "documents").select("source", F.col("lang").alias("country"), "doc_id", F.regexp_replace(F.substring_index("text", "\n", 1), "[<>&]", " ").alias("t"))
    item = F.concat(F.lit("<item><title>"), "t", F.lit("</title><link>http://x.example/"), F.col("doc_id").cast("string"), F.lit("</link><description>"), "t", F.lit("</description></item>"))
    xml = docs.select("source", "country", F.concat(F.lit("<rss><channel>"), item, item, F.lit("</channel></rss>")).alias("xml"))
    return ingest.feed_entries(xml)


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("doc_id", "title", "source", F.lit("").alias("link"))


KEYED = f"{ARTICLES}, kd AS (SELECT doc_id, title, source, lower(trim(title)) AS kt FROM articles)"


@query(f"WITH {KEYED}, n AS (SELECT *, row_number() OVER (PARTITION BY kt, trim(source) ORDER BY doc_id) AS r FROM kd WHERE doc_id % 3 = 0) SELECT doc_id, title FROM n WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM kd o WHERE o.doc_id % 3 <> 0 AND o.kt = n.kt AND trim(o.source) = trim(n.source))")
def merge_new(spark, d):
    a = _keyed(spark, d)
    return ingest.merge_new(a.where("doc_id % 3 <> 0"), a.where("doc_id % 3 = 0"), "doc_id").select("doc_id", "title")


@query(f"WITH {KEYED} SELECT doc_id, title FROM kd n WHERE NOT EXISTS (SELECT 1 FROM kd o WHERE o.doc_id % 2 = 0 AND o.kt = n.kt AND trim(o.source) = trim(n.source))")
def incremental(spark, d):
    a = _keyed(spark, d)
    return ingest.not_yet_analyzed(a, a.where("doc_id % 2 = 0")).select("doc_id", "title")


@query("SELECT doc_id, CASE WHEN length(text) < 400 THEN lang || source ELSE text END AS full_text FROM documents")
def backfill(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("doc_id").alias("link"), F.col("text").alias("full_text"), "lang", "source")
    details = docs.select("link", F.concat("lang", "source").alias("full_text"))
    return ingest.backfill(docs, details, min_chars=400).select("doc_id", "full_text")


@query("SELECT c AS \"column\", round(x, 4) AS null_fraction, x <= 0.5 AS ok FROM (SELECT unnest(['text', 'lang']) AS c, unnest(v) AS x FROM (SELECT [avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END), avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END)] AS v FROM documents))")
def validate(spark, d):
    return ingest.validation_report(read(spark, d, "documents"), ("text", "lang"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20 ORDER BY doc_id LIMIT 300")
def caps(spark, d):
    return ingest.cap_per_source(read(spark, d, "documents"), 20, "doc_id", total=300).select("doc_id", "source")


@query("SELECT lang AS country, count(*) AS n_feeds FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def feeds_by_country(spark, d):
    feeds = ingest.first_per_key(read(spark, d, "documents").select(F.col("lang").alias("country"), F.col("source").alias("url"), "doc_id"), ["country", "url"], ["doc_id"])
    return ingest.feeds_by_country(feeds).select("country", "n_feeds")


@query("SELECT event_id, CASE WHEN value > 50 THEN NULL ELSE value END AS value FROM events")
def finite_values(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("value") > 50, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return ingest.finite(e)


@query("WITH x AS (SELECT DISTINCT 'article_' || substring(md5(url), 1, 12) AS id, url AS link FROM pages WHERE length('page. ' || url) >= 30) SELECT * FROM x")
def index_rows(spark, d):
    a = read(spark, d, "pages").select(F.lit("page").alias("title"), F.col("url").alias("description"), F.lit("web").alias("source"), F.col("url").alias("link"))
    return ingest.index_rows(a).select("id", "link")


@query("SELECT 'documents' AS \"table\", count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def table_counts(spark, d):
    return ingest.counts({t: read(spark, d, t) for t in ("documents", "pages")})


@query(f"WITH {LINKS} SELECT source_entity AS \"Source Entity\", target_entity AS \"Target Entity\", strength AS \"Strength\" FROM links")
def sink_links(spark, d):
    return stored(ingest.link_export(links_npmi(spark, d)).select("Source Entity", "Target Entity", "Strength").toDF("s", "t", "x"), "sink").toDF("Source Entity", "Target Entity", "Strength")


@query(f"WITH {LINKS} SELECT 'links' AS result, count(*) AS n, sum(cooccurrence_count)::BIGINT AS total FROM links UNION ALL SELECT 'sectors', count(*), NULL FROM sectors")
def sink_bundle(spark, d):
    """Results written a folder each and read back."""
    path = f"{folder(spark)}/bundle-{uuid.uuid4().hex}"
    ingest.write_bundle({"links": links_npmi(spark, d), "sectors": sectors(spark, d)}, path)
    rows = ingest.read_bundle(spark, path, ["links", "sectors"])
    return rows.groupBy("result").agg(F.count("*").alias("n"), F.sum(F.get_json_object("row", "$.cooccurrence_count").cast("long")).alias("total"))


# ---- clusters and topics (languages stand for given clusters)

CLUSTERS = f"{ARTICLES}, cl AS (SELECT *, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS cluster FROM articles)"
C_WORDS = CLUSTERS + """, cw AS (SELECT cluster, trim(unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+')), '.,!?"''():;[]{}') AS word FROM cl), ct AS (SELECT cluster, word, count(*) AS n FROM cw WHERE length(word) >= 4 GROUP BY ALL)"""


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).withColumn("cluster", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3))


@query(f"WITH {C_WORDS}, tot AS (SELECT cluster, sum(n) AS t FROM ct GROUP BY cluster), fq AS (SELECT word, sum(n) AS f FROM ct GROUP BY word), w AS (SELECT ct.cluster, word, round(n / t * ln(1 + (SELECT avg(t) FROM tot) / f), 6) AS weight FROM ct JOIN tot USING (cluster) JOIN fq USING (word)), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, word) AS rank FROM w) SELECT cluster, rank, word, weight FROM r WHERE rank <= 10")
def topics_keywords(spark, d):
    return N.class_tfidf(clustered(spark, d))


C_DAILY = f"{CLUSTERS}, daily AS (SELECT cluster, CAST(ts AS DATE) AS day, count(*) AS n FROM cl GROUP BY ALL), bk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY day DESC) AS back FROM daily), {phases_sql('bk', 'cluster')}, {narratives_sql('cluster', 1)}"


@query(f"WITH {C_DAILY}, kw0 AS (SELECT cluster, word, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS r FROM (SELECT cluster, word, count(*) AS n FROM (SELECT cluster, trim(unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+')), '.,!?\"''():;[]{{}}') AS word FROM cl) WHERE length(word) >= 4 GROUP BY ALL)), kw AS (SELECT cluster, string_agg(word, ',' ORDER BY r) AS keywords FROM kw0 WHERE r <= 10 GROUP BY cluster) SELECT narr.*, keywords FROM narr JOIN kw USING (cluster)")
def cluster_narratives(spark, d):
    return N.cluster_narratives(clustered(spark, d))


@query(f"WITH {C_DAILY}, hf AS (SELECT cluster, day, n, row_number() OVER (PARTITION BY cluster ORDER BY day) * 2 > count(*) OVER (PARTITION BY cluster) AS late FROM daily) SELECT cluster, CAST(sum(n) AS BIGINT) AS total, min(day) AS first_seen, max(day) AS last_seen, CAST(sum(CASE WHEN late THEN n ELSE -n END) AS BIGINT) AS momentum FROM hf GROUP BY cluster")
def topics_evolution(spark, d):
    return N.topic_evolution(clustered(spark, d))


@query(f"""WITH {ARTICLES}, w0 AS (SELECT *, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM articles)) / 604800000000) AS BIGINT) AS window_id FROM articles), n AS (SELECT window_id, count(*) AS n_articles FROM w0 GROUP BY 1 HAVING count(*) >= 3),
  nl AS (SELECT *, lag(window_id) OVER (ORDER BY window_id) AS prev, lag(n_articles) OVER (ORDER BY window_id) AS pn FROM n), wd AS (SELECT window_id, trim(unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+')), '.,!?"''():;[]{{}}') AS word FROM w0),
  wc AS (SELECT window_id, word, count(*) AS n FROM wd WHERE length(word) >= 4 GROUP BY ALL), tp AS (SELECT *, n / sum(n) OVER (PARTITION BY window_id) AS share, row_number() OVER (PARTITION BY window_id ORDER BY n DESC, word) AS rank FROM wc QUALIFY rank <= 50),
  bo AS (SELECT nl.window_id, count(*) FILTER (a.rank <= 20 AND b.rank <= 20) AS retained, sum(least(a.share, b.share)) AS overlap FROM nl JOIN tp a ON a.window_id = nl.window_id JOIN tp b ON b.window_id = prev AND b.word = a.word GROUP BY 1), sz AS (SELECT window_id, count(*) FILTER (rank <= 20) AS s FROM tp GROUP BY 1), k20 AS (SELECT window_id, word FROM tp WHERE rank <= 20)
  SELECT nl.window_id, n_articles, coalesce(retained, 0) AS retained, z.s - coalesce(retained, 0) AS emerged, y.s - coalesce(retained, 0) AS disappeared, round(100 * coalesce(retained, 0) / greatest(y.s, 1), 1) AS retention, round(1 - coalesce(overlap, 0), 4) AS drift, round(100 * (n_articles - pn) / pn, 1) AS growth,
  coalesce((SELECT string_agg(a.word, ',' ORDER BY a.word) FROM k20 a JOIN k20 b ON b.word = a.word WHERE a.window_id = nl.window_id AND b.window_id = nl.prev), '') AS retained_words,
  coalesce((SELECT string_agg(a.word, ',' ORDER BY a.word) FROM k20 a WHERE a.window_id = nl.window_id AND NOT EXISTS (SELECT 1 FROM k20 b WHERE b.window_id = nl.prev AND b.word = a.word)), '') AS emerged_words,
  coalesce((SELECT string_agg(b.word, ',' ORDER BY b.word) FROM k20 b WHERE b.window_id = nl.prev AND NOT EXISTS (SELECT 1 FROM k20 a WHERE a.window_id = nl.window_id AND b.word = a.word)), '') AS disappeared_words
  FROM nl LEFT JOIN bo USING (window_id) LEFT JOIN sz z ON z.window_id = nl.window_id LEFT JOIN sz y ON y.window_id = prev WHERE prev IS NOT NULL""")
def mutation(spark, d):
    return N.mutation(articles(spark, d))


def topic_sql(phases: str, order: str) -> str:
    return f"""WITH {C_DAILY}, cn AS (SELECT 'cluster' AS kind, CAST(cluster AS VARCHAR) AS topic, phase, acceleration, recent_7_days, total_mentions FROM narr), {EVENTS}, ed AS (SELECT entity, CAST(ts AS DATE) AS day, count(*) AS n FROM mentions GROUP BY ALL), eb AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS back FROM ed),
  {phases_sql('eb', 'entity').replace('ph0', 'q0').replace('ph1', 'q1').replace('phases AS', 'qphases AS')}, {narratives_sql('entity', 2).replace('nr AS', 'qr AS').replace('nr.*', 'qr.*').replace('FROM nr', 'FROM qr').replace('narr AS', 'qnarr AS').replace('FROM bk', 'FROM eb').replace('phases USING', 'qphases USING')},
  al AS (SELECT * FROM cn UNION ALL SELECT 'entity', entity, phase, acceleration, recent_7_days, total_mentions FROM qnarr) SELECT * FROM al WHERE phase IN ({phases}) ORDER BY {order} LIMIT 10"""


@query(topic_sql("'emerging', 'accelerating', 'growing'", "acceleration DESC, recent_7_days DESC, kind, topic"))
def emerging(spark, d):
    return N.emerging_topics(entity_narratives(spark, d), cluster_narratives(spark, d))


@query(topic_sql("'declining', 'fading', 'dormant'", "acceleration, total_mentions DESC, kind, topic"))
def disappearing(spark, d):
    return N.disappearing_topics(entity_narratives(spark, d), cluster_narratives(spark, d))


@query(None)
def topics_kmeans(spark, d):
    return N.cluster_vectors(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 10)


@query("WITH u AS (SELECT label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings), p AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE / norm AS v FROM u WHERE norm > 0), s AS (SELECT label, i, sum(v) AS s FROM p GROUP BY ALL), c AS (SELECT label, count(*) AS n FROM u GROUP BY label) SELECT label, n, round((sum(s * s) - n) / (n * (n - 1)), 4) AS mean_cosine FROM s JOIN c USING (label) GROUP BY label, n")
def semantic_similarity(spark, d):
    return cooccur.mean_pairwise_cosine(read(spark, d, "embeddings"), "label")


# ---- search (every fiftieth vector and all benchmark items are the stated queries)

@query("WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, round(greatest(10 * list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 0.0), 3) AS score FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def knn(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.vector_search(v, v.where("id % 50 = 0").withColumnRenamed("id", "query_id"))


@query(None)
def knn_indexed(spark, d):
    """The same search by the index, which visits the cells that a sample of queries needs."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector_index.search(vector_index.build(v), v.where("id % 50 = 0").withColumnRenamed("id", "query_id"))


BM25 = """d0 AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d0),
  tf AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM d0), tc AS (SELECT id, dl, term, count(*) AS tf FROM tf GROUP BY ALL), dfs AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(avgdl) AS avgdl FROM tc, st GROUP BY term, n),
  ix AS (SELECT term, avgdl, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM dfs) ELSE idf END AS idf FROM dfs), qs AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS term FROM benchmark),
  bs AS (SELECT query_id, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qs JOIN ix USING (term) JOIN tc USING (term) GROUP BY ALL), br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs WHERE score > 0)"""


def keyword_results(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25(docs, read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


@query(f"WITH {BM25} SELECT query_id, id, rank FROM br WHERE rank <= 3")
def bm25(spark, d):
    return keyword_results(spark, d, 3).select("query_id", "id", "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, label, round(greatest(10 * list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 0.0), 3) AS score FROM embeddings, q), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE label < 5), u AS (SELECT query_id, id, score, rank FROM a WHERE rank <= 20 UNION ALL SELECT query_id, id, score, rank FROM b WHERE rank <= 10), g AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf, max(score) AS best FROM u GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM g) SELECT query_id, id, rrf, best, rank FROM r WHERE rank <= 10""")
def rrf(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    return search.fuse(search.vector_search(v, q, 20), search.vector_search(v.where("label < 5"), q, 10))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, label, round(greatest(10 * list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 0.0), 3) AS score FROM embeddings, q), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20),
  p AS (SELECT query_id, id, CASE WHEN label = 3 THEN 11.0::DOUBLE ELSE score END AS score FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) SELECT * FROM r WHERE rank <= 10""")
def rerank(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    found = stored(search.vector_search(v, q, 20), "found")
    scores = found.join(v.where("label = 3").select("id"), "id", "left_semi").select("query_id", "id", F.lit(11.0).alias("pair_score"))
    return search.rerank(found, scores)


@query(None)
def hybrid(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = read(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    vec = stored(search.hashed_embeddings(docs.unionByName(items)).select("id", "text", "embedding"), "vectors")
    return search.hybrid_search(vec.where("id >= 0"), docs, vec.where("id < 0").select((-1 - F.col("id")).alias("query_id"), "text", "embedding"))


# ---- briefing

@query(f"""WITH v AS (SELECT * FROM ({ORACLES['links_verified']}) q), {LINKS} SELECT count(*) AS total_links, count(*) FILTER (v.confidence >= 0.7) AS high_confidence, round(avg(v.confidence), 3) AS mean_confidence, round(avg(l.strength), 3) AS mean_strength,
  count(*) FILTER (v.verified) AS verified, CAST(0 AS BIGINT) AS causal FROM v JOIN links l USING (source_entity, target_entity)""")
def links_summary(spark, d):
    return briefing.link_summary(judged(spark, d).withColumn("causal_direction", F.lit(None).cast("string")))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Links with verdicts on the frequent ones, and the confidence that these give."""
    return judged_links(stored(links_npmi(spark, d), "links"))


def judged_links(links: DataFrame) -> DataFrame:
    return scoring.calibrate_links(scoring.merge_verdicts(links, verdicts_of(links)))


SIDES = "sd AS (SELECT source_sector AS sector, target_sector AS partner, source_entity AS entity, confidence, strength, cooccurrence_count FROM lk UNION ALL SELECT target_sector, source_sector, target_entity, confidence, strength, cooccurrence_count FROM lk)"


@query(f"""WITH {LINKS}, {SIDES}, b AS (SELECT sector, count(*) AS n_links, round(avg(confidence), 3) AS avg_confidence, count(*) FILTER (confidence >= 0.7) AS high_confidence, CAST(sum(cooccurrence_count) AS BIGINT) AS cooccurrences FROM sd GROUP BY sector),
  p AS (SELECT sector, partner, row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, partner) AS r FROM sd GROUP BY sector, partner), q AS (SELECT sector, string_agg(partner, ',' ORDER BY r) AS partners FROM p WHERE r <= 3 GROUP BY sector), n AS (SELECT sector, count(*) AS n_entities FROM sectors GROUP BY sector)
  SELECT sector, n_entities, coalesce(n_links, 0) AS n_links, avg_confidence, coalesce(high_confidence, 0) AS high_confidence, coalesce(cooccurrences, 0) AS cooccurrences, partners, CASE WHEN n_links IS NULL THEN 'stable' WHEN avg_confidence > 0.6 OR high_confidence > 3 THEN 'active' ELSE 'monitoring' END AS status FROM n LEFT JOIN b USING (sector) LEFT JOIN q USING (sector)""")
def sector_situation(spark, d):
    return briefing.sector_situation(calibrated(spark, d), sectors(spark, d))


@query(f"WITH {LINKS} SELECT source_entity, target_entity, confidence, cooccurrence_count FROM lk ORDER BY confidence DESC, cooccurrence_count DESC, source_entity, target_entity LIMIT 5")
def key_connections(spark, d):
    return briefing.key_connections(calibrated(spark, d))


@query(f"WITH {LINKS}, {SIDES}, o AS (SELECT count(*) AS links, round(coalesce(avg(confidence), 0), 3) AS confidence FROM lk) SELECT links, confidence, (SELECT string_agg(DISTINCT sector, ',' ORDER BY sector) FROM sd) AS sectors, CASE WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS label FROM o")
def overall(spark, d):
    return briefing.overall(calibrated(spark, d))


TOP_LINKS = """f3 AS (SELECT 'link' AS kind, 'Cross-domain activity: ' || source_sector || '-' || target_sector AS title, source_entity || ' and ' || target_entity || ' show ' || cooccurrence_count || ' co-occurrences across ' || source_diversity || ' sources.' AS description,
  CASE WHEN confidence > 0.7 THEN 'high' ELSE 'medium' END AS significance, source_entity || ',' || target_entity AS entities, source_sector || ',' || target_sector AS sectors, confidence, row_number() OVER (ORDER BY confidence DESC, cooccurrence_count DESC, source_entity || ' ' || target_entity) - 1 AS i FROM (SELECT * FROM lk ORDER BY confidence DESC, cooccurrence_count DESC, source_entity, target_entity LIMIT 3) q)"""


@query(f"""WITH {LINKS}, {TOP_LINKS}, ch AS (SELECT *, row_number() OVER (ORDER BY hops DESC, total_weight DESC, chain) + 2 AS i FROM ({ORACLES['impact_chains']}) q ORDER BY hops DESC, total_weight DESC, chain LIMIT 5)
  SELECT CAST(i AS INTEGER) AS finding_index, kind, title, description, significance, entities, sectors, confidence FROM f3 UNION ALL
  SELECT CAST(i AS INTEGER), 'chain', 'Impact chain: ' || replace(chain_key, '->', ' -> '), hops || ' hops, weight ' || CAST(total_weight AS BIGINT), 'medium', replace(chain, '->', ','), replace(chain_key, '->', ','), NULL FROM ch""")
def findings(spark, d):
    return briefing.findings(calibrated(spark, d), impact_chains(spark, d))


JUDGED = f"""jv AS (SELECT * FROM ({ORACLES['links_verified']}) q), cs AS (SELECT count(*) AS n_links, count(*) FILTER (verified) AS n_verified, round(count(*) FILTER (verified) / count(*), 4) AS verified_share, round(avg(confidence), 3) AS mean_confidence,
  CASE WHEN avg(confidence) > 0.5 THEN 'medium' ELSE 'low' END AS quality, 'Only ' || count(*) FILTER (verified) || '/' || count(*) || ' relationships LLM-verified' AS gap FROM jv)"""


@query(f"WITH {JUDGED} SELECT * FROM cs")
def critic_statistics(spark, d):
    return briefing.critic_statistics(judged(spark, d))


@query(f"WITH {JUDGED}, {LINKS}, {TOP_LINKS} SELECT CAST(i AS INTEGER) AS finding_index, title, 'Finding based on correlation, not proven causation' AS issue, 'medium' AS severity, i < 3 AS key_development, quality, gap FROM f3, cs")
def critique(spark, d):
    links = stored(links_npmi(spark, d), "links")
    return briefing.critique(briefing.findings(scoring.calibrate_links(links)), judged_links(links))


@query(f"WITH {JUDGED}, {LINKS}, {TOP_LINKS} SELECT 'Analysis of ' || (SELECT count(*) FROM f3) || ' intelligence findings. Key sectors: ' || (SELECT string_agg(DISTINCT s, ', ' ORDER BY s) FROM (SELECT unnest(string_split(sectors, ',')) AS s FROM f3)) || '. Confidence quality: ' || quality || '.' AS briefing FROM cs")
def agent_briefing(spark, d):
    links = stored(links_npmi(spark, d), "links")
    return briefing.agent_briefing(stored(briefing.findings(scoring.calibrate_links(links)), "findings"), judged_links(links))


@query(f"""WITH v AS (SELECT * FROM ({ORACLES['links_verified']}) q), st AS (SELECT * FROM ({ORACLES['sector_situation']}) q) SELECT 'Intelligence assessment covering ' || (SELECT count(*) FROM v) || ' cross-domain relationships across ' || (SELECT count(*) FROM st WHERE status = 'active') || ' active sectors. ' ||
  (SELECT count(*) FROM v WHERE confidence >= 0.7) || ' high-confidence connections identified, ' || (SELECT count(*) FROM v WHERE verified) || ' LLM-verified. Primary intelligence activity detected in: ' || coalesce((SELECT array_to_string(list(sector ORDER BY sector)[1:4], ', ') FROM st WHERE status = 'active'), '') || '.' AS summary""")
def executive_summary(spark, d):
    return briefing.executive_summary(judged(spark, d), sector_situation(spark, d))


@query(f"WITH {LINKS}, {SIDES} SELECT sector, entity, round(sum(strength), 3) AS total_strength, count(*) AS n_links FROM sd GROUP BY sector, entity")
def explorer_entities(spark, d):
    return briefing.explorer_entities(calibrated(spark, d))


@query(f"""WITH {LINKS}, ends AS (SELECT source_entity AS entity, target_entity AS other, strength FROM lk UNION ALL SELECT target_entity, source_entity, strength FROM lk), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY strength DESC, other) AS r FROM ends)
  SELECT entity, round(avg(strength), 8) AS mean_strength, max(strength) AS max_strength, max(CASE WHEN r = 1 THEN other END) AS strongest, count(*) AS n_links FROM r GROUP BY entity""")
def explorer_stats(spark, d):
    return briefing.entity_stats(calibrated(spark, d))


@query(f"WITH {LINKS}, {SIDES}, t AS (SELECT sector FROM sd GROUP BY sector ORDER BY count(*) DESC, sector LIMIT 4), c AS (SELECT sector, count(*) AS n FROM sd GROUP BY sector) SELECT count(DISTINCT entity) AS n_entities, count(DISTINCT sector) AS n_sectors, (SELECT string_agg(sector, ',' ORDER BY n DESC, sector) FROM t JOIN c USING (sector)) AS top_sectors FROM sd")
def explorer_totals(spark, d):
    return briefing.explorer_totals(calibrated(spark, d))


def top(name: str, columns: str, order: str, n: int) -> str:
    """The first n rows of another query's twin."""
    return f"(SELECT {columns} FROM ({ORACLES[name]}) q ORDER BY {order} LIMIT {n})"


@query(f"""WITH {LINKS}, w AS (SELECT source_entity, target_entity, confidence - 0.2 AS confidence FROM lk WHERE confidence - 0.2 < 0.5 AND cooccurrence_count >= 3 ORDER BY 3, 1, 2 LIMIT 5),
  e AS (SELECT 'weak_link' AS kind, source_entity || ' - ' || target_entity AS item, 2 AS priority, confidence AS value FROM w UNION ALL {top('velocity_anomaly', "'anomaly', entity, 1, z_score", "abs(z_score) DESC, entity", 5)} UNION ALL {top('phase_transitions', "'transition', entity, 3, confidence", "confidence DESC, entity", 5)}) SELECT * FROM e ORDER BY priority, item LIMIT 20""")
def watch_items(spark, d):
    return briefing.watch_items(calibrated(spark, d).withColumn("confidence", F.col("confidence") - 0.2), velocity_anomaly(spark, d), phase_transitions(spark, d))


@query(f"""WITH e AS (SELECT 'impact' AS kind, source_entity || ' - ' || target_entity AS item, predicted_effect AS prediction, likelihood FROM ({ORACLES['links_impact']}) q WHERE likelihood > 0.5 UNION ALL {top('phase_transitions', "'transition', entity, predicted_phase, confidence", "confidence DESC, entity", 5)}) SELECT * FROM e ORDER BY likelihood DESC, kind, item LIMIT 20""")
def predictions(spark, d):
    patterns = spark.createDataFrame(REGIONS, "p1 string, p2 string, likelihood double, timeframe string, effect string")
    return briefing.predictions(scoring.predict_impact(calibrated(spark, d), patterns), phase_transitions(spark, d))


@query(f"""WITH e AS (SELECT 'link' AS kind, source_entity || ' - ' || target_entity AS item, least(strength / 30, 1.0) AS value FROM ({ORACLES['links_npmi']}) q
  UNION ALL SELECT 'signal', keyword, least(score / 100, 1.0) FROM ({ORACLES['keyword_spike']}) q UNION ALL SELECT 'signal', CAST(entity AS VARCHAR), least(score / 100, 1.0) FROM ({ORACLES['entity_spike']}) q
  UNION ALL SELECT 'topic', topic, least(abs(acceleration) / 10, 1.0) FROM ({ORACLES['emerging']}) q UNION ALL SELECT 'chain', chain, least(total_weight / 100, 1.0) FROM ({ORACLES['impact_chains']}) q),
  r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value DESC, item) AS r FROM e) SELECT kind, item, CAST(round(value, 4) AS DOUBLE) AS value FROM r WHERE r <= 10 ORDER BY value DESC, kind, item LIMIT 30""")
def feed(spark, d):
    spikes = keyword_spike(spark, d).unionByName(entity_spike(spark, d), allowMissingColumns=True)
    return briefing.discovery_feed(links_npmi(spark, d), spikes, emerging(spark, d), impact_chains(spark, d))


@query(f"""SELECT * FROM (SELECT * FROM (SELECT 'entity' AS kind, CAST(entity AS VARCHAR) AS topic, acceleration, phase FROM ({ORACLES['entity_narratives']}) q UNION ALL SELECT 'cluster', CAST(cluster AS VARCHAR), acceleration, phase FROM ({ORACLES['cluster_narratives']}) q) ORDER BY abs(acceleration) DESC, kind, topic LIMIT 25)
  UNION ALL SELECT * FROM (SELECT 'chain', chain, NULL, NULL FROM ({ORACLES['impact_chains']}) q ORDER BY hops DESC, total_weight DESC, chain LIMIT 10)""")
def timeline(spark, d):
    return briefing.timeline(entity_narratives(spark, d), cluster_narratives(spark, d), impact_chains(spark, d))


@query("WITH s AS (SELECT source, CASE WHEN contains(text, '!!') THEN 1.0 ELSE 0.0 END AS s, CASE WHEN contains(text, '$$$') THEN 1.0 ELSE 0.0 END AS c, CASE WHEN contains(text, '?') THEN 1.0 ELSE 0.0 END AS e FROM documents) SELECT source, count(*) AS n_articles, round(avg(s), 4) AS sensationalism, round(avg(c), 4) AS clickbait, round(avg(e), 4) AS emotional, round(100 - 200 * avg(s) - 100 * avg(c) - 50 * avg(e), 2) AS score FROM s GROUP BY source")
def source_reliability(spark, d):
    flag = lambda x: F.col("text").contains(x).cast("double")
    return briefing.source_reliability(read(spark, d, "documents").select("source", flag("!!").alias("sensationalism"), flag("$$$").alias("clickbait"), flag("?").alias("emotional")))


# ---- languages, places, profiles, single lookups

@query(r"""WITH w AS (SELECT lang, doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'))) AS word FROM documents WHERE lang IS NOT NULL), c AS (SELECT lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
  p AS (SELECT lang, word FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM c) WHERE r <= 200), f AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'))) AS word FROM documents),
  h AS (SELECT doc_id, p.lang, count(*) AS n FROM f JOIN p USING (word) WHERE word <> '' GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS r FROM h) SELECT doc_id, coalesce(b.lang, 'unknown') AS detected, coalesce(n, 0) AS hits FROM documents LEFT JOIN (FROM b WHERE r = 1) b USING (doc_id)""")
def lang_id(spark, d):
    docs = read(spark, d, "documents")
    return language.detect_language(docs, language.word_profiles(docs))


@query("""WITH e AS (SELECT DISTINCT s_name || ' of ' || n_name AS entity FROM supplier JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT n_name AS country, n_nationkey AS rank, CAST(n_nationkey AS DOUBLE) AS lat, CAST(n_regionkey AS DOUBLE) AS lon FROM nation),
  h AS (SELECT entity, country, lat, lon, row_number() OVER (PARTITION BY entity ORDER BY rank) AS r FROM e JOIN c ON contains(lower(entity), lower(country))) SELECT entity, country, lat, lon FROM h WHERE r = 1""")
def geo(spark, d):
    n = read(spark, d, "nation")
    e = read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("s_name", F.lit(" of "), "n_name").alias("entity")).distinct()
    return language.locate(e, n.select(F.col("n_name").alias("country"), F.col("n_nationkey").alias("rank"), F.col("n_nationkey").cast("double").alias("lat"), F.col("n_regionkey").cast("double").alias("lon")))


@query(None)
def column_profile(spark, d):
    return ingest.categorical_profile(read(spark, d, "documents"))


@query(f"WITH {E_SPIKES} SELECT entity, round(greatest(0.1::DOUBLE, least(0.98::DOUBLE, 0.4::DOUBLE * 0.4::DOUBLE + least(round(n * b, 1) / 10.0::DOUBLE + round(b, 1) * 0.2::DOUBLE + n * 0.03::DOUBLE, 1.0::DOUBLE) * 0.6::DOUBLE)), 3) AS confidence FROM es WHERE b > 1.2")
def signal_confidence(spark, d):
    return scoring.calibrate_signals(signals.entity_spikes(event_mentions(spark, d), min_burst=1.2)).select("entity", "confidence")


@query(f"WITH {LINKS} SELECT source_entity, target_entity, confidence FROM lk WHERE least(source_entity, target_entity) = 'Supplier#000000001' AND greatest(source_entity, target_entity) <= 'Supplier#000000005'")
def links_of_entity(spark, d):
    found, out = stored(calibrated(spark, d), "links"), None
    for k in range(2, 6):
        one = scoring.find_link(found, f"Supplier#00000000{k}", "Supplier#000000001").select("source_entity", "target_entity", "confidence")
        out = one if out is None else out.unionByName(one)
    return out


@query(rf"""WITH lx(word, weight) AS (VALUES {', '.join(f"('{w}', {x}::DOUBLE)" for w, x in LEXICON)}), w AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g'), '\s+')) AS word FROM documents),
  s AS (SELECT doc_id, count(*) AS n, count(weight) AS k, coalesce(sum(weight), 0) AS x FROM w LEFT JOIN lx USING (word) WHERE word <> '' GROUP BY doc_id) SELECT doc_id, round(abs(round(x / sqrt(x * x + 15.0), 4)) * (1 - round(1 - k / n, 4)), 8) AS subjectivity FROM s""")
def subjectivity(spark, d):
    s = T.sentiment(read(spark, d, "documents"), spark.createDataFrame(LEXICON, "word string, weight double"))
    return s.select("doc_id", F.round(T.subjectivity(F.col("compound"), F.col("neu")), 8).alias("subjectivity"))


# ---- streams over the events table, run to its end

def _drained(df: DataFrame, name: str) -> DataFrame:
    """What an append stream writes until its input is used up, read back from its file sink."""
    spark = df.sparkSession
    base = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = read(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet*")
    return e.select(F.col("event_id").alias("doc_id"), F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"WITH {EVENTS}, {DAILY} SELECT day, entity, n FROM daily WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM mentions) - INTERVAL 1 DAY")
def stream_daily_counts(spark, d):
    from sparkloom.streaming import streams

    return _drained(streams.daily_counts_stream(_event_stream(spark, d)), "daily")


@query(f"WITH {EVENTS}, w AS (SELECT entity, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM mentions) SELECT start, entity, count(*) AS n FROM w WHERE start + INTERVAL 2 DAY <= (SELECT max(ts) FROM mentions) - INTERVAL 1 DAY GROUP BY ALL")
def stream_sliding_counts(spark, d):
    from sparkloom.streaming import streams

    return _drained(streams.sliding_counts(_event_stream(spark, d), "48 hours", "24 hours"), "sliding")


@query(f"WITH {EVENTS} SELECT DISTINCT source AS title, entity AS source FROM mentions")
def stream_dedup(spark, d):
    from sparkloom.streaming import streams

    e = _event_stream(spark, d).select(F.col("source").alias("title"), F.col("entity").alias("source"), F.lit("").alias("link"), "ts")
    return _drained(streams.dedup_stream(e, "90 days").select("title", "source"), "dedup")


@query(f"WITH {LINKS}, pat(p1, p2, l, t, e) AS (VALUES {REGION_VALUES}) SELECT source_entity, target_entity, coalesce(e, 'Cross-domain propagation between ' || source_sector || ' and ' || target_sector || ';Secondary effects in connected sectors;Potential narrative amplification across sources') AS effects FROM links LEFT JOIN pat ON (p1 = source_sector AND p2 = target_sector) OR (p2 = source_sector AND p1 = target_sector)")
def links_downstream(spark, d):
    effects = spark.createDataFrame([(a, b, [e]) for a, b, _, _, e in REGIONS], "p1 string, p2 string, effects array<string>")
    return scoring.downstream_effects(links_npmi(spark, d), effects).select("source_entity", "target_entity", F.array_join("downstream", ";").alias("effects"))


@query(f"WITH {NARR} SELECT entity, entity || ' is ' || phase || ': ' || total_mentions || ' mentions, ' || recent_7_days || ' of them recent' AS sentence FROM narr")
def narrative_sentences(spark, d):
    return entity_narratives(spark, d).select("entity", scoring.narrative_sentence().alias("sentence"))


@query(f"WITH {E_SPIKES} SELECT entity, printf('anomaly: %s (%d mentions, burst %.1fx)', entity, n, round(b, 1)) AS sentence FROM es WHERE b > 1.2")
def signal_sentences(spark, d):
    return signals.entity_spikes(event_mentions(spark, d), min_burst=1.2).select("entity", scoring.signal_sentence().alias("sentence"))


# ---- entity lists, times, tables on disk, stateful streams

ENTITY_JSON = """CASE WHEN p_size % 9 = 0 THEN '{broken' ELSE '{"persons": ["' || p_name || '", "  "], "orgs": [" ' || p_brand || ' ", "' || p_type || '"]}' END"""


def listed(spark: SparkSession, d: str) -> DataFrame:
    """part as articles that carry their entities as JSON."""
    parts = read(spark, d, "part").select("p_partkey", F.expr(ENTITY_JSON).alias("json"))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return parts.select(F.col("p_partkey").alias("doc_id"), F.lit("parts").alias("source"), start.alias("ts"), T.entity_arrays(F.col("json")).alias("entities"))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 9 = 0 THEN 0 ELSE 1 END AS n_persons, CASE WHEN p_size % 9 = 0 THEN 0 ELSE 2 END AS n_orgs, 0 AS n_locations, CASE WHEN p_size % 9 <> 0 THEN trim(p_brand) || '|' || trim(p_type) ELSE '' END AS orgs FROM part")
def entity_json(spark, d):
    e = listed(spark, d)
    return e.select("doc_id", *(F.size(f"entities.{k}").alias(f"n_{k}") for k in ("persons", "orgs", "locations")), F.array_join("entities.orgs", "|").alias("orgs"))


@query("SELECT p_partkey AS doc_id, lower(trim(unnest([p_name, p_brand, p_type]))) AS entity, unnest(['persons', 'orgs', 'orgs']) AS etype, CAST(unnest([0, 1, 2]) AS BIGINT) AS ord FROM part WHERE p_size % 9 <> 0")
def mention_rows(spark, d):
    return T.mentions_of(listed(spark, d)).select("doc_id", "entity", "etype", "ord")


TIME_TEXT = "CASE WHEN event_id % 3 = 0 THEN 'soon' WHEN event_id % 3 = 1 THEN CAST(CAST(ts AS DATE) AS STRING) ELSE NULL END"


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS parsed FROM events")
def parsed_times(spark, d):
    return read(spark, d, "events").select("event_id", T.parse_time(F.expr(TIME_TEXT)).cast("timestamp_ntz").alias("parsed"))


@query("SELECT CASE WHEN count(*) FILTER (event_id % 7 = 0) > 0.3 * count(*) THEN 'published' WHEN count(*) FILTER (event_id % 3 = 1) > 0.3 * count(*) THEN 'scraped_at' END AS picked, count(*) AS n FROM events")
def time_column(spark, d):
    rare = F.expr("CASE WHEN event_id % 7 = 0 THEN CAST(ts AS STRING) ELSE 'unknown' END")
    e = read(spark, d, "events").select(rare.alias("published"), F.expr(TIME_TEXT).alias("scraped_at"), F.lit("x").alias("analyzed_at"))
    return e.agg(F.lit(T.pick_time_column(e)).alias("picked"), F.count("*").alias("n"))


@query(f"WITH {ARTICLES} SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, min(title) AS first_title FROM articles GROUP BY source")
def raw_csv(spark, d):
    path = f"{folder(spark)}/raw-{uuid.uuid4().hex}"
    a = articles(spark, d)
    raw = a.select("source", "title", F.col("text").alias("full_text"))
    columns = [c.split()[0] for c in ingest.RAW_SCHEMA.split(", ")]
    ingest.save_raw(raw.select(*(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns)), path)
    back = ingest.load_raw(spark, path)
    return back.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("full_text")).alias("chars"), F.min("title").alias("first_title"))


@query(f"WITH {ARTICLES} SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM articles GROUP BY 1")
def analysed_parquet(spark, d):
    path = f"{folder(spark)}/analysed-{uuid.uuid4().hex}"
    ingest.save_analyzed(articles(spark, d), path)
    return ingest.load_analyzed(spark, path).groupBy("day").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {EVENTS} SELECT DISTINCT source AS title, entity AS source FROM mentions")
def stream_history(spark, d):
    """Every title and source once, over all batches: the events land as files and come in one by one."""
    from sparkloom.streaming import streams

    base = f"{folder(spark)}/history-{uuid.uuid4().hex}"
    e = event_mentions(spark, d).select("doc_id", F.col("source").alias("title"), F.col("entity").alias("source"), F.lit("").alias("link"))
    e.repartition(4).write.parquet(f"{base}/in")
    landed = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    streams.dedup_history(landed, f"{base}/store", ["doc_id"]).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return streams.history(spark, f"{base}/store").select("title", "source")


def _phase_stream(spark: SparkSession, d: str, **quiet: int) -> DataFrame:
    """Changes of phase as the daily counts come in; the state store is set for a session of its own."""
    from sparkloom.streaming import streams

    path = f"{folder(spark)}/daily-{uuid.uuid4().hex}"
    events_daily(spark, d).select(F.col("entity").cast("string").alias("entity"), F.col("day").cast("date").alias("day"), F.col("n").cast("long").alias("n")).write.parquet(path)
    own = spark.newSession()
    for name, value in streams.ROCKSDB.items():
        own.conf.set(name, value)
    daily = own.readStream.schema("entity string, day date, n long").parquet(path)
    base = f"{folder(spark)}/phases-{uuid.uuid4().hex}"
    changes = streams.phase_changes(daily, **quiet)
    changes.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{base}/out")


@query(None)
def stream_phases(spark, d):
    """Phases of entities as the daily counts of the event files come in."""
    return _phase_stream(spark, d)


@query(f"WITH {EVENTS}, {DAILY}, edge AS (SELECT max(day) - 1 AS mark FROM daily) SELECT entity, CAST(max(day) + 5 AS DATE) AS day FROM daily, edge GROUP BY entity, mark HAVING max(day) + 5 <= mark")
def stream_quiet(spark, d):
    """When entities went dormant after five quiet days, as the timers of the stream report it."""
    return _phase_stream(spark, d, fade_days=2, idle_days=5).where("to_phase = 'dormant'").select("entity", "day")


@query(f"SELECT type, title, severity FROM ({ORACLES['alerts_bursts']}) q ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, type, title LIMIT 5")
def stream_alerts(spark, d):
    """The first alerts of a batch, as the fan-out writes them."""
    from sparkloom.streaming import streams

    base = f"{folder(spark)}/alerts-{uuid.uuid4().hex}"
    alerts = alerts_bursts(spark, d).select("type", "title", "severity")
    alerts.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(alerts.schema).parquet(f"{base}/in")
    streams.fan_out(stream, f"{base}/out", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("type string, title string, severity string, batch_id long").parquet(f"{base}/out").drop("batch_id")
