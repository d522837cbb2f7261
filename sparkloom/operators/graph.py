"""Entity, sector and precedence graphs as vertex and edge tables; searches for paths in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.cooccur import important_entities, only_important, pair_weights, parts
from sparkloom.sources.scratch import looked_up, side, stored

# Patterns of sector pairs.
CAUSAL_PATTERNS = [
    ("politics", "finance", "policy_shock"), ("politics", "technology", "regulatory_drag"), ("finance", "energy", "price_transmission"),
    ("technology", "military", "capability_shift"), ("energy", "politics", "resource_conflict"), ("social", "politics", "preference_driven"),
    ("technology", "energy", "demand_shock"), ("finance", "startups", "capital_flow"), ("military", "technology", "procurement_driven"),
    ("politics", "military", "strategic_posture"),
]


def entity_graph(mentions: DataFrame, min_mentions: int = 2, min_weight: int = 2, multiset: bool = False, top: int = 200) -> DataFrame:
    """The heaviest pairs of important entities: e1, e2, weight."""
    kept = only_important(mentions, important_entities(mentions, min_mentions))
    w = pair_weights(kept, multiset).where(F.col("weight") >= min_weight)
    return w.orderBy(F.desc("weight"), "e1", "e2").limit(top)


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity, degree, centrality = degree / (n - 1), for all nodes(entity, ...)."""
    ends = edges.select(F.explode(F.array("e1", "e2")).alias("entity")).groupBy("entity").agg(F.count("*").alias("degree"))
    n = nodes.agg(F.count("*").alias("k"))
    out = nodes.join(ends.hint("shuffle_merge"), "entity", "left").crossJoin(F.broadcast(n))  # one row
    degree = F.coalesce("degree", F.lit(0).cast("long"))
    return out.select("entity", "n_mentions", "n_sources", degree.alias("degree"), F.round(F.when(F.col("k") > 1, degree / (F.col("k") - 1)).otherwise(0.0), 4).alias("centrality"))


def sector_graph(links: DataFrame) -> DataFrame:
    """Sector edges in canonical order: number of links, mean strength and, if links have it, mean confidence."""
    a, b = F.least("source_sector", "target_sector"), F.greatest("source_sector", "target_sector")
    means = [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("strength", "confidence") if c in links.columns]
    return links.groupBy(a.alias("sector_1"), b.alias("sector_2")).agg(F.count("*").alias("n_links"), F.sum("cooccurrence_count").alias("cooccurrences"), *means)


def candidate_graph(candidates: DataFrame, sectors: DataFrame, patterns: DataFrame) -> DataFrame:
    """Directed edges (source, target, weight, pattern, mean_lag_hours); forward patterns win."""
    candidates = stored(candidates, "candidates")
    n = parts(candidates.count())
    s = sectors.select(F.col("entity").alias("source"), F.col("sector").alias("s1"))
    t = sectors.select(F.col("entity").alias("target"), F.col("sector").alias("s2"))
    j = looked_up(looked_up(candidates, s, "source", n, "left"), t, "target", n, "left")
    ahead = patterns.select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), F.col("pattern").alias("f"))
    back = patterns.select(F.col("p2").alias("s1"), F.col("p1").alias("s2"), F.col("pattern").alias("b"))
    j = j.join(side(ahead), ["s1", "s2"], "left").join(side(back), ["s1", "s2"], "left")
    best = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("causal_score"), "mean_lag_hours"))
    return j.repartition(n, "source", "target").withColumn("r", best).where("r = 1").select("source", "target", F.col("causal_score").alias("weight"), F.coalesce("f", "b", F.lit("general")).alias("pattern"), "mean_lag_hours")


def roots(edges: DataFrame, n: int = 20, fallback: int = 10) -> DataFrame:
    """Nodes that are only sources; if there is none, the first nodes by name."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(False).alias("reached")), F.struct(F.col("target").alias("node"), F.lit(True).alias("reached")))).alias("e")
    every = stored(edges.select(ends).select("e.*").groupBy("node").agg(F.max("reached").alias("reached")), "nodes")
    pure = every.where("NOT reached AND node IS NOT NULL").select("node")
    every = every.select("node")
    none = pure.limit(1).agg((F.count("*") == 0).alias("none"))
    rest = every.orderBy("node").limit(fallback).crossJoin(F.broadcast(none)).where("none").select("node")  # one row
    return pure.unionByName(rest).orderBy("node").limit(n)


def shortest_chains(edges: DataFrame, sources: DataFrame, max_depth: int = 5) -> DataFrame:
    """root, node, path, score, patterns: one shortest path from each root to each node.

    Breadth first: each step joins the frontier with the edges and drops reached nodes; of
    paths of equal length the alphabetically first stays.
    """
    e = stored(edges.groupBy("source", "target").agg(F.max("weight").alias("weight"), F.min("pattern").alias("pattern")), "chain-edges")
    seen = stored(sources.select(F.col("node").alias("root"), "node", F.array("node").alias("path"), F.lit(0.0).alias("total"), F.array().cast("array<string>").alias("patterns")), "chain-0")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, F.col("node") == F.col("source")).select("root", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"), (F.col("total") + F.col("weight")).alias("total"), F.concat("patterns", F.array("pattern")).alias("patterns"))
        first = step.groupBy("root", "node").agg(F.min(F.struct("path", "total", "patterns")).alias("b")).select("root", "node", "b.*")
        frontier = stored(first.join(seen.select("root", "node"), ["root", "node"], "left_anti"), f"chain-{depth}")
        seen = seen.unionByName(frontier)
    return seen.withColumn("length", F.size("path")).where("length >= 3").select("root", "node", F.array_join("path", "->").alias("chain"), F.col("length").cast("long").alias("length"), F.round(F.col("total") / (F.col("length") - 1), 3).alias("avg_score"), F.array_join("patterns", ",").alias("patterns"))


def top_chains(chains: DataFrame, n: int = 30) -> DataFrame:
    return chains.orderBy(F.desc("avg_score"), F.desc("length"), "chain").limit(n)


def shortest_weighted_paths(edges: DataFrame, sources: DataFrame, cost: str = "weight", max_hops: int | None = None, max_rounds: int = 100) -> DataFrame:
    """root, node, dist, hops, prev: the globally cheapest way from each root over undirected edges(e1, e2, weight).

    Labels of all roots are relaxed together, one hop a round, until none falls; prev is the node
    before, so no path travels (traced() gives it).  Of equal costs fewer hops win, then the first
    prev by name.  cost = 'inverse' makes strong ties short.  With max_hops, the cheapest of the
    ways with so many hops or fewer.  Labels that still fall after max_rounds are an error.
    """
    c = F.col("weight").cast("double") if cost == "weight" else 1.0 / F.col("weight")
    both = edges.select(F.col("e1").alias("u"), F.col("e2").alias("v"), c.alias("c")).unionByName(edges.select(F.col("e2").alias("u"), F.col("e1").alias("v"), c.alias("c")))
    both = stored(both.groupBy("u", "v").agg(F.min("c").alias("c")), "path-edges")
    label = F.struct("dist", "hops", "prev")
    best = stored(sources.select(F.col("node").alias("root"), "node", F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit("").alias("prev")).distinct(), "path-labels")
    frontier = best.select("root", "node", "dist", "hops")
    for _ in range(max_rounds if max_hops is None else max_hops):
        step = frontier.join(both.hint("shuffle_merge"), F.col("node") == F.col("u")).select("root", F.col("v").alias("node"), (F.col("dist") + F.col("c")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("prev"))
        step = step.groupBy("root", "node").agg(F.min(label).alias("new"))
        old = best.select("root", "node", label.alias("old"))
        met = stored(old.join(step.hint("shuffle_merge"), ["root", "node"], "full"), "path-met")
        # A label that changes in prev alone changes nothing beyond it.
        fell = met.where("old IS NULL OR struct(new.dist, new.hops) < struct(old.dist, old.hops)").where("new IS NOT NULL")
        frontier = stored(fell.select("root", "node", "new.dist", "new.hops"), "path-frontier")
        best = met.select("root", "node", F.least("old", "new").alias("x")).select("root", "node", "x.*")
        if frontier.isEmpty():
            return best
    if max_hops is None:
        raise RuntimeError(f"distances still fall after {max_rounds} rounds")
    return best


def paths_between(edges: DataFrame, ends: DataFrame, wanted: DataFrame, cost: str = "weight", max_hops: int = 3, max_rounds: int = 100) -> DataFrame:
    """root, node, dist, hops, prev as shortest_weighted_paths gives them, for wanted(root, node), both of ends(node),
    and for what lies on their paths: the pairs whose globally cheapest way has max_hops hops or fewer.

    Ends are reached by the edges into them, which are few; other nodes are relaxed only from labels that may
    still be on such a way: with two more edges they cost no more than the dearest way known from their root to
    an end that it wants.  Ends without a way of max_hops hops are wanted no more after so many rounds.
    """
    c = F.col("weight").cast("double") if cost == "weight" else 1.0 / F.col("weight")
    both = edges.select(F.explode(F.array(F.struct(F.col("e1").alias("u"), F.col("e2").alias("v"), c.alias("c")), F.struct(F.col("e2").alias("u"), F.col("e1").alias("v"), c.alias("c")))).alias("e")).select("e.*")
    last = stored(both.join(F.broadcast(ends.select(F.col("node").alias("v"))), "v", "left_semi"), "edges-to-ends")  # a few leaders
    least = edges.agg(F.min(c).alias("least")).first()["least"] or 0.0
    label = F.struct("dist", "hops", "prev")
    wanted = stored(wanted.select("root", "node"), "path-wanted")
    labels = stored(wanted.select("root", F.col("root").alias("node"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit("").alias("prev")).distinct(), "path-labels")
    frontier = labels.select("root", "node", "dist", "hops")

    def relaxed(rows: DataFrame, into: DataFrame) -> DataFrame:
        """The cheapest labels that rows give over the edges into."""
        step = rows.join(into, F.col("node") == F.col("u")).select("root", F.col("v").alias("node"), (F.col("dist") + F.col("c")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("prev"))
        return step.groupBy("root", "node").agg(F.min(label).alias("new")).select("root", "node", "new.*")

    def merged(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All labels, and those whose cost or hops fell."""
        before = old.select("root", "node", label.alias("old"))
        met = stored(before.join(new.select("root", "node", label.alias("new")).hint("shuffle_merge"), ["root", "node"], "full"), "path-met")
        fell = met.where("new IS NOT NULL AND (old IS NULL OR struct(new.dist, new.hops) < struct(old.dist, old.hops))")
        best = met.select("root", "node", F.least("old", "new").alias("x")).select("root", "node", "x.*")
        return best, fell.select("root", "node", "new.dist", "new.hops")

    for hop in range(1, max_rounds + 1):
        labels, at_ends = merged(labels, relaxed(frontier, last.hint("shuffle_merge")))
        found = wanted.join(labels.select("root", "node", "dist").hint("shuffle_merge"), ["root", "node"], "left")
        # After max_hops rounds a pair without a way has none of so few hops.
        bound = found.groupBy("root").agg(F.max(F.coalesce("dist", F.lit(float("inf") if hop < max_hops else -1.0))).alias("most"))
        bound = F.broadcast(stored(bound, "path-bound"))  # a row for each root
        open_ = frontier.join(bound, "root").where(F.col("dist") + 2 * least <= F.col("most") * (1 + 1e-9)).drop("most")
        labels, inside = merged(labels, relaxed(side(stored(open_, "path-open")), both))
        frontier = stored(inside.unionByName(at_ends), "path-frontier")
        if frontier.isEmpty():
            return labels
    raise RuntimeError(f"distances still fall after {max_rounds} rounds")


def traced(labels: DataFrame, wanted: DataFrame, hops: int) -> DataFrame:
    """wanted(root, node) of so many hops at most, with path: the nodes from root to node, by the labels' prev."""
    before = labels.select("root", F.col("node").alias("at"), "prev")
    rows = wanted.select("root", "node", F.col("node").alias("at"), F.array("node").alias("path"))
    for _ in range(hops):
        rows = rows.join(before.hint("shuffle_merge"), ["root", "at"])
        more = F.col("at") != F.col("root")
        rows = rows.select("root", "node", F.when(more, F.col("prev")).otherwise(F.col("at")).alias("at"), F.when(more, F.concat(F.array("prev"), "path")).otherwise(F.col("path")).alias("path"))
    return rows.where("at = root").select("root", "node", "path")


def impact_chains(pairs: DataFrame, sectors: DataFrame, ranked: DataFrame, per_sector: int = 5, top: int = 50, cost: str = "weight") -> DataFrame:
    """Cheapest paths of 3 or 4 nodes between leading entities of different sectors.

    ranked(entity, sector, mention_count) gives the leaders; of paths with one sequence of
    sectors the one with most changes of sector, then weight, then name stays.
    """
    order = Window.partitionBy("sector").orderBy(F.desc("mention_count"), "entity")
    lead = stored(ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_sector).select("entity", "sector"), "leaders")
    pair = (F.col("a.sector") < F.col("b.sector")) & (F.col("a.entity") != F.col("b.entity"))
    wanted = lead.alias("a").join(F.broadcast(lead.alias("b")), pair).select(F.col("a.entity").alias("root"), F.col("b.entity").alias("node"))  # leaders of each sector
    labels = stored(paths_between(pairs, lead.select(F.col("entity").alias("node")), wanted, cost), "path-labels")
    ends = lead.select(F.col("entity").alias("node"), F.col("sector").alias("end_sector"))
    starts = lead.select(F.col("entity").alias("root"), F.col("sector").alias("start_sector"))
    mine = labels.join(side(ends), "node").join(side(starts), "root").where("start_sector < end_sector AND hops BETWEEN 2 AND 3")
    found = traced(labels, mine, 3).join(mine.select("root", "node", "dist").hint("shuffle_merge"), ["root", "node"])
    found = stored(found, "path-found")
    steps = found.select("root", "node", "dist", "path", F.posexplode("path").alias("pos", "entity")).join(sectors.hint("shuffle_merge"), "entity")
    line = steps.groupBy("root", "node", "dist", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "sector"))).alias("s")).withColumn("sectors", F.transform("s", lambda x: x["sector"]))
    hops = F.size(F.filter(F.arrays_zip(F.slice("sectors", 1, F.size("sectors") - 1).alias("a"), F.slice("sectors", 2, F.size("sectors") - 1).alias("b")), lambda p: p["a"] != p["b"]))
    line = line.withColumn("hops", hops.cast("long")).withColumn("chain_key", F.array_join("sectors", "->")).withColumn("chain", F.array_join("path", "->"))
    rank = F.row_number().over(Window.partitionBy("chain_key").orderBy(F.desc("hops"), F.desc("dist"), "chain"))
    return line.withColumn("r", rank).where("r = 1").select("chain_key", "chain", "hops", F.col("dist").alias("total_weight")).orderBy(F.desc("hops"), F.desc("total_weight"), "chain_key").limit(top)


def neighbourhood(edges: DataFrame, entity: str, limit: int = 100) -> DataFrame:
    """Paths of one or two hops from entity over undirected edges(e1, e2, weight): a report of limit rows."""
    both = edges.select(F.col("e1").alias("u"), F.col("e2").alias("v"), "weight").unionByName(edges.select(F.col("e2").alias("u"), F.col("e1").alias("v"), "weight"))
    one = both.where(F.col("u") == entity).select(F.col("v").alias("hop_1"), F.lit(None).cast("string").alias("hop_2"), F.col("weight").alias("weight_1"), F.lit(None).cast("long").alias("weight_2"))
    nxt = both.select(F.col("u").alias("hop_1"), F.col("v").alias("h2"), F.col("weight").alias("w2"))
    two = one.join(nxt, "hop_1").where(F.col("h2") != entity).select("hop_1", F.col("h2").alias("hop_2"), "weight_1", F.col("w2").alias("weight_2"))
    return one.unionByName(two).orderBy("hop_1", F.asc_nulls_first("hop_2")).limit(limit)


def graph_summary(edges: DataFrame) -> DataFrame:
    nodes = edges.select("source").union(edges.select("target")).distinct().agg(F.count("*").alias("n_nodes"))
    return nodes.crossJoin(edges.agg(F.count("*").alias("n_edges"), F.round(F.coalesce(F.avg("weight"), F.lit(0.0)), 3).alias("mean_score")))


def node_list(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, score: every node of edges(source, target, weight) and its mean edge weight."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("out")), F.struct(F.col("target").alias("node"), F.lit(0).alias("out")))).alias("e")
    each = edges.select("weight", ends).select("weight", "e.*")
    return each.groupBy("node").agg(F.sum("out").alias("out_degree"), F.sum(1 - F.col("out")).alias("in_degree"), F.round(F.avg("weight"), 3).alias("score"))


def upsert(stored_rows: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """MERGE by key: the row with the latest order wins."""
    w = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("__new"))
    both = stored_rows.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")
