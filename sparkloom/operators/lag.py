"""Lags between the mentions of two entities: a range join in day buckets, and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.cooccur import parts, per_document
from sparkloom.sources.scratch import looked_up, stored


def of_ends(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row with a time for each (document, entity) of the pairs' ends: the mentions of others meet nothing."""
    ends = stored(pairs.select(F.explode(F.array("e1", "e2")).alias("entity")).distinct(), "lag-ends")
    kept = looked_up(mentions, ends, "entity", lambda: parts(mentions.count()), "left_semi")
    return stored(per_document(kept).where(F.col("ts").isNotNull()), "lag-mentions")


def lag_samples(mentions: DataFrame, pairs: DataFrame, min_hours: float = 6, max_days: int = 14) -> DataFrame:
    """e1, e2, ahead, lag_hours: mentions of one end that follow the other's by 6 h to 14 days.

    Both directions are one range join: a mention goes to the bucket of its time, the other
    side looks into its own and the next bucket, each max_days wide.
    """
    pairs = stored(pairs, "lag-pairs")
    m = of_ends(mentions, pairs).select("entity", "doc_id", F.unix_micros("ts").alias("t"))
    width = max_days * 86_400_000_000
    way = pairs.select("e1", "e2", F.lit(True).alias("ahead"), F.col("e1").alias("a"), F.col("e2").alias("b")).unionByName(pairs.select("e1", "e2", F.lit(False).alias("ahead"), F.col("e2").alias("a"), F.col("e1").alias("b")))
    left = way.join(m.select(F.col("entity").alias("a"), F.col("t").alias("ta")), "a").withColumn("bucket", F.explode(F.array(F.floor(F.col("ta") / width), F.floor(F.col("ta") / width) + 1)))
    right = m.select(F.col("entity").alias("b"), F.col("t").alias("tb"), F.floor(F.col("t") / width).alias("bucket"))
    gap = F.col("tb") - F.col("ta")
    hit = left.join(right.hint("shuffle_merge"), ["b", "bucket"]).where(gap.between(int(min_hours * 3_600_000_000), width))
    return hit.select("e1", "e2", "ahead", (gap / 3_600_000_000).alias("lag_hours"))


#: Stretches of a bucket that are summed up on their own.
STRETCHES = 64


def lag_sums(mentions: DataFrame, pairs: DataFrame, min_hours: float = 6, max_days: int = 14) -> DataFrame:
    """e1, e2, n1, n2, l1, l2: how many lags there are ahead and behind, and their means in hours.

    The lags of lag_samples are added up without being made.  In the order of time, a mention of
    the one end opens min_hours after itself and closes after max_days; each mention of the other
    end adds what is open: running sums over a bucket of one pair, linear in its mentions.

    Mentions of one entity at one time are one row with a count.  A bucket is cut into STRETCHES
    by time: what is open before a stretch is the sum of those before it, so no task needs a hot
    pair's whole bucket.
    """
    low, width = int(min_hours * 3_600_000_000), max_days * 86_400_000_000
    m = of_ends(mentions, pairs).groupBy("entity", F.unix_micros("ts").alias("t")).agg(F.count("*").alias("c"))
    m = stored(m, "lag-times")
    way = pairs.select("e1", "e2", F.explode(F.array(F.struct(F.lit(True).alias("ahead"), F.col("e1").alias("a"), F.col("e2").alias("b")), F.struct(F.lit(False).alias("ahead"), F.col("e2").alias("a"), F.col("e1").alias("b")))).alias("w"))
    way = stored(way.select("e1", "e2", "w.*"), "lag-ways")
    bucket = F.floor(F.col("t") / width)
    # Times count from the bucket's beginning, so that their sums stay small; closing comes after what it still covers.
    from_ = (F.col("t") - F.col("bucket") * width).alias("at")
    a = way.join(m.withColumnRenamed("entity", "a").hint("shuffle_merge"), "a").select("e1", "e2", "ahead", "t", "c", F.explode(F.array(bucket, bucket + 1)).alias("bucket")).select("e1", "e2", "ahead", "bucket", "c", from_)
    step = lambda time, rank, sign: F.struct(time.alias("time"), F.lit(rank).alias("rank"), (F.col("c") * sign).alias("n"), (F.col("at") * F.col("c") * sign).alias("sum"))
    a = a.select("e1", "e2", "ahead", "bucket", "c", F.explode(F.array(step(F.col("at") + low, 0, 1), step(F.col("at") + width, 2, -1))).alias("s"))
    b = way.join(m.withColumnRenamed("entity", "b").hint("shuffle_merge"), "b").withColumn("bucket", bucket).select("e1", "e2", "ahead", "bucket", "c", from_).select("e1", "e2", "ahead", "bucket", "c", step(F.col("at"), 1, 0).alias("s"))
    one = ["e1", "e2", "ahead", "bucket"]
    every = a.unionByName(b).select(*one, "c", "s.*").withColumn("stretch", F.floor(F.col("time") * STRETCHES / width).cast("int"))
    every = stored(every, "lag-steps")
    totals = every.groupBy(*one, "stretch").agg(F.sum("n").alias("n0"), F.sum("sum").alias("sum0"))
    before = Window.partitionBy(*one).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    starts = totals.select(*one, "stretch", F.coalesce(F.sum("n0").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("sum0").over(before), F.lit(0)).alias("sum0"))
    so_far = Window.partitionBy(*one, "stretch").orderBy("time", "rank").rowsBetween(Window.unboundedPreceding, 0)
    within = every.withColumn("open", F.sum("n").over(so_far)).withColumn("opened", F.sum("sum").over(so_far)).where("rank = 1")
    within = within.join(stored(starts, "lag-starts").hint("shuffle_merge"), [*one, "stretch"]).withColumn("open", F.col("open") + F.col("n0")).withColumn("opened", F.col("opened") + F.col("sum0"))
    lag = F.col("c") * (F.col("time") * F.col("open") - F.col("opened")).cast("decimal(37,0)")
    s = within.where("open > 0").groupBy("e1", "e2").agg(*(x for i, way_ in ((1, F.col("ahead")), (2, ~F.col("ahead"))) for x in (F.coalesce(F.sum(F.when(way_, F.col("c") * F.col("open"))), F.lit(0)).alias(f"n{i}"), F.sum(F.when(way_, lag)).cast("double").alias(f"s{i}"))))
    return s.select("e1", "e2", "n1", "n2", *(F.try_divide(F.col(f"s{i}") / 3_600_000_000, F.col(f"n{i}")).alias(f"l{i}") for i in (1, 2)))


def lag_candidates(mentions: DataFrame, pairs: DataFrame, min_hours: float = 6, max_days: int = 14, min_samples: int = 2, min_docs: int = 5) -> DataFrame:
    """Directed candidates: the direction with more than twice the samples of the other."""
    pairs = stored(pairs, "lag-pairs")
    dated = mentions.where(F.col("ts").isNotNull()).agg(F.countDistinct("doc_id").alias("docs"))
    m = of_ends(mentions, pairs)
    seen = m.groupBy("entity").agg(F.count("*").alias("k"))
    s = stored(lag_sums(m, pairs, min_hours, max_days), "lag-sums")
    s = s.join(seen.select(F.col("entity").alias("e1"), F.col("k").alias("k1")), "e1").join(seen.select(F.col("entity").alias("e2"), F.col("k").alias("k2")), "e2").crossJoin(F.broadcast(dated))  # one row
    s = s.where((F.col("k1") >= 2) & (F.col("k2") >= 2) & (F.greatest("n1", "n2") >= min_samples) & (F.col("docs") >= min_docs))
    fwd, rev = F.col("n1") > 2 * F.col("n2"), F.col("n2") > 2 * F.col("n1")
    n, evidence = F.when(fwd, F.col("n1")).otherwise(F.col("n2")), F.col("k1") + F.col("k2")
    return s.where(fwd | rev).select(
        F.when(fwd, F.col("e1")).otherwise(F.col("e2")).alias("source"),
        F.when(fwd, F.col("e2")).otherwise(F.col("e1")).alias("target"),
        F.round(F.when(fwd, F.col("l1")).otherwise(F.col("l2")), 1).alias("mean_lag_hours"),
        n.alias("lag_samples"),
        F.round(F.least(n / evidence * 0.5 + 0.3, F.lit(1.0)), 3).alias("causal_score"),
        evidence.alias("evidence_strength"),
    )


def top_candidates(candidates: DataFrame, n: int = 100) -> DataFrame:
    return candidates.orderBy(F.desc("causal_score"), "source", "target").limit(n)
