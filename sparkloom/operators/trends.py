"""Time series of mentions: daily counts, velocity, anomalies, bursts, phases and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(mentions: DataFrame, key: str = "entity") -> DataFrame:
    """key, day, n; undated rows are dropped."""
    return mentions.where(F.col("ts").isNotNull()).groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def velocity(daily: DataFrame, recent_days: int = 7) -> DataFrame:
    """Rates of the last active days against the earlier ones, for entities seen often enough."""
    back = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("day")))
    late = F.col("back") <= recent_days
    sums = daily.withColumn("back", back).groupBy("entity").agg(
        F.sum("n").alias("total_mentions"),
        F.count("*").alias("unique_days"),
        F.sum(F.when(late, F.col("n")).otherwise(0)).alias("rn"),
        F.sum(F.when(~late, F.col("n")).otherwise(0)).alias("pn"),
    ).where("total_mentions >= 3 AND unique_days >= 2")
    recent = F.col("rn") / F.least("unique_days", F.lit(recent_days))
    prior = F.col("pn") / F.greatest(F.col("unique_days") - recent_days, F.lit(1))
    v = recent - prior
    a = v / F.greatest(prior, F.lit(0.1))
    return sums.select(
        "entity", "total_mentions", "unique_days", F.round(recent, 2).alias("recent_rate"), F.round(prior, 2).alias("prior_rate"),
        F.round(v, 2).alias("velocity"), F.round(a, 2).alias("acceleration"),
        F.when(a > 1.5, "accelerating").when(a < -1.5, "decelerating").otherwise("stable").alias("trend"),
        F.round(F.abs(a) / F.greatest(F.abs(v) + 0.1, F.lit(1.0)), 3).alias("anomaly_score"),
    )


def velocity_anomalies(v: DataFrame, threshold: float = 2.0, min_entities: int = 5) -> DataFrame:
    """Entities whose acceleration lies far from the mean of all."""
    m = v.agg(F.count("*").alias("k"), F.avg("acceleration").alias("mean"), F.stddev_pop("acceleration").alias("sd"))
    z = (F.col("acceleration") - F.col("mean")) / F.col("sd")
    out = v.crossJoin(F.broadcast(m)).where((F.col("k") >= min_entities) & (F.col("sd") > 0))  # one row
    return out.withColumn("z_score", F.round(z, 2)).where(F.abs(z) >= threshold).withColumn("anomaly_type", F.when(F.col("z_score") > 0, "spike").otherwise("drop")).drop("k", "mean", "sd")


def bursts(daily: DataFrame, min_z: float = 2.5, min_count: int = 2, min_days: int = 5) -> DataFrame:
    """Days on which an entity stands out of its dense daily series, days without mention counted
    as zeros: the moments come from sparse sums, and no series is filled up."""
    days = daily.agg(F.countDistinct("day").alias("d"))
    sums = daily.groupBy("entity").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    m = sums.crossJoin(F.broadcast(days)).where(F.col("d") >= min_days)  # one row
    m = m.select("entity", (F.col("s") / F.col("d")).alias("mean"), F.sqrt((F.col("q") * F.col("d") - F.col("s") * F.col("s")).cast("double")).alias("root"), "d").where("root > 0")
    z = (F.col("n") - F.col("mean")) / (F.col("root") / F.col("d"))
    out = daily.join(m, "entity").where((F.col("n") >= min_count) & (z >= min_z))
    return out.select("entity", "day", F.round(z, 2).alias("burst_factor"), F.col("n").alias("count"), F.round("mean", 2).alias("expected"))


def top_bursts(b: DataFrame, n: int = 100) -> DataFrame:
    return b.orderBy(F.desc("burst_factor"), "entity", "day").limit(n)


def phase_rules(points: Column, recent: Column, older: Column, acceleration: Column) -> Column:
    """The phase of a series from its number of points, the means of its last and earlier points,
    and the second difference of the last three."""
    growth = (recent - older) / older
    return (
        F.when(points < 3, "emerging")
        .when(recent == 0, "dormant")
        .when(older == 0, "emerging")
        .when((acceleration > 0) & (growth > 0.5), "accelerating")
        .when(growth > 0.2, "growing")
        .when((growth < -0.2) & (acceleration < 0), "declining")
        .when(growth < -0.5, "fading")
        .when((F.abs(growth) <= 0.2) & (recent > older * 0.5), "peaked")
        .when((acceleration > 0) & (growth < 0), "resurging")
        .otherwise("stable")
    )


def phase_of_series(counts: Column) -> Column:
    """The phase of an array of counts in order of time."""
    n = F.size(counts)
    at = lambda i: F.element_at(counts, F.when(n >= 3, F.lit(i)).otherwise(F.lit(-1))).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    older = F.when(n > 3, total(F.slice(counts, 1, F.greatest(n - 3, F.lit(1)))) / (n - 3)).otherwise(at(-3))
    return F.when(n < 3, "emerging").otherwise(phase_rules(n, (at(-1) + at(-2) + at(-3)) / 3, older, at(-1) - 2 * at(-2) + at(-3)))


def phases(daily: DataFrame, key: str = "entity") -> DataFrame:
    """key, points, phase: from the sparse series, by position from its end."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("day")))
    at = lambda i: F.max(F.when(F.col("back") == i, F.col("n")))
    s = daily.withColumn("back", back).groupBy(key).agg(
        F.count("*").alias("points"), at(1).alias("c1"), at(2).alias("c2"), at(3).alias("c3"),
        F.avg(F.when(F.col("back") > 3, F.col("n"))).alias("rest"),
    )
    recent = (F.col("c1") + F.col("c2") + F.col("c3")) / 3
    older = F.coalesce("rest", F.col("c3").cast("double"))
    return s.select(key, "points", phase_rules(F.col("points"), recent, older, F.col("c1") - 2 * F.col("c2") + F.col("c3")).alias("phase"))


def narratives(daily: DataFrame, key: str = "entity", min_days: int = 2, min_length: int = 0, with_trajectory: bool = False) -> DataFrame:
    """Per key: total, active days, phase, mentions of the last 7 active days and the 7 before."""
    w = Window.partitionBy(key).orderBy(F.desc("day"))
    d = daily.withColumn("back", F.row_number().over(w))
    aggs = [
        F.sum("n").alias("total_mentions"), F.count("*").alias("active_days"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"),
        F.sum(F.when(F.col("back") <= 7, F.col("n"))).alias("r7"), F.sum(F.when(F.col("back").between(8, 14), F.col("n"))).alias("p7"),
    ]
    if with_trajectory:
        aggs.append(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("trajectory"))
    s = d.groupBy(key).agg(*aggs).where((F.col("active_days") >= min_days) & (F.length(key) > min_length))
    recent = F.when(F.col("active_days") >= 7, F.col("r7")).otherwise(F.col("total_mentions"))
    previous = F.when(F.col("active_days") >= 14, F.col("p7")).otherwise(F.lit(0).cast("long"))
    s = s.withColumn("recent_7_days", recent).withColumn("previous_7_days", previous).withColumn("acceleration", recent - previous).drop("r7", "p7")
    return s.join(phases(daily, key).select(key, "phase"), key)


def phase_transitions(v: DataFrame, current: DataFrame) -> DataFrame:
    """Expected next phase of velocities v, given current(entity, phase); unknown counts as stable."""
    j = v.join(current, "entity", "left").withColumn("phase", F.coalesce("phase", F.lit("stable")))
    a, s, p = F.col("acceleration"), F.col("velocity"), F.col("phase")
    rules = [
        (p.isin("emerging", "growing") & (a > 2.0) & (s > 1.0), "accelerating", F.least(a * 0.15, F.lit(0.95)), "Sustained velocity increase suggests acceleration phase"),
        (p.isin("accelerating", "growing") & (a < -1.0) & (s < 0), "peaked", F.least(F.abs(a) * 0.2, F.lit(0.90)), "Velocity decrease from high levels suggests peak reached"),
        (p.isin("declining", "peaked") & (a < -1.5) & (s < -1.0), "fading", F.least(F.abs(a) * 0.15, F.lit(0.90)), "Accelerating decline indicates fading phase"),
        (p.isin("fading", "dormant") & (a > 1.5) & (s > 0.5), "resurging", F.least(a * 0.15, F.lit(0.85)), "Renewed velocity after decline suggests resurgence"),
        ((F.col("trend") == "stable") & (F.abs(s) < 0.5), "stable", F.lit(0.6), "Consistent mention rate with no significant trend"),
    ]
    pick = None
    for test, phase, conf, why in rules:
        row = F.struct(F.lit(phase).alias("predicted_phase"), F.round(conf, 3).alias("confidence"), F.lit(why).alias("reason"))
        pick = F.when(test, row) if pick is None else pick.when(test, row)
    j = j.withColumn("t", pick).where("t.confidence > 0.4")
    return j.select("entity", F.col("phase").alias("current_phase"), "t.predicted_phase", "t.confidence", "t.reason", "velocity", "acceleration")


def velocity_summary(v: DataFrame) -> DataFrame:
    return v.agg(F.count("*").alias("entities"), F.count_if(F.col("trend") == "accelerating").alias("accelerating"), F.count_if(F.col("trend") == "decelerating").alias("decelerating"), F.max("velocity").alias("max_velocity"), F.min("velocity").alias("min_velocity"))


def entity_trends(daily: DataFrame, recent_days: int = 7) -> DataFrame:
    """total, recent (calendar days up to the last day of all), momentum and the busiest day."""
    last = daily.agg(F.max("day").alias("last"))
    d = daily.crossJoin(F.broadcast(last))  # one row
    s = d.groupBy("entity").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("day") > F.date_sub("last", recent_days), F.col("n")).otherwise(0)).alias("recent"), F.max(F.struct("n", (-F.datediff("day", F.lit("1970-01-01"))).alias("early"), "day"))["day"].alias("peak_day"))
    return s.withColumn("momentum", 2 * F.col("recent") - F.col("total"))
