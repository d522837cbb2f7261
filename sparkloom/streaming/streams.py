"""Continuous forms: deduplicated ingest, windowed counts, stateful phases and alert fan-out.

The stateful phases need the RocksDB state store, which the caller sets for the session
that starts them (ROCKSDB).
"""

from __future__ import annotations

import calendar
import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from sparkloom.sources.ingest import article_key, first_per_key
from sparkloom.sources.scratch import stored


def dedup_stream(articles: DataFrame, delay: str = "1 day") -> DataFrame:
    """First row of each article key within the watermark."""
    keyed = articles.select("*", *article_key()).withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["k_title", "k_source", "k_link"]).drop("k_title", "k_source", "k_link")


def dedup_history(articles: DataFrame, path: str, order: list[str], buckets: int = 64, run: str = "main") -> DataStreamWriter:
    """First row of each article key over all history, kept in a store at path; no watermark forgets one.

    The store is Parquet in folders bucket=/batch=.  A batch reads the keys of the buckets that it
    touches, leaves out its own earlier rows and overwrites just its own folders, so that a batch
    that is run again after a crash gives what it gave before.  order says which of a batch's rows
    with one key is first; run names the query, if several write to the store in turn.
    """
    keys = ["k_title", "k_source", "k_link"]
    empty = articles.sparkSession.createDataFrame([], articles.schema).select("*", *article_key(), F.lit(0).alias("bucket"), F.lit("").alias("batch"))
    empty.write.mode("append").partitionBy("bucket", "batch").parquet(path)  # there is a store from here on

    def add(batch: DataFrame, batch_id: int) -> None:
        name = f"{run}-{batch_id}"
        new = first_per_key(batch.select("*", *article_key()), keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        new = stored(new, "batch")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most buckets
        known = batch.sparkSession.read.schema(empty.schema).parquet(path).where(F.col("bucket").isin(touched) & (F.col("batch") != name))
        left = new.join(known.select("bucket", *keys).hint("shuffle_merge"), ["bucket", *keys], "left_anti").withColumn("batch", F.lit(name))
        left.select(*empty.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)

    return articles.writeStream.foreachBatch(add)


def history(spark: SparkSession, path: str) -> DataFrame:
    """The rows that dedup_history keeps at path, with the batch that brought each."""
    return spark.read.parquet(path).drop("k_title", "k_source", "k_link", "bucket")


def daily_counts_stream(mentions: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily counts per entity; a day is final once the watermark has passed it."""
    c = mentions.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "entity").agg(F.count("*").alias("n"))
    return c.select(F.to_date("window.start").alias("day"), "entity", "n")


def sliding_counts(mentions: DataFrame, length: str = "48 hours", slide: str = "1 hour", delay: str = "1 day") -> DataFrame:
    c = mentions.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), "entity").agg(F.count("*").alias("n"))
    return c.select(F.col("window.start").alias("start"), "entity", "n")


def phase_of(counts: list[int]) -> str:
    """The lifecycle phase of active-day counts in order; the same rules as trends.phase_rules."""
    if len(counts) < 3:
        return "emerging"
    recent, rest = counts[-3:], counts[:-3] or counts[:1]
    r, o = sum(recent) / 3, sum(rest) / len(rest)
    if r == 0:
        return "dormant"
    if o == 0:
        return "emerging"
    growth, bend = (r - o) / o, recent[2] - 2 * recent[1] + recent[0]
    rules = [(bend > 0 and growth > 0.5, "accelerating"), (growth > 0.2, "growing"), (growth < -0.2 and bend < 0, "declining"), (growth < -0.5, "fading"), (abs(growth) <= 0.2 and r > o * 0.5, "peaked"), (bend > 0 and growth < 0, "resurging")]
    return next((name for test, name in rules if test), "stable")


#: Session settings of queries with phases.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

DAY_MS = 86_400_000


class PhaseTracker(StatefulProcessor):
    """Keeps an entity's last active days and reports every change of its phase.

    With fade_days or idle_days, a timer in event time reports an entity that goes quiet: as fading
    or dormant when the watermark passes its last day by so many days.  A dormant entity's days are
    forgotten; if it comes back it begins anew.  Only the last DAYS active days are kept, so phases
    of longer series differ from those over all days (trends.phases) in their older part.
    """

    DAYS = 14

    def __init__(self, fade_days: int | None = None, idle_days: int | None = None) -> None:
        self.quiet = sorted((d, name) for d, name in ((fade_days, "fading"), (idle_days, "dormant")) if d)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", "days array<date>, counts array<long>, phase string")

    def _change(self, key, was: str | None, now: str, day) -> pd.DataFrame:
        return pd.DataFrame({"entity": [key[0]], "from_phase": [was], "to_phase": [now], "day": [day]})

    def _wait(self, last) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for days, _ in self.quiet:
            self.handle.registerTimer((calendar.timegm(last.timetuple()) + days * 86_400) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        days, counts, phase = self.series.get() if self.series.exists() else ([], [], None)
        tally = dict(zip(days, counts))
        for part in rows:
            for day, n in zip(part["day"], part["n"]):
                tally[day] = tally.get(day, 0) + int(n)
        order = sorted(tally)[-self.DAYS :]
        now = phase_of([tally[d] for d in order])
        self.series.update((order, [tally[d] for d in order], now))
        if self.quiet:
            self._wait(order[-1])
        if now != phase:
            yield self._change(key, phase, now, order[-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        days, counts, phase = self.series.get()
        passed = (expiredTimerInfo.getExpiryTimeInMs() - calendar.timegm(days[-1].timetuple()) * 1000) // DAY_MS
        now = dict(self.quiet).get(passed, phase)
        if now == "dormant":
            self.series.clear()
        else:
            self.series.update((list(days), list(counts), now))
        if now != phase:
            yield self._change(key, phase, now, days[-1] + datetime.timedelta(days=int(passed)))

    def close(self) -> None:
        pass


def phase_changes(daily: DataFrame, fade_days: int | None = None, idle_days: int | None = None, delay: str = "1 day") -> DataFrame:
    """entity, from_phase, to_phase, day from a stream of (entity, day, n).

    With fade_days or idle_days, quiet entities change when the watermark (delay behind the latest
    day) passes; without, phases change only as rows come.
    """
    kind = "entity string, from_phase string, to_phase string, day date"
    timed = bool(fade_days or idle_days)
    if timed:
        daily = daily.withColumn("ts", F.col("day").cast("timestamp")).withWatermark("ts", delay)
    return daily.groupBy("entity").transformWithStateInPandas(PhaseTracker(fade_days, idle_days), kind, "append", "eventTime" if timed else "none")


def every_quarter_hour(writer: DataStreamWriter) -> DataStreamWriter:
    """The usual cadence; one batch never overlaps the next."""
    return writer.trigger(processingTime="15 minutes")


def fan_out(alerts: DataFrame, path: str, checkpoint: str, first: int = 5) -> DataStreamWriter:
    """Each batch's first alerts by severity are appended to a table: the cap is the feature."""

    def send(batch: DataFrame, batch_id: int) -> None:
        rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
        batch.orderBy(rank, "type", "title").limit(first).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return alerts.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
