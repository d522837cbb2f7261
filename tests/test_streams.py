from pyspark.sql import functions as F

from sparkloom.operators import trends
from sparkloom.plans.bindings import event_mentions, read
from sparkloom.streaming import streams

SF = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.table(name)


def source(spark, tmp_path):
    event_mentions(spark, SF).repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(event_mentions(spark, SF).schema).parquet(str(tmp_path / "in"))


def test_daily_counts_equal_the_batch(spark, tmp_path):
    out = run(streams.daily_counts_stream(source(spark, tmp_path)), "daily")
    batch = trends.daily_counts(event_mentions(spark, SF))
    last = batch.agg(F.max("day")).first()[0]
    got = {(r.entity, r.day): r.n for r in out.collect()}
    want = {(r.entity, r.day): r.n for r in batch.collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert all(k in got for k in want if (last - k[1]).days > 2)


def test_dedup_within_the_watermark(spark, tmp_path):
    rows = read(spark, SF, "events").select(F.concat(F.lit("T "), (F.col("event_id") % 50).cast("string")).alias("title"), F.lit("s").alias("source"), F.lit("l").alias("link"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    out = run(streams.dedup_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "deduped")
    assert out.count() == 50


def test_sliding_counts(spark, tmp_path):
    out = run(streams.sliding_counts(source(spark, tmp_path), "48 hours", "24 hours"), "sliding")
    assert out.count() > 0 and out.agg(F.max("n")).first()[0] >= 1


def test_phase_changes(spark, tmp_path):
    import datetime

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    day = lambda i: datetime.date(2024, 1, i)
    rows = [("a", day(i + 1), n) for i, n in enumerate([10, 7, 4, 2])] + [("b", day(1), 3)]
    df = spark.createDataFrame(rows, "entity string, day date, n long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run(streams.phase_changes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "changes", "append")
    assert {(r.entity, r.to_phase) for r in out.collect()} == {("a", "fading"), ("b", "emerging")}


def test_fan_out(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i}", "high" if i % 2 else "medium", f"x{i:02}") for i in range(20)], "type string, severity string, title string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    w = streams.fan_out(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    w.trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 5 and {r.severity for r in got} == {"high"}
