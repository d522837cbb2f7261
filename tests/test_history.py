"""Streams that remember: dedup over all history, and entities that go quiet."""

import datetime

from sparkloom.sources.ingest import merge_new
from sparkloom.streaming import streams


def landed(spark, path, rows, n):
    """Rows as n files in order, streamed one file at a time."""
    for i in range(n):
        spark.createDataFrame(rows[i::n], "id long, title string, source string, link string").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("id long, title string, source string, link string").option("maxFilesPerTrigger", 1).parquet(path)


def test_history_dedup_equals_the_batch_and_replays_add_nothing(spark, tmp_path):
    rows = [(i, f"Title {i % 40}", "s" if i % 3 else None, "") for i in range(300)]
    path, store = str(tmp_path / "in"), str(tmp_path / "store")
    stream = landed(spark, path, rows, 4)

    def go(checkpoint):
        streams.dedup_history(stream, store, ["id"], buckets=4).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(240)
        return sorted(tuple(r) for r in streams.history(spark, store).collect())

    found = go("one")
    every = spark.createDataFrame(rows, "id long, title string, source string, link string")
    want = merge_new(every.limit(0), every, "id")
    assert len(found) == want.count() == 80 and {r[1:3] for r in found} == {(r.title, r.source) for r in want.collect()}
    assert len({r[-1] for r in found}) > 1
    # The same batches again, as after a lost checkpoint: each overwrites what it wrote.
    assert go("two") == found
    other = spark.createDataFrame([(900, "TITLE 1 ", "s", None), (901, "new", "s", None)], "id long, title string, source string, link string")
    other.coalesce(1).write.parquet(str(tmp_path / "more"))
    more = spark.readStream.schema(other.schema).parquet(str(tmp_path / "more"))
    streams.dedup_history(more, store, ["id"], buckets=4, run="later").option("checkpointLocation", str(tmp_path / "three")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.id for r in streams.history(spark, store).where("batch like 'later%'").collect()] == [901] and streams.history(spark, store).count() == 81


def test_quiet_entities_fade_once(spark, tmp_path):
    own = spark.newSession()
    for k, v in streams.ROCKSDB.items():
        own.conf.set(k, v)
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    rows = [[("quiet", day(0), 5), ("busy", day(0), 1)], [("busy", day(4), 1)], [("busy", day(12), 1), ("late", day(12), 2)], [("busy", day(13), 1)], [("busy", day(30), 1)]]
    for part in rows:
        own.createDataFrame(part, "entity string, day date, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    daily = own.readStream.schema("entity string, day date, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.phase_changes(daily, fade_days=3, idle_days=7).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    quiet = [r[1:] for r in sorted(got, key=lambda r: r[3]) if r[0] == "quiet"]
    assert quiet == [(None, "emerging", day(0)), ("emerging", "fading", day(3)), ("fading", "dormant", day(7))]
    late = [r[1:] for r in sorted(got, key=lambda r: r[3]) if r[0] == "late"]
    assert late == [(None, "emerging", day(12)), ("emerging", "fading", day(15)), ("fading", "dormant", day(19))]
    assert len(got) == len(set(got))
