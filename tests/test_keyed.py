import glob
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import keyed

SCHEMA = "k long, name string, at long"


def rows(spark, path):
    return {r.k: (r.name, r.at) for r in keyed.read(spark, path, SCHEMA).collect()}


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_merges_touch_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark, path)
    keyed.create(spark, path)
    assert rows(spark, path) == {} and keyed.merge(spark, path, spark.createDataFrame([], SCHEMA), ["k"], "at") == []
    first = spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("name"), F.lit(1).cast("long").alias("at"))
    assert keyed.merge(spark, path, first, ["k"], "at", 8) == list(range(8))
    old = files(path)
    new = spark.createDataFrame([(5, "b", 2), (5, "c", 3), (6, "late", 0), (None, "none", 1), (7, "same", 1)], SCHEMA)
    touched = keyed.merge(spark, path, new, ["k"], "at", 8)
    assert rows(spark, path) == {i: ("a", 1) for i in range(200)} | {5: ("c", 3), 7: ("same", 1), None: ("none", 1)}
    mine = files(path) - old
    assert old <= files(path) and {int(f.split("bucket=")[1].split("/")[0]) for f in mine} == set(touched) and len(touched) < 8
    before = rows(spark, path)
    assert keyed.vacuum(spark, path) == len(touched) and rows(spark, path) == before


@pytest.mark.parametrize("again", [True, False])
def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, again):
    path = str(tmp_path / "t")
    keyed.create(spark, path)
    keyed.merge(spark, path, spark.createDataFrame([(i, "a", 1) for i in range(20)], SCHEMA), ["k"], "at", 4)
    before = rows(spark, path)
    lost = spark.createDataFrame([(3, "lost", 9), (90, "lost", 9)], SCHEMA)
    keyed.merge(spark, path, lost, ["k"], "at", 4, publish=False)
    assert rows(spark, path) == before
    keyed.merge(spark, path, lost if again else spark.createDataFrame([(4, "d", 2)], SCHEMA), ["k"], "at", 4)
    assert rows(spark, path) == before | ({3: ("lost", 9), 90: ("lost", 9)} if again else {4: ("d", 2)})


def test_scratch_tables_go_with_their_context(spark):
    from sparkloom.sources.scratch import folder, scratch, stored

    place = folder(spark).removeprefix("file://")
    with scratch(spark):
        stored(spark.range(3), "mine")
        kept = stored(stored(spark.range(5), "inner"), "kept", kept=True)
        assert any(x.startswith("mine-") for x in os.listdir(place))
    assert kept.count() == 5 and not any(x.startswith(("mine-", "inner-")) for x in os.listdir(place))
