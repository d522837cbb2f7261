"""A table kept by key, changed by copy-on-write: a merge rewrites the buckets that it touches alone.

Rows lie in folders data/bucket=/version=, and manifests/version= names for each bucket the version
that counts.  A merge writes new versions of its buckets first and the next manifest last, as
one file that appears as a whole: a reader sees the table before or after a merge, and one that
was cut off leaves the table as it was (what it wrote is overwritten by the next).  One writer
at a time; readers at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.scratch import stored

BUCKETS = 64


def _data(spark: SparkSession, path: str, buckets: list, schema) -> DataFrame | None:
    if not buckets:
        return None
    places = [f"{path}/data/bucket={r.bucket}/version={r.version}" for r in buckets]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*places)


def _current(spark: SparkSession, path: str) -> tuple[int, list]:
    """Number and rows(bucket, version) of the newest manifest: a row for each bucket."""
    every = spark.read.schema("bucket int, version int, manifest int").parquet(f"{path}/manifests")
    last = every.agg(F.max("manifest")).first()[0]
    return last, every.where(F.col("manifest") == last).select("bucket", "version").where("bucket >= 0").collect()


def create(spark: SparkSession, path: str) -> None:
    """An empty table; one that is there already stays."""
    none = spark.createDataFrame([(-1, 0, 0)], "bucket int, version int, manifest int")
    none.coalesce(1).write.mode("ignore").partitionBy("manifest").parquet(f"{path}/manifests")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows as of now."""
    found = _data(spark, path, _current(spark, path)[1], f"{schema}, bucket int, version int")
    return spark.createDataFrame([], schema) if found is None else found.drop("bucket", "version")


def merge(spark: SparkSession, path: str, new: DataFrame, key: list[str], order: str, buckets: int = BUCKETS, publish: bool = True) -> list[int]:
    """Upsert: of each key the row of the largest order stays, the new one of equals.  Returns the buckets
    that were rewritten.  publish=False stops before the manifest, as a crash would."""
    version, held = _current(spark, path)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    fresh = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), order).alias("row")).select("row.*").withColumn("bucket", bucket)
    fresh = stored(fresh, "merge-new")
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # at most buckets
    if not touched:
        return []
    old = _data(spark, path, [r for r in held if r.bucket in set(touched)], f"{new.schema.simpleString()[7:-1].replace(':', ' ')}, bucket int, version int")
    both = fresh.withColumn("__new", F.lit(1))
    if old is not None:
        both = both.unionByName(old.drop("version").withColumn("__new", F.lit(0)))
    rows = both.groupBy(*key).agg(F.max_by(F.struct(*fresh.columns), F.struct(order, "__new")).alias("row")).select("row.*")
    rows = rows.withColumn("version", F.lit(version + 1)).repartition("bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{path}/data")
    if publish:
        now = {r.bucket: r.version for r in held} | dict.fromkeys(touched, version + 1)
        manifest = spark.createDataFrame([(b, v, version + 1) for b, v in sorted(now.items())], "bucket int, version int, manifest int")
        manifest.coalesce(1).write.mode("append").partitionBy("manifest").parquet(f"{path}/manifests")
    return touched


def vacuum(spark: SparkSession, path: str) -> int:
    """Old versions that no newest manifest names are deleted, once no reader needs them; their number."""
    keep = {(r.bucket, r.version) for r in _current(spark, path)[1]}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for b in files.listStatus(root) if files.exists(root) else []:
        if b.isDirectory():
            for v in files.listStatus(b.getPath()):
                at = tuple(int(p.rpartition("=")[2]) for p in (b.getPath().getName(), v.getPath().getName()))
                if at not in keep:
                    files.delete(v.getPath(), True)
                    gone += 1
    return gone
