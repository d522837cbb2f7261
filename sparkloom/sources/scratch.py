"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side table that may be sent to every executor; larger ones are shuffled.
SMALL_ROWS = 100_000


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where all runs in one
    process.  A cluster without the setting is an error: its machines share no temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-loom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables written inside scratch(), innermost last.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes inside are deleted at the end: write the result elsewhere before,
    or by stored(..., kept=True)."""
    mine: list[str] = []
    _open.append(mine)
    try:
        yield
    finally:
        _open.remove(mine)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in mine:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def stored(df: DataFrame, what: str, kept: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; lineage ends here."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{what}-{uuid.uuid4().hex}"
    if _open and not kept:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, a join's side, with the hint that its counted size allows: broadcast, or shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_merge")


def looked_up(rows: DataFrame, dimension: DataFrame, on: str | list[str], parts: int | Callable[[], int], how: str = "inner") -> DataFrame:
    """rows joined with dimension: broadcast if its counted size allows, else both in so many partitions."""
    if dimension.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(dimension), on, how)
    n = parts if isinstance(parts, int) else parts()
    keys = [on] if isinstance(on, str) else on
    return rows.repartition(n, *keys).join(dimension.repartition(n, *keys).hint("shuffle_merge"), on, how)
