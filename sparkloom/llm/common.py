"""Shared helpers: scratch tables, word rules and bounded side data."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

# Fixed values of the word rule: a word is a run of characters other than these six.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of ids that may be sent to every executor (8 bytes each); larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share.

    A temporary folder stands in only in local mode, where driver and tasks are one process;
    a cluster without the setting is an error, as its machines would not see each other's files.
    """
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
    """Write df as Parquet in the scratch folder and read it back: lineage ends here.

    The files survive the loss of any executor, and Spark knows their true size when it
    plans the joins that follow.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _open and not kept:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (one stored column): the ids go to every executor if
    there are at most BROADCAST_ROWS of them, else both sides are shuffled by the key."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(ids.hint("broadcast" if few else "shuffle_merge"), key, "left_semi")


def ranked(leaves: DataFrame, *order: str) -> DataFrame:
    """leaves(tree, ...) with at, each row's place in its tree by order, and size, the tree's rows.

    Rows are ranged over all partitions; a row's place is its place in the partition plus the
    tree's rows in the partitions before, of which there are as many as partitions.
    """
    ranged = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = stored(ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "ranged")
    parts = stored(ranged.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("row").alias("first")), "ranged-counts")
    tree = Window.partitionBy("tree")  # a row for each of the tree's partitions
    place = parts.select("tree", "part", F.sum("n").over(tree).alias("size"), (F.col("first") - F.sum("n").over(tree.orderBy("part")) + F.col("n")).alias("start"))
    placed = ranged.join(stored(place, "ranged-parts").hint("shuffle_merge"), ["tree", "part"])
    return placed.withColumn("at", F.col("row") - F.col("start")).drop("row", "part", "start")


def plain_names(docs: DataFrame, *used: str) -> DataFrame:
    """docs with its columns named by their places, but for those used: whatever the others are called
    (with dots or back-ticks, as something internal, as another one in other letters) is no matter then.
    toDF(*docs.columns) brings the names back."""
    return docs.toDF(*(c if c in used and docs.columns.index(c) == i else f"column {i}" for i, c in enumerate(docs.columns)))


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with integer ids: as they are, or if they are of another type their places in order,
    with the stored table (number, id) that leads back."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return docs.withColumn(id_col, F.col(quoted(id_col)).cast("long")), None
    ids = docs.select(F.lit("").alias("tree"), F.col(quoted(id_col)).alias("id")).where("id IS NOT NULL").distinct()
    names = stored(ranked(ids, "id").select(F.col("at").alias("number"), "id"), "ids")
    rows = docs.withColumnRenamed(id_col, "id").join(names.hint("shuffle_merge"), "id", "left")
    return rows.select(*(F.col("number").alias(id_col) if c == id_col else F.col(quoted(c)) for c in docs.columns)), names


def named(rows: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """rows with the ids that numbers in columns stand for, names being what numbered() gave."""
    for c in columns if names is not None else ():
        back = names.select(F.col("number").alias(c), F.col("id").alias("__id"))
        rows = rows.join(back.hint("shuffle_merge"), c, "left").select(*(F.col("__id").alias(x) if x == c else F.col(quoted(x)) for x in rows.columns))
    return rows


def quoted(name: str) -> str:
    """A column's name inside SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string inside SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The expressions below are SQL text: as lambdas inside lambdas, thousands of Column objects would take seconds to build.
# transform(array(x), v -> ...)[0] works x out once however often v is named.

#: Elements that one running total steps through: arrays grow by copies, so they are kept this short.
BLOCK = 64


def running(values: str, combine: str) -> str:
    """SQL: for each of an array of ints >= 0, combine (of x and y) of all before it, 0 for the first.

    Blocks of BLOCK elements are combined first, then their totals, then each block on its
    own, so that work grows with the array and not with its square.
    """
    both = combine.replace("x", "acc.at")
    step = f"(acc, y) -> struct({both} AS at, concat(acc.out, array(acc.at)) AS out), acc -> acc.out"
    totals = f"transform(sequence(0, int((size(items) - 1) div {BLOCK})), b -> aggregate(slice(items, b * {BLOCK} + 1, {BLOCK}), 0, (x, y) -> {combine}))"
    starts = f"aggregate({totals}, struct(0 AS at, cast(array() AS array<int>) AS out), {step})"
    inside = f"aggregate(slice(items, b * {BLOCK} + 1, {BLOCK}), struct(start AS at, cast(array() AS array<int>) AS out), {step})"
    return f"transform(array({values}), items -> IF(size(items) > 0, flatten(transform({starts}, (start, b) -> {inside})), cast(array() AS array<int>)))[0]"


def spans_of(text: str, pattern: str) -> str:
    """SQL: array<struct<start,end,value>> of the leftmost non-overlapping matches of pattern in
    the SQL expression text, in code points, end exclusive.  Empty without a match; null text
    counts as empty.

    The text is split at the matches, so that odd-numbered parts are the matches; they are
    located by adding up the parts' lengths.  U+0001 is the marker; where the text holds one
    it counts as U+0002, which no pattern of this library tells from it, so lengths and
    matches stay as they are.
    """
    parts = f"split(regexp_replace(replace(coalesce({text}, ''), '\\u0001', '\\u0002'), {literal(pattern)}, '\\u0001$0\\u0001'), '\\u0001', -1)"
    starts = running("transform(parts, p -> char_length(p))", "x + y")
    span = "struct(starts[i] AS start, starts[i] + char_length(parts[i]) AS end, parts[i] AS value)"
    found = f"transform(array({starts}), starts -> transform(sequence(1, size(parts) - 1, 2), i -> {span}))[0]"
    return f"transform(array({parts}), parts -> IF(size(parts) > 1, {found}, cast(array() AS array<struct<start:int,end:int,value:string>>)))[0]"


#: Code points of the pieces that texts are cut into before spans of them are taken.
PIECE = 512


def replaced(text: str, spans: str) -> str:
    """SQL: text with spans (array<struct<start,end,put>>, by start) replaced by what they put.

    Of spans that overlap the first one's put stands for all.  Texts are cut into pieces, so
    that taking a stretch costs its own length and no walk from the text's beginning.
    """

    def stretch(a: str, b: str) -> str:
        near = f"array_join(slice(pieces, int({a} div {PIECE}) + 1, int(({b} - 1) div {PIECE}) - int({a} div {PIECE}) + 1), '')"
        return f"IF({b} > {a}, substr({near}, {a} % {PIECE} + 1, {b} - {a}), '')"

    one = f"transform(array(ends[i]), e -> IF(x.start >= e, concat({stretch('e', 'x.start')}, x.put), ''))[0]"
    rest = f"transform(array(greatest(ends[size(ends) - 1], s[size(s) - 1].end)), e -> {stretch('e', 'char_length(t)')})[0]"
    built = f"concat(array_join(transform(s, (x, i) -> {one}), ''), {rest})"
    ends = running("transform(s, x -> x.end)", "greatest(x, y)")
    pieces = f"regexp_extract_all(t, '(?s).{{1,{PIECE}}}', 0)"
    whole = f"transform(array({pieces}), pieces -> transform(array({ends}), ends -> {built})[0])[0]"
    return f"transform(array({text}), t -> transform(array({spans}), s -> IF(size(s) > 0, {whole}, t))[0])[0]"
