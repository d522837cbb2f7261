"""Operator 10, best-fit packing with several permitted sequence lengths.

Texts longer than the longest sequence are cut into full sequences and a rest.  All pieces are
dealt to shards by a hash of the row's number and the piece's (about SHARD_ROWS a shard, so the
number of shards follows the input, whatever the ids) and packed inside each shard, longest
first: a piece goes to the open bin that it fills best, of several the one that came to that
space last.  If none has room, a bin is opened in the size with the least cost per token, where the
size costs its length plus OVERHEAD and is expected to hold the piece and as many of the
shorter pieces still to come as fit.  At the end each bin shrinks to the shortest permitted
length that holds its contents.  A shard's waste is at most one part-filled tail of bins.

Lengths are words; any integer column can stand in.  Defined results: null or empty texts have
length 0 and are returned without a bin; ties go by the row's number, then piece; repeated rows
and ids are packed each; null ids are ids like others, of any type; extra columns are ignored;
an empty table gives no rows.  Rows are numbered as they are first written, so a lost task
finds the same numbers; another split of the input may deal the shards otherwise.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, plain_names, quoted, stored

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16
SHARD_ROWS = 5_000


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """sizes, longest first -> each piece's bin and offset, and each bin's final length."""
    negative = [-s for s in sizes]
    ahead = np.concatenate([np.cumsum(np.array(sizes[::-1], dtype=np.int64))[::-1], [0]]).tolist()  # tokens from a piece on
    spaces: dict[int, list[int]] = {}  # space left -> bins, the newest last
    mask = 0
    bins, offsets, used, opened = [], [], [], []
    for i, size in enumerate(sizes):
        above = mask >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            b = spaces[space].pop()
            if not spaces[space]:
                mask ^= 1 << space
        else:
            best = None
            for length in lengths:
                if length >= size:
                    later = bisect_left(negative, -(length - size), lo=i + 1)
                    held = size + min(length - size, ahead[later])
                    cost = ((length + overhead) / held, length)
                    best = cost if best is None or cost < best else best
            b, space = len(used), best[1]
            used.append(0)
            opened.append(space)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        left = space - size
        spaces.setdefault(left, []).append(b)
        mask |= 1 << left
    return bins, offsets, [next(x for x in lengths if x >= u) for u in used]


def pieces(sized: DataFrame, longest: int) -> DataFrame:
    """sized(id, row, size) -> id, row, piece, start, length."""
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / longest).cast("int"))).alias("piece")
    start = (F.col("piece") * longest).cast("long")
    return sized.where("size > 0").select("id", "row", "size", cut).select("id", "row", "piece", start.alias("start"), F.least(F.lit(longest), F.col("size") - start).cast("long").alias("length"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id_col, piece, start, length, shard, bin, offset, bin_length), a row for each piece."""
    lengths = tuple(sorted(lengths))
    size = F.col(quoted(length_col)) if length_col else F.regexp_count(F.coalesce(F.col(quoted(text_col)), F.lit("")), F.lit(WORD))
    rows = plain_names(docs, id_col, length_col or text_col)
    sized = rows.select(F.col(quoted(id_col)).alias("id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    sized = stored(sized.withColumn("row", F.monotonically_increasing_id()), "pack-sizes")
    total = sized.agg(F.sum(F.ceil(F.col("size") / lengths[-1]))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_rows))
    parts = pieces(sized, lengths[-1]).withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(neg=-rows["length"]).sort_values(["neg", "row", "piece"], kind="stable")
        bins, offsets, final = pack(rows["length"].tolist(), lengths, overhead)
        return rows.drop(columns=["neg", "row"]).assign(bin=bins, offset=offsets, bin_length=[final[b] for b in bins])

    schema = f"id {sized.schema['id'].dataType.simpleString()}, piece int, start long, length long, shard int, bin long, offset long, bin_length long"
    done = parts.groupBy("shard").applyInPandas(run, schema)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("shard", "int"), ("bin", "long"), ("offset", "long"), ("bin_length", "long"))]
    empty = sized.where("size <= 0").select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), *none)
    return done.unionByName(empty).withColumnRenamed("id", id_col)


def op10_packing(docs: DataFrame) -> DataFrame:
    return packed(docs.select("doc_id", "text"))
