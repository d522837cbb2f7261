"""Operator 9, language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams per language are added up by Spark over all training rows; the
log-probability matrix (BUCKETS x languages, in fixed point, so that sums do not depend on
their order) goes to every task.  There whole batches of texts become one sparse table of
(text, bucket, count), which is multiplied with the matrix in numpy.  A language's prior is its
share of the training texts.  Letters (categories L, lower-cased) and the marks on them
(M) make words; runs of anything else count as one space.

A matrix holds at most MAX_MODEL_CELLS cells.  More languages than that are scored by several
matrices, whose winners are compared, so that no label is left out.

The score is the winner's posterior for TEMPER n-grams of the text's average, so it stays
informative on long texts.  Defined results: texts that are null or have no letter give `und`
with score 0; ties go to the alphabetically first language; without any training row every
text gives `und`; repeated rows count as often as they occur; extra columns are ignored (one
named as the output is replaced).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
ALPHA = 0.5
TEMPER = 20.0
MAX_MODEL_CELLS = 1 << 22  # bound of each matrix that is sent to the driver and the tasks: 32 MB
MAX_OPEN_LANGS = 64  # languages whose counts a training task holds at once
BATCH_CHARS = 1 << 19
FIXED = 1 << 24
MUL = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(64 - 14)


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case if it is a letter, itself if a mark, else a space; and whether it is a letter."""
    table, letter = np.full(sys.maxunicode + 1, 32, dtype=np.uint32), np.zeros(sys.maxunicode + 1, dtype=bool)
    for point, char in enumerate(map(chr, range(sys.maxunicode + 1))):
        sort = unicodedata.category(char)[0]
        if sort == "L":
            low = char.lower()
            table[point], letter[point] = ord(low) if len(low) == 1 else point, True
        elif sort == "M":
            table[point] = point
    return table, letter


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and bucket of every n-gram; texts without a letter have none."""
    points = np.frombuffer("".join(f" {t} " if t else " " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t) + 2 if t else 1 for t in texts])
    table, letter = letter_tables()
    lettered = np.bincount(of[letter[points]], minlength=len(texts)) > 0
    low = table[points]
    space = low == 32
    # One space between words, and one at either end of a text.
    keep = lettered[of] & ~(space & np.concatenate([[False], space[:-1] & (of[1:] == of[:-1])]))
    low, of = low[keep].astype(np.uint64), of[keep]
    texts_of, buckets, code = [], [], np.zeros(len(low), dtype=np.uint64)
    for n in ORDERS:
        if len(low) < n:
            break
        code = (code[:-1] if n > 1 else code) * np.uint64(0x110001) + low[n - 1 :] + np.uint64(n)
        inside = of[: len(of) - n + 1] == of[n - 1 :]
        texts_of.append(of[: len(of) - n + 1][inside])
        buckets.append(((code * MUL) >> SHIFT)[inside].astype(np.int64))
    return (np.concatenate(texts_of), np.concatenate(buckets)) if texts_of else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def batched(texts: list[str | None]) -> Iterator[slice]:
    """Stretches of texts with about BATCH_CHARS characters each."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars > BATCH_CHARS:
            yield slice(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, text) -> lang, bucket, n, summed over all rows; bucket -1 counts the texts."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array((at - 1).astype(np.int32)), pa.array(n[at])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for part in batched(texts):
                of, buckets = grams(texts[part])
                order = np.argsort(of, kind="stable")
                ends = np.searchsorted(of[order], np.arange(part.stop - part.start + 1))
                buckets = buckets[order] + 1
                for i, lang in enumerate(langs[part]):
                    if ends[i] == ends[i + 1]:
                        continue
                    if lang not in sums:
                        if len(sums) == MAX_OPEN_LANGS:  # dirty labels: counts go out in parts, and Spark adds them up
                            yield from rows(sums)
                            sums = {}
                        sums[lang] = np.zeros(BUCKETS + 1, dtype=np.int64)
                    sums[lang] += np.bincount(buckets[ends[i] : ends[i + 1]], minlength=BUCKETS + 1)
                    sums[lang][0] += 1
        yield from rows(sums)

    return docs.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


Model = list[tuple[list[str], np.ndarray, np.ndarray]]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_cells: int = MAX_MODEL_CELLS) -> Model:
    """Matrices of bounded size: the languages in order, log P(bucket | language), log P(language)."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = stored(gram_counts(rows), "nb-counts")
    known = counts.where("bucket = -1").orderBy("lang").collect()
    total = sum(r.n for r in known)
    wide = max(1, max_cells // BUCKETS)
    model = []
    for i in range(0, len(known), wide):
        langs = [r.lang for r in known[i : i + wide]]
        order = {lang: k for k, lang in enumerate(langs)}
        table = np.full((len(langs), BUCKETS), ALPHA)
        part = counts.where((F.col("bucket") >= 0) & F.col("lang").between(langs[0], langs[-1]))
        cells = part.toArrow()
        at = np.array([order[x] for x in cells.column("lang").to_pylist()], dtype=np.int64)
        table[at, cells.column("bucket").to_numpy()] += cells.column("n").to_numpy()
        logs = np.log(table) - np.log(table.sum(axis=1, keepdims=True))
        prior = np.log(np.array([r.n for r in known[i : i + wide]]) / total)
        model.append((langs, np.round(logs * FIXED).astype(np.int64), np.round(prior * FIXED).astype(np.int64)))
    return model


def totals(texts: list[str | None], logs: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood with prior of each text in each language, and each text's n-grams."""
    of, buckets = grams(texts)
    cells, n = np.unique(of * BUCKETS + buckets, return_counts=True)
    rows, at = cells // BUCKETS, cells % BUCKETS
    out = np.tile(prior[:, None], (1, len(texts)))
    used, first = np.unique(rows, return_index=True)
    if len(used):
        for lang in range(len(logs)):
            out[lang, used] += np.add.reduceat(logs[lang, at] * n, first)
    return out, np.bincount(of, minlength=len(texts))


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "__lang") -> DataFrame:
    """docs with one more column, struct<lang_pred, score>."""

    def scored(part: tuple) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(part)

        @F.pandas_udf("lang string, best double, rest double")
        def of_matrix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            langs, logs, prior = shared.value
            for series in batches:
                texts, frames = series.tolist(), []
                for stretch in batched(texts):
                    total, n = totals(texts[stretch], logs, prior)
                    scaled = total / FIXED * (TEMPER / np.maximum(n, 1))
                    best = total.argmax(axis=0)
                    high = scaled[best, np.arange(len(n))]
                    frames.append(pd.DataFrame({"lang": [langs[b] if k else None for b, k in zip(best, n)], "best": high, "rest": np.exp(scaled - high).sum(axis=0)}))
                yield pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({"lang": pd.Series(dtype=object), "best": pd.Series(dtype=float), "rest": pd.Series(dtype=float)})

        return of_matrix(F.col(text_col))

    und = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model:
        return docs.withColumn(out, und)
    # (best, language first in the alphabet) wins over all matrices; the posterior's sum runs over all of them.
    rows = docs.withColumn(out, F.array(*(scored(part) for part in model)))
    win = F.reduce(out, F.get(out, F.lit(0)), lambda a, b: F.when(b["best"] > a["best"], b).otherwise(a))
    rows = rows.withColumn(out, F.struct(F.col(out).alias("all"), win.alias("win")))
    total = F.aggregate(f"{out}.all", F.lit(0.0), lambda acc, x: acc + x["rest"] * F.exp(x["best"] - F.col(f"{out}.win.best")))
    found = F.struct(F.col(f"{out}.win.lang").alias("lang_pred"), (1 / total).alias("score"))
    return rows.withColumn(out, F.when(F.col(f"{out}.win.lang").isNull(), und).otherwise(found))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_language(docs: DataFrame) -> DataFrame:
    """One row per document: held_out, lang_pred and score, learned from the other two thirds."""
    rows = docs.select("doc_id", "text", "lang")
    model = train(rows.where(~held_out(F.col("doc_id"))))
    found = predict(rows.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "__lang.lang_pred", F.round("__lang.score", 6).alias("score"))
