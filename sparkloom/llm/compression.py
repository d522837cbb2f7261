"""Operator 12, toxicity by compression distance: which class's dictionary compresses a text better.

One zstandard dictionary is trained on toxic and one on ordinary labelled texts.  Texts are cut at
words into windows of about WINDOW bytes; each window is compressed with either dictionary, and a
text's distance is the bytes that the toxic one saves over the ordinary one, per byte of text.
Texts of labelled rows that no dictionary has seen calibrate it: distances are mapped to the
share of toxic texts among them, never falling as the distance grows (isotonic regression).

Two things let so short matches count.  Each byte of a word is replaced by a hash of the word
up to it (`chained`), so that matches begin where words do, and what isn't matched can't be
shortened by letter frequencies.  And what both classes use goes into both dictionaries alike, so
that it cancels out: own words of a class are those whose share of its texts is, with a margin of
two standard errors, OVER times their share of the other's; common ones show no such lean.

The classifier is fitted on a bounded sample of labelled rows: of each class the TRAIN_ROWS
labels of least hash, two thirds for the dictionaries and one for calibration, weighted back to
the classes' real sizes.  Scoring covers whole texts of all rows.

Defined results: null texts and texts without a word have distance 0 and the score that such
texts get; an id labelled twice counts as toxic if one label says so; null ids are never
learned from, and count as not held out; with labels of one class only (or none) every score
is that class (or 0); repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored

TRAIN_ROWS = 20_000  # labelled rows of each class that are learned from, at most
DICTIONARY_TEXTS = 2_000  # of these, texts of each class from which its dictionary is trained, at most
OWN_WORDS, COMMON_WORDS = 4_000, 1_000  # words that make the dictionaries, at most
OVER, MIN_TEXTS = 4.0, 3
WINDOW, PART_BYTES, MIN_MATCH = 400, 32_768, 5
BATCH_CHARS = 1 << 19
OPEN_WORDS = 300_000
THRESHOLD = 0.3

SEPARATORS = re.compile(r"[\W_]+")
MUL = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
BACK = pow(MUL, -1, 1 << 64)


def spaced(text: str | None) -> str:
    """Lower-case words, one space after each."""
    return SEPARATORS.sub(" ", f"{text.lower()} ").lstrip(" ") if text else ""


def chained(line: bytes) -> np.ndarray:
    """Each byte of the line's words (and the space that ends one) as a hash of its word up to it."""
    a = np.frombuffer(line, dtype=np.uint8)
    power, back = np.full(len(a), MUL, dtype=np.uint64), np.full(len(a), BACK, dtype=np.uint64)
    power[:1], back[:1] = 1, 1
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    starts = np.concatenate([np.zeros(1, dtype=np.int64), np.flatnonzero(a == 32) + 1])[:-1]
    start = np.repeat(starts, np.diff(np.concatenate([starts, [len(a)]])))
    h = (sums[1:] - sums[start]) * back[start]
    h ^= h >> np.uint64(32)
    return ((h * MIX) >> np.uint64(56)).astype(np.uint8)


def pieces(text: str | None) -> Iterator[bytes]:
    """The text's words as bytes, in pieces of about BATCH_CHARS that end with a word."""
    line = spaced(text).encode("utf-8", "surrogatepass")
    at = 0
    while at < len(line):
        end = line.rfind(b" ", at, at + BATCH_CHARS) + 1 or line.index(b" ", at) + 1
        yield line[at:end]
        at = end


def windows(line: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """Chained bytes of the line in windows of whole words, of at most size bytes if words allow."""
    raw = chained(line).tobytes()
    at = 0
    while at < len(line):
        end = len(line) if len(line) <= at + size else line.rfind(b" ", at, at + size) + 1 or line.index(b" ", at) + 1
        yield raw[at:end]
        at = end


class Distance:
    """Compressed lengths by the two dictionaries, as made by dictionaries()."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        rule = zstandard.ZstdCompressionParameters(
            compression_level=3, strategy=zstandard.STRATEGY_FAST, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        made = (zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in (toxic, ordinary))
        self.toxic, self.ordinary = (zstandard.ZstdCompressor(dict_data=d, compression_params=rule) for d in made)
        self.mark = toxic[-MARK:]

    def __call__(self, text: str | None) -> float:
        """Bytes that the toxic dictionary saves more than the ordinary one, per byte.  Each window
        follows the mark that ends both dictionaries, as zstandard stores what gains too little."""
        saved = size = 0
        for line in pieces(text):
            size += len(line)
            for window in windows(line):
                saved += len(self.ordinary.compress(self.mark + window)) - len(self.toxic.compress(self.mark + window))
        return saved / size if size else 0.0


MARK = 64


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[int]]:
    """docs(id, text) and labels(id, toxic) -> stored id, text, toxic, fold of the learned rows; and
    the number of ordinary and toxic labels there are."""
    known = labels.where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = stored(known.withColumn("h", F.xxhash64("id")), "toxic-labels")
    count = {r.toxic: r.n for r in known.groupBy(F.col("toxic") > 0).agg(F.count("*").alias("n")).toDF("toxic", "n").collect()}
    part = [known.where(c).orderBy("h", "id").limit(rows) for c in ("toxic > 0", "toxic <= 0")]
    part = stored(part[0].unionByName(part[1]).select("id", (F.col("toxic") > 0).alias("toxic"), F.expr("pmod(xxhash64(id, 1), 3)").cast("int").alias("fold"), "h"), "toxic-rows")
    # At most 2 * rows short rows: a parameter bounds the broadcast.
    return stored(docs.join(F.broadcast(part), "id"), "toxic-sample"), [count.get(False, 0), count.get(True, 0)]


def word_shares(sample: DataFrame) -> DataFrame:
    """sample(text, toxic) -> word, t, o: the toxic and ordinary texts that hold it."""
    schema = pa.schema([("word", pa.string()), ("t", pa.int64()), ("o", pa.int64())])

    def rows(sums: Counter) -> pa.RecordBatch:
        words = list({w for w, _ in sums})
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([sums[w, c] for w in words], pa.int64()) for c in (True, False))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                sums.update((w, toxic) for w in set(spaced(text.as_py()).split(" ")) if w)
                if len(sums) > OPEN_WORDS:
                    yield rows(sums)
                    sums = Counter()
        yield rows(sums)

    return sample.select("text", "toxic").mapInArrow(run, "word string, t long, o long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def chosen_words(sample: DataFrame) -> dict[str, str]:
    """word -> toxic, ordinary or common: at most OWN_WORDS of each of the first two and COMMON_WORDS."""
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nt, no = size.get(True, 0) + 1, size.get(False, 0) + 1
    lean = F.log((F.col("t") + 0.5) / nt) - F.log((F.col("o") + 0.5) / no)
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("o") + 0.5))
    w = stored(word_shares(sample).where(f"t + o >= {MIN_TEXTS}").withColumn("lean", lean).withColumn("error", error), "toxic-words")
    surely = F.abs("lean") - 2 * F.col("error") > float(np.log(OVER))
    out = {}
    own = {"toxic": (F.col("lean") > 0) & (F.col("t") >= MIN_TEXTS), "ordinary": (F.col("lean") < 0) & (F.col("o") >= MIN_TEXTS)}
    for kind, mine in own.items():
        best = w.where(surely & mine).orderBy((F.abs("lean") - 2 * F.col("error")).desc(), "word").limit(OWN_WORDS)
        out |= {r.word: kind for r in best.select("word").collect()}
    both = w.where(~surely & (F.abs("lean") - F.col("error") < float(np.log(2)))).orderBy(F.desc(F.col("t") + F.col("o")), "word").limit(COMMON_WORDS)
    return out | {r.word: "common" for r in both.select("word").collect()}


def dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary: what the class's texts are trained to, then what both are."""
    kinds = sample.sparkSession.sparkContext.broadcast(chosen_words(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, h in zip(batch.column("text"), batch.column("h").to_pylist()):
                mine: dict[str, list[str]] = {}
                for w in dict.fromkeys(spaced(text.as_py()).split(" ")):
                    if kind := kinds.value.get(w):
                        mine.setdefault(kind, []).append(w)
                found += [(kind, h, chained((" ".join(ws) + " ").encode("utf-8", "surrogatepass")).tobytes()) for kind, ws in mine.items()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=["kind", "h", "bytes"]), schema=pa.schema([("kind", pa.string()), ("h", pa.int64()), ("bytes", pa.binary())]), preserve_index=False)

    def train(texts: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        samples = texts.sort_values(["h", "bytes"])["bytes"].tolist()
        try:
            made = zstandard.train_dictionary(PART_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too few texts to train on: they are the dictionary
            made = b"".join(samples)[-PART_BYTES:]
        return pd.DataFrame({"kind": [texts["kind"].iloc[0]], "bytes": [made]})

    shown = stored(sample.select("text", "h").mapInArrow(run, "kind string, h long, bytes binary"), "toxic-texts")
    part = [shown.where(F.col("kind") == k).orderBy("h", "bytes").limit(DICTIONARY_TEXTS) for k in ("toxic", "ordinary", "common")]
    made = {r.kind: bytes(r.bytes) for r in part[0].unionByName(part[1]).unionByName(part[2]).groupBy("kind").applyInPandas(train, "kind string, bytes binary").collect()}
    mark = np.random.default_rng(7).bytes(MARK)
    # Own parts are filled up, so that common matches lie equally far back in both.
    return tuple(made.get(k, b"").rjust(PART_BYTES, b"\0") + made.get("common", b"") + mark for k in ("toxic", "ordinary"))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, share of y) of the non-falling step function nearest to y, by pooling neighbours."""
    blocks: list[list[float]] = []  # x, y, weight sums
    at, inverse = np.unique(x, return_inverse=True)
    w, wy = np.bincount(inverse, weight), np.bincount(inverse, weight * y)
    for i in range(len(at)):
        blocks.append([at[i] * w[i], wy[i], w[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


Model = tuple[bytes, bytes, np.ndarray, np.ndarray]


def distances(df: DataFrame, parts: tuple[bytes, bytes], text_col: str = "text") -> Column:
    shared = df.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distance = Distance(*shared.value)
        for texts in batches:
            yield pd.Series([distance(t) for t in texts], dtype=float)

    return of(F.col(text_col))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | float:
    """docs(id, text), labels(id, toxic) -> the dictionaries and the calibration; a constant score if
    the labels know one class only."""
    sample, (ordinary, toxic) = labelled(docs, labels, rows)
    if not ordinary or not toxic:
        return float(bool(toxic))
    parts = dictionaries(sample.where("fold > 0"))
    fit = sample.where("fold = 0")
    if fit.where("toxic").isEmpty() or fit.where("not toxic").isEmpty():
        fit = sample  # too few labels to keep some aside
    seen = fit.select("toxic", distances(fit, parts).alias("d")).toPandas()  # two numbers of a bounded sample
    if seen.empty:
        return 0.0
    y = seen["toxic"].to_numpy(dtype=float)
    weight = np.where(y > 0, max(1.0, toxic / rows), max(1.0, ordinary / rows))
    return (*parts, *isotonic(seen["d"].to_numpy(), y, weight))


def scores(docs: DataFrame, model: Model | float, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability that a text is toxic."""
    if isinstance(model, float):
        return docs.withColumn(out, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        toxic, ordinary, x, y = shared.value  # zstandard's objects are made in the task: they can't be sent
        distance = Distance(toxic, ordinary)
        for texts in batches:
            yield pd.Series(np.interp([distance(t) for t in texts], x, y))

    return docs.withColumn(out, of(F.col(text_col)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_compression(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held_out, score and predicted, learned from the other three quarters."""
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    known = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "toxic")
    out = scores(rows, train(rows, known)).withColumn("score", F.round("score", 6))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
