"""Character k-gram sets inside tasks: keys, hashes, Jaccard similarity and prefixes, by numpy and Arrow."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, IntegerType, LongType, StructField, StructType

#: Buckets whose counts stand for the counts of elements: 8 MB, whatever the input.
BUCKETS = 1 << 20


#: Words of 64 bits of a sketch, at most: a power of two.
WORDS = 16

#: Sets with a prefix longer than needed for one common element have it longer by one in so many of their elements.
MORE = 16

#: Rows that meet in a group, or about twice as many; rows that are sent and pairs that are looked at at once.
MEET = 50_000
SENT = 1 << 16
PAIRS = 1 << 19

#: Characters that are hashed at once.
CHUNK = 1 << 20


def slices(*columns: pa.Array) -> Iterator[list[list[str]]]:
    """The columns' rows as strings, in runs of about CHUNK characters: no batch is turned into strings as a whole."""
    sizes = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + CHUNK)))
        yield [[t or "" for t in c.slice(start, end - start).to_pylist()] for c in columns]
        start = end


def set_key(k: int) -> Callable:
    """Column of texts -> sha256 over the 64-bit hashes of their k-gram sets; null without a k-gram."""

    @F.arrow_udf("binary")
    def keys(texts: pa.Array) -> pa.Array:
        out = []
        for (t,) in slices(texts):
            h, n = hashes(t, k)
            ends = np.cumsum(n)
            out += [hashlib.sha256(h[e - m : e].tobytes()).digest() if m else None for e, m in zip(ends, n)]
        return pa.array(out, pa.binary())

    return keys


def jaccard(k: int) -> Callable:
    """Two columns of texts -> Jaccard similarity of their k-gram sets."""

    @F.arrow_udf("double")
    def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for s, t in slices(a, b):
            (p, n), (q, m) = hashes(s, k), hashes(t, k)
            h, row = np.concatenate([p, q]), np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            shared = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=len(n))
            out.append(shared / (n + m - shared))
        return pa.array(np.concatenate(out))

    return similarity


def hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all k-grams of each text, distinct and ascending in it, and how many each text has."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(points) < k:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    h = np.zeros(len(points) - k + 1, dtype=np.uint64)
    for j in range(k):
        h = (h ^ points[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = (h * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)[: len(h)]
    whole = np.arange(len(h)) + k <= np.cumsum(lengths)[row]
    h, row = h[whole], row[whole]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(texts))


def hashed_set(k: int) -> Callable:
    """Column of texts -> array of the hashes of their k-grams."""

    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        found = [hashes(t, k) for (t,) in slices(texts)] or [hashes([], k)]
        h, n = (np.concatenate(x) for x in zip(*found))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h))

    return sets


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many elements of sets(id, s: array<long>) fall into each bucket: added up in tasks, then by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            n += np.bincount(b.column("s").flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        (at,) = np.nonzero(n)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["bucket", "n"])

    found = sets.select("s").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def differences(n: np.ndarray, threshold: float) -> np.ndarray:
    """In how many elements two sets of n may differ at that Jaccard similarity."""
    return 2 * n * (1 - threshold) / (1 + threshold)


def longer(n: np.ndarray, threshold: float) -> np.ndarray:
    """By how many elements the prefix of a set of n is longer than needed for one: none, if a sketch can tell sets apart."""
    return np.where(differences(n, threshold) > 64 * WORDS / 2.5, n // MORE, 0)


def sketches(e: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For sets of n elements each, e one after another: their sketches, end to end, and the words of each.

    Each element turns over one bit, so two sketches differ in no more bits than their sets do in elements,
    and those of sets that share little in half of their bits.  A sketch has three bits up for each difference
    allowed, always a power of two; folded in half by XOR, it is the shorter one.  Sets too large for that have one word.
    """
    most = differences(n, threshold)
    words = np.int64(1) << np.ceil(np.log2(np.clip(3 * most / 64, 1, WORDS))).astype(np.int64)
    words[most > 64 * WORDS / 2.1] = 1
    start = np.cumsum(words) - words
    at = ((e >> 40) & (64 * WORDS - 1)) & np.repeat(64 * words - 1, n)
    bits = np.bincount(np.repeat(64 * start, n) + at, minlength=64 * int(words.sum())) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64), words


def folded(words: np.ndarray, begin: np.ndarray, width: np.ndarray, w: int) -> np.ndarray:
    """The sketches that begin there, of so many words, each folded to w words."""
    out, folds = words[begin[:, None] + np.arange(w)], width // w
    for f in range(1, int(folds.max(initial=1))):
        more = f < folds
        out[more] ^= words[begin[more][:, None] + f * w + np.arange(w)]
    return out


def prefixes(sets: DataFrame, threshold: float, slack: float) -> DataFrame:
    """id, n, s, sketch of sets(id, s: array<long>): the elements of each set on which it can meet others, from the rarest bucket on."""
    counts = sets.sparkSession.sparkContext.broadcast(bucket_counts(sets))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            s = b.column("s")
            n, e = s.value_lengths().to_numpy().astype(np.int64), s.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((e, counts.value[e & (BUCKETS - 1)], row))
            place = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + 1
            kept = place <= (n - np.ceil(threshold * n - slack) + 1 + longer(n, threshold))[row]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(n)))])
            bits, words = sketches(e, n, threshold)
            head = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(e[order][kept]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n.astype(np.int32)), head, blobs(bits, words)], ["id", "n", "s", "sketch"])

    out = StructType([sets.schema["id"], StructField("n", IntegerType()), StructField("s", ArrayType(LongType())), StructField("sketch", BinaryType())])
    return sets.select("id", "s").mapInArrow(first, out)


def blobs(bits: np.ndarray, words: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], 8 * np.cumsum(words)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(bits.tobytes())])


def words_of(blob: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of an array of sketches, end to end, and where each sketch begins and the last one ends."""
    ends = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1] // 8
    return np.frombuffer(blob.buffers()[2], np.uint64, count=ends[-1]), ends.astype(np.int64)


def dealt(first: DataFrame) -> tuple[DataFrame, int]:
    """Prefixes as a row for each element, dealt to groups where equal elements meet; and how many groups there are.

    A group has 2 * MEET rows or fewer.  Buckets of up to MEET rows share groups: side is 0.  The rows of a
    larger one are cut into blocks by their sketches, and each two blocks are a group: side is 1 and 2, or 0 if a
    block meets itself.
    """
    n = bucket_counts(first)
    blocks = -(-n // MEET)
    small = np.where(blocks == 1, n, 0)
    ways = np.where(blocks > 1, blocks * (blocks + 1) // 2, 0)
    shared = int(small.sum()) // MEET + 1
    group = np.where(blocks > 1, shared + np.cumsum(ways) - ways, (np.cumsum(small) - small) // MEET)
    known = first.sparkSession.sparkContext.broadcast((blocks, group))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, group = known.value
        for b in filter(len, batches):
            s, (words, ends) = b.column("s"), words_of(b.column("sketch"))
            n, e = s.value_lengths().to_numpy().astype(np.int64), s.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + 1
            size = b.column("n").to_numpy()
            before = np.concatenate([[0], e[:-1]])
            mine = words[ends[:-1]] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            copies = np.cumsum(blocks[e & (BUCKETS - 1)])
            start = 0
            while start < len(e):
                end = max(start + 1, int(np.searchsorted(copies, (copies[start - 1] if start else 0) + SENT, "right")))
                k = blocks[e[start:end] & (BUCKETS - 1)]
                at = np.repeat(np.arange(start, end), k)
                other = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
                own = (mine[row[at]] % np.repeat(k, k).astype(np.uint64)).astype(np.int64)
                i, j = np.minimum(own, other), np.maximum(own, other)
                side = np.where(i == j, 0, np.where(own < other, 1, 2))
                to = row[at]
                columns = [pa.array(group[e[at] & (BUCKETS - 1)] + j * (j + 1) // 2 + i), pa.array(side.astype(np.int8)), b.column("id").take(pa.array(to)), pa.array(size[to])]
                # Half of the hash will do within a group: elements that it takes for one another only add candidates.
                columns += [pa.array((e[at] >> 32).astype(np.int32)), pa.array(place[at].astype(np.int32)), pa.array(before[at]), b.column("sketch").take(pa.array(to))]
                yield pa.RecordBatch.from_arrays(columns, ["g", "side", "id", "n", "e", "place", "before", "sketch"])
                start = end

    out = StructType([StructField("g", LongType()), StructField("side", ByteType()), first.schema["id"], StructField("n", IntegerType()), StructField("e", IntegerType()), StructField("place", IntegerType()), StructField("before", LongType()), StructField("sketch", BinaryType())])
    return first.mapInArrow(deal, out), shared + int(ways.sum())


def meet(threshold: float, slack: float) -> Callable:
    """The rows of a group -> a, b, enough: the pairs of sets that share an element there and may reach the Jaccard
    threshold, if they are found so often in all groups.

    PAIRS pairs are looked at at once, so memory is bounded whatever meets.
    """
    share = threshold / (1 + threshold)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        ids = rows.column("id").combine_chunks()
        n, e, place, side, before = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "e", "place", "side", "before"))
        words, ends = words_of(rows.column("sketch").combine_chunks())
        order = np.lexsort((n, e))
        n, e, place, side, before = n[order], e[order], place[order], side[order], before[order]
        begin, width = ends[:-1][order], np.diff(ends)[order]
        same = ids.dictionary_encode().indices.to_numpy()[order]
        # The sets of one element stand by size: a set's larger partners are a run behind it.
        run = np.cumsum(np.concatenate([[0], e[1:] != e[:-1]])) << 32
        last = np.searchsorted(run + n, run + np.minimum((n + slack) / threshold, (1 << 32) - 1).astype(np.int64), "right")
        most = 1 + longer(n, threshold)
        count = np.where(place <= n - np.ceil(2 * share * n - slack) + most, last - np.arange(len(n)) - 1, 0)
        met = np.cumsum(count)
        start = 0
        while start < len(n):
            end = max(start + 1, int(np.searchsorted(met, (met[start - 1] if start else 0) + PAIRS, "right")))
            c = count[start:end]
            x = np.repeat(np.arange(start, end), c)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
            need = np.ceil(share * (n[x] + n[y]) - slack).astype(np.int64)
            # The smaller set's n says how many elements are met at least; these and what stands behind must be enough.
            enough = np.minimum(most[x], need)
            kept = (most[x] + np.minimum(n[x] - place[x], n[y] - place[y]) >= need) & ((side[x] == 0) | (side[x] != side[y])) & (same[x] != same[y])
            # Where one is enough: two that share the element before this one, too, have met there already.
            kept &= (enough > 1) | (before[x] != before[y]) | (place[x] == 1) | (place[y] == 1)
            x, y, need, enough = x[kept], y[kept], need[kept], enough[kept]
            kept = np.zeros(len(x), dtype=bool)
            least = np.minimum(width[x], width[y])
            for w in map(int, np.unique(least)):
                of_w = np.flatnonzero(least == w)
                for part in np.split(of_w, range(PAIRS // w, len(of_w), PAIRS // w)):
                    i, j = x[part], y[part]
                    differ = np.bitwise_count(folded(words, begin[i], width[i], w) ^ folded(words, begin[j], width[j], w)).sum(axis=1)
                    kept[part] = differ <= n[i] + n[j] - 2 * need[part]
            x, y = order[x[kept]], order[y[kept]]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(enough[kept].astype(np.int32))], ["a", "b", "enough"])
            start = end

    return pairs
