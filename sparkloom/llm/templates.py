"""Operator 5, benchmark decontamination by template canonicalisation.

Words are stripped of punctuation at their ends and canonicalised: numbers, names and units
become typed placeholders, all else is lower-cased.  A number is a figure or a number word, and
number words that follow a number belong to it ("two hundred", "3 million").  A name is a
capitalised word, wherever it stands, unless it is one of COMMON or all in capitals; names in a
row without punctuation between them are one ("Mary Ann").  Signs of arithmetic are words.  A
placeholder keeps its stripped words as its slot value.

Windows of WINDOW canonical words are hashed and joined with the benchmark's; of each document
and item the matching windows are lined up by their offset (position in the document less
position in the item).  The slots of a line must be consistent: one benchmark value stands for
one document value, so that a re-parameterised item keeps equal values equal.  Clashes may be
MAX_CLASH of a line's slots, for words that were edited; a number's clash counts NUMBER_CLASH of
a name's, as numbers may be equal by chance.  A document value that only begins or ends with
further names counts as the benchmark's value.

Windows of more than MAX_SLOTS placeholders say too little as templates: they are matched by
their own stripped words instead, that is by exact slot agreement.  Windows with more
placeholders than plain words are matched both ways.

A document is contaminated by an item if consistent windows cover MIN_COVER of the item's
canonical words.  Items shorter than a window are one window of all their words.

Hashes of the benchmark's windows are sent to the tasks if there are at most MAX_PROBE of
them (8 bytes each), so that only windows that match are shuffled; beyond that bound all
windows are shuffled to the join.

Defined results: null and empty texts match nothing; null ids are dropped from the links;
repeated rows count once; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import BROADCAST_ROWS, named, numbered, plain_names, quoted, stored
from sparkloom.llm.minmax import MIX_A, mixed

WINDOW = 8
MIN_COVER = 0.5
MAX_CLASH = 0.1
NUMBER_CLASH = 0.25
MAX_SLOTS = 5 / 8
MAX_PROBE = 4_000_000
# Units that become <unit>.
UNITS = frozenset(
    "mm cm m km inch inches ft foot feet yd yard yards mile miles g kg mg lb lbs oz ton tons ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros pound pounds cent cents percent km/h mph kb mb gb tb".split()
)
# Number words.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred hundreds thousand thousands million millions billion billions dozen dozens".split()
)
# Words that are no names where they begin a sentence.
COMMON = frozenset(
    "a about after again all also although always among an and another any anyone are as at be because been before behind below between "
    "both but by calculate can compute consider could determine did do does during each either else even every everyone evaluate "
    "explain few finally find first for from given had has have he hence her here his how however i if in into is it its just last later "
    "let many may maybe might more moreover most much must my near neither never next no nobody none nor not nothing now of often on "
    "once only or other others our out over perhaps please prove she should show simplify since so solve some someone sometimes "
    "soon still such suppose than that the their them then there therefore these they this those though through thus to today together "
    "tomorrow too under unless until up upon use very was we were what when where whether which while who whom whose why will with "
    "within without would write yes yesterday yet you your "
    "au dans elle elles en et il ils je la le les leur mais nous on ou par pour que qui sur tu un une vous "
    "aber das dem den der die ein eine er es für ich ihr im ist mit oder sie und von wir zu "
    "como con del el ella ellos está las lo los para pero por se su una uno y yo".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?$")
EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
SIGNS = re.compile(r"[-+*/=<>^×÷±≤≥≠]+$")
PLAIN, NUM, NUM_WORD, NAME, UNIT, NOTHING = range(6)
PLACEHOLDERS = {NUM: 0x1234567, NUM_WORD: 0x1234567, NAME: 0x2345678, UNIT: 0x3456789}
#: Windows that are matched by their own words hash apart from templates.
OWN_SALT = np.uint64(0x5DEECE66D1234567)
#: Words that are under way at once; longer texts go on alone.
GROUP = 200_000


def stripped(word: str) -> str:
    if word.isalpha() or SIGNS.match(word):
        return word
    return EDGE.sub("", word)


def kind_of(core: str) -> int:
    low = core.lower()
    if not core:
        return NOTHING
    if low in UNITS:
        return UNIT
    if NUMBER.match(core):
        return NUM
    if low in NUMBER_WORDS or "-" in low and all(x in NUMBER_WORDS for x in low.split("-")):
        return NUM_WORD
    if core[0].isupper() and not core.isupper() and low not in COMMON:
        return NAME
    return PLAIN


class Canon(dict):
    """raw word (bytes) -> row of the tables below; emptied between texts when it holds too many."""

    LIMIT = 600_000

    def __init__(self) -> None:
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.special = {w.encode() for w in UNITS | NUMBER_WORDS}
        self.reset()

    def reset(self) -> None:
        self.clear()
        n = 1 << 14
        self.canon, self.own = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)  # hashes, spread
        self.kind, self.ends = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=bool)  # sort of word; whether punctuation ends it

    def __missing__(self, raw: bytes) -> int:
        at = len(self)
        if at == len(self.canon):
            self.canon, self.own, self.kind, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.canon, self.own, self.kind, self.ends))
        if raw.isalpha() and raw.islower() and raw not in self.special:  # most words of any English text
            own, kind = self.hash(raw), PLAIN
        else:
            word = raw.decode("utf-8")
            core = stripped(word)
            own, kind = self.hash(core.lower().encode("utf-8")), kind_of(core)
            self.ends[at] = kind == NOTHING or word[-1] != core[-1]
        self.canon[at], self.own[at], self.kind[at] = PLACEHOLDERS.get(kind, own), own, kind
        self[raw] = at
        return at


class Words:
    """Canonical words of several texts, one after the other.

    doc and pos tell where each stands; canon and own are its hashes, slot whether it is a
    placeholder.
    """

    NAME = mixed(np.full(1, PLACEHOLDERS[NAME], dtype=np.uint64))[0]

    def __init__(self, texts: list[str | None], cache: Canon) -> None:
        if len(cache) > cache.LIMIT:
            cache.reset()
        parts = [t.encode("utf-8").split() if t else [] for t in texts]
        raw = self.raw = [w for p in parts for w in p] if len(parts) > 1 else parts[0] if parts else []
        ids = np.fromiter(map(cache.__getitem__, raw), dtype=np.int64, count=len(raw))
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        kind = cache.kind[ids]
        there = np.flatnonzero(kind != NOTHING)
        kind, doc = kind[there], doc[there]
        n = len(there)
        runs = np.zeros(n, dtype=bool)  # whether a word goes on with the placeholder before it
        if n > 1:
            joins = (kind[1:] == NAME) & (kind[:-1] == NAME) | (kind[1:] == NUM_WORD) & ((kind[:-1] == NUM) | (kind[:-1] == NUM_WORD))
            runs[1:] = joins & ~cache.ends[ids[there[:-1]]] & (np.diff(there) == 1) & (doc[1:] == doc[:-1])
        starts = np.flatnonzero(~runs)
        own = cache.own[ids[there]]
        self.canon, self.slot, self.doc = mixed(cache.canon[ids[there[starts]]]), kind[starts] != PLAIN, doc[starts]
        if len(starts) < n:
            place = np.arange(n) - np.repeat(starts, np.diff(starts, append=n))
            own = np.add.reduceat(own * (2 * place + 1).astype(np.uint64), starts)
        self.own = mixed(own)
        self.there, self.starts = there, np.append(starts, n)
        first = np.searchsorted(self.doc, np.arange(len(parts) + 1))
        self.pos = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))
        self.counts = np.diff(first)

    def value(self, i: int) -> str:
        """The stripped words of canonical word i, after a letter for their sort."""
        return ("x:" if self.canon[i] == self.NAME else "n:") + " ".join(stripped(self.raw[k].decode("utf-8")) for k in self.there[self.starts[i] : self.starts[i + 1]])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and place of the windows of one text each, and whether they are matched by their own words."""
        n = len(self.doc) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        total = np.cumsum(np.concatenate([[0], self.slot]))
        count = total[size:] - total[:-size]
        whole = self.doc[:n] == self.doc[size - 1 :]
        template, own = np.flatnonzero(whole & (count <= size * MAX_SLOTS)), np.flatnonzero(whole & (2 * count > size))
        acc = mixed(rolled(self.canon, size)[template])
        if len(own):
            acc = np.concatenate([acc, mixed(rolled(self.own, size)[own] ^ OWN_SALT)])
        return acc, np.concatenate([template, own]), np.arange(len(template) + len(own)) >= len(template)


def rolled(spread: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of every stretch of size words, by doubling."""
    acc, done = spread, 1
    while done < size:
        if 2 * done <= size:
            acc = acc[:-done] * np.uint64(pow(int(MIX_A), done, 1 << 64)) + acc[done:]
            done *= 2
        else:
            acc = acc[:-1] * MIX_A + spread[done : done + len(acc) - 1]
            done += 1
    return acc + np.uint64(size)


class Probe:
    """Which hashes are known: a bit per low part of the hash answers for almost all that are not."""

    BITS = 22

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        self.low = np.zeros(1 << self.BITS, dtype=bool)
        self.low[(known & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def hits(self, w: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.low[(w & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        if not len(self.known) or not len(maybe):
            return np.zeros(0, dtype=np.int64)
        found = np.searchsorted(self.known, w[maybe])
        return maybe[self.known[np.minimum(found, len(self.known) - 1)] == w[maybe]]


FIELDS = "id long, window long, pos int, size int, n_words int, own boolean, slots array<string>"


def template_windows(rows: DataFrame, sizes: tuple[int, ...], known: object | None, whole: bool) -> DataFrame:
    """rows(id, text) -> FIELDS: the windows of every text, slots being the words at its placeholders
    (each after a letter for its sort).

    With whole, a text shorter than a window gives one window of all its words.  With known
    (a broadcast of sorted hashes), only windows that it holds are given.
    """
    schema = pa.schema([("id", pa.int64()), ("window", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("n_words", pa.int32()), ("own", pa.bool_()), ("slots", pa.list_(pa.string()))])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids, texts, chars = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py()
                ids.append(doc)
                texts.append(text)
                chars += len(text or "")
                if whole or chars > 5 * GROUP:
                    yield ids, texts
                    ids, texts, chars = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Canon()
        probe = Probe(known.value) if known is not None else None
        for ids, texts in grouped(batches):
            words = Words(texts, cache)
            for size in [min(WINDOW, len(words.doc))] if whole else sizes:
                if not size:
                    continue
                acc, at, own = words.windows(size)
                if probe is not None:
                    hits = probe.hits(acc)
                    acc, at, own = acc[hits], at[hits], own[hits]
                for low in range(0, len(at), 20_000):
                    part = slice(low, low + 20_000)
                    places = at[part].tolist()
                    docs = words.doc[at[part]]
                    slots = [[words.value(k) for k in range(p, p + size) if words.slot[k]] for p in places]
                    columns = [[ids[d] for d in docs.tolist()], acc[part].astype(np.int64), words.pos[at[part]], np.full(len(places), size), words.counts[docs], own[part], slots]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, FIELDS)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_cover: float = MIN_COVER) -> DataFrame:
    """(id_col, item_col, n_windows, covered, item_words, n_slots, exact_slots): contaminated documents; ids
    may be of any type that has an order."""
    spark = docs.sparkSession
    items, item_names = numbered(benchmark.select(F.col(quoted(item_col)).alias("id"), F.col(quoted(item_text_col)).alias("text")), "id")
    items = items.where("id is not null").distinct()
    item = stored(template_windows(items, (), None, True).withColumnRenamed("id", "item"), "leak-items")
    sizes = tuple(sorted(r.size for r in item.select("size").distinct().collect()))  # at most WINDOW values
    keys = stored(item.select("window").distinct(), "leak-windows")
    known = None
    if keys.count() <= MAX_PROBE:
        hashes = keys.toArrow().column("window").to_numpy().astype(np.uint64)
        known = spark.sparkContext.broadcast(np.sort(hashes))
    texts, names = numbered(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "id")
    texts = texts.where("id is not null")
    hits = stored(template_windows(texts, sizes, known, False).drop("n_words").distinct(), "leak-hits")
    there = item.select("item", "window", "size", F.col("pos").alias("item_pos"), "n_words", "own", F.col("slots").alias("item_slots"))
    match = hits.join(there.hint("broadcast" if item.count() <= BROADCAST_ROWS // 10 else "shuffle_merge"), ["window", "size", "own"])
    match = stored(match.select("id", "item", (F.col("pos") - F.col("item_pos")).alias("line"), "item_pos", "size", "n_words", "slots", "item_slots"), "leak-matches")
    found = named(named(leaks(match, min_cover), names, "id"), item_names, "item")
    return found.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def leaks(match: DataFrame, min_cover: float) -> DataFrame:
    """(id, item, n_windows, covered, item_words, n_slots, exact_slots) of the pairs whose matches cover enough."""
    # Windows on one line repeat each other's slots; a slot is named by its value in the item.
    pairs = F.explode(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))).alias("s")
    letter, rest = F.left("s.a", F.lit(1)).alias("sort"), [F.substr(f"s.{c}", F.lit(3)).alias(c) for c in "ab"]
    slots = match.select("id", "item", "line", pairs).select("id", "item", "line", letter, *rest)
    within = F.endswith("b", F.concat(F.lit(" "), "a")) | F.startswith("b", F.concat("a", F.lit(" ")))
    slots = slots.withColumn("b", F.when(within, F.col("a")).otherwise(F.col("b"))).distinct()
    slots = slots.groupBy("id", "item", "line", "sort", "a").agg(F.count("*").alias("values"), F.max(F.col("a") == F.col("b")).alias("same"))
    clash = F.when(F.col("values") == 1, 0.0).otherwise(F.when(F.col("sort") == "x", 1.0).otherwise(NUMBER_CLASH))
    slots = slots.groupBy("id", "item", "line").agg(F.count("*").alias("n_slots"), F.sum(clash).alias("clashes"), F.count_if(F.col("same") & (F.col("values") == 1)).alias("exact_slots"))
    places = F.explode(F.sequence("item_pos", F.col("item_pos") + F.col("size") - 1)).alias("p")
    lines = match.select("id", "item", "line", "n_words", "item_pos", places)
    lines = lines.groupBy("id", "item", "line").agg(F.collect_set("p").alias("places"), F.countDistinct("item_pos").alias("n_windows"), F.max("n_words").alias("item_words"))
    scored = stored(lines, "leak-lines").join(stored(slots, "leak-slots").hint("shuffle_merge"), ["id", "item", "line"], "left").fillna(0, ["n_slots", "clashes", "exact_slots"])
    # A line may break where a word was put in or left out: its pieces add up, each if consistent,
    # and a place of the item counts once however many lines hold it.
    sound = stored(scored.where(F.col("clashes") <= F.col("n_slots") * MAX_CLASH), "leak-sound")
    held = sound.select("id", "item", F.explode("places").alias("p")).groupBy("id", "item").agg(F.countDistinct("p").alias("covered"))
    total = sound.groupBy("id", "item").agg(
        F.sum("n_windows").alias("n_windows"),
        F.max("item_words").cast("long").alias("item_words"),
        F.sum("n_slots").alias("n_slots"),
        F.sum("exact_slots").alias("exact_slots"),
    )
    total = total.join(held.hint("shuffle_merge"), ["id", "item"]).where(F.col("covered") >= F.ceil(F.col("item_words") * min_cover))
    return total.select("id", "item", "n_windows", "covered", "item_words", "n_slots", "exact_slots")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated documents; rows with a null id stay."""
    rows = plain_names(docs, id_col, text_col).withColumnRenamed(id_col, "id")
    texts = rows.select("id", F.col(quoted(text_col)).alias("text"))
    bad = stored(contamination(texts, benchmark, "id", "text").select("id").distinct(), "leak-ids")
    few = bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    kept = rows.join(bad.hint("broadcast" if few else "shuffle_merge"), "id", "left_anti")
    return kept.select(*map(quoted, rows.columns)).toDF(*docs.columns)


def op5_templates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
