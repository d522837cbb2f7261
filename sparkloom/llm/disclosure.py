"""Operator 2, personal data: base patterns plus information-theoretic sanitisation.

The base patterns find e-mail addresses, IP addresses, card and telephone numbers.  Their
values are the protected entities.  A term is a word of three letters or more.  Over all
documents,

    disclosure(term, entity) = PMI(term; entity) / IC(entity),
    PMI = log2(N * n(term, entity) / (n(term) * n(entity))),  IC = log2(N / n(entity)),

where n counts the documents that hold the term, the entity, or both, anywhere in the text.
It is 1 if the term names the entity as well as the entity itself does, and 0 if the two are
independent.  What the term leaves open, IC - PMI = log2(n(term) / n(term, entity)) bits, is the
surprise of whoever guesses the entity from the term.  A term discloses if its disclosure is
GENERALISE or more and it leaves LEFT_BITS or fewer open (one bit: the guess is right every
second time); the share alone would mean less and less as N grows.  Pairs seen in fewer than
MIN_TEXTS different texts say nothing and are left.  In every document, whether it mentions the
entity or not, such terms give way to a placeholder, and to nothing at REMOVE or more.

All terms of a document meet all entities of it, after an exact bound: as n(term, entity) is at
most n(entity), a term can reach the threshold t only if n(term) <= N * (n(entity) / N) ** t and
n(term) <= n(entity) * 2 ** LEFT_BITS.  That leaves rare terms to rare entities, and copies of a
text are counted as one row.

Only DataFrame functions are used.  The patterns are written possessively, so that no text
makes them backtrack or recurse.

Defined results: null and empty texts have no spans; results depend on texts alone, so that ids
may be null or repeat; repeated rows are each judged; extra columns are ignored or passed
through (a column named as the output is replaced); empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import BROADCAST_ROWS, plain_names, quoted, replaced, running, spans_of, stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  A start inside a run of the same class cannot match where the run's own start did not.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
BELOW_256 = rf"^(?:{BYTE})(?:\.{BYTE}){{3}}$"

# What a text must hold for a match of the kind that passes; cheaper than the pattern itself.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}

MIN_TEXTS = 3
GENERALISE = 0.8
LEFT_BITS = 1.0
REMOVE = 0.95
TERM = r"(?<![^\s])[\p{P}\p{S}]*+\p{L}{3,}+[\p{P}\p{S}]*+(?![^\s])"
#: The letters of a term, also where punctuation ties it to others.
TERM_LETTERS = r"(?<![\p{L}\p{M}\p{N}])\p{L}{3,}+(?![\p{L}\p{M}\p{N}])"


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, _digit(digits, i)).otherwise(_digit(digits, i) * 2 - F.when(_digit(digits, i) > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def _digit(digits: Column, from_right: Column) -> Column:
    return F.substr(digits, F.length(digits) - from_right + 1, F.lit(1)).cast("int")


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":
        return value.rlike(BELOW_256)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: str) -> dict[str, Column]:
    """Per kind, array<struct<start,end,value>> of the matches that pass in a column."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def good(kind: str) -> Column:
        found = F.expr(spans_of(quoted(text), PATTERNS[kind]))
        found = found if kind == "email" else F.filter(found, lambda s: passes(kind, s["value"]))
        may = F.contains(F.col(text), F.lit("@")) if kind == "email" else F.col(text).rlike(NEEDS[kind])
        return F.when(may, found).otherwise(none)

    return {kind: good(kind) for kind in KINDS}


def label(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def terms_of(text: Column) -> Column:
    """The text's different terms, in lower case."""
    words = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]+", ""))))


def entities_of(docs: DataFrame) -> DataFrame:
    """docs(key, text) -> key, entity, n_docs: how many documents of one text hold an entity."""

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), F.lower(x["value"])))

    found = F.concat(*(named(k, s) for k, s in base_spans("text").items()))
    return docs.select("key", F.explode(F.array_distinct(found)).alias("entity")).groupBy("key", "entity").agg(F.count("*").alias("n_docs"))


def of_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs whose key is in keys (stored): the keys go to every executor if they are few."""
    few = keys.count() <= BROADCAST_ROWS // 4
    return docs.join(keys.hint("broadcast" if few else "shuffle_merge"), "key", "left_semi")


def disclosing_pairs(docs: DataFrame, held: DataFrame, min_texts: int = MIN_TEXTS, threshold: float = GENERALISE, left_bits: float = LEFT_BITS) -> DataFrame:
    """(entity, term, disclosure) of every pair with enough support that reaches the thresholds.

    docs(key, text), where equal texts have equal keys; held = entities_of(docs), stored.
    """
    total = float(docs.count())
    counted = held.groupBy("entity").agg(F.sum("n_docs").alias("n_entity"), F.count("*").alias("texts"))
    counted = stored(counted.where((F.col("texts") >= min_texts) & (F.col("n_entity") < total)).drop("texts"), "pii-entities")
    # The most documents that may hold a term, with room for rounding.
    most = F.lit(1 + 1e-9) * F.least(total * F.pow(F.col("n_entity") / total, F.lit(threshold)), F.col("n_entity") * 2.0**left_bits)
    widest = counted.agg(F.max(most)).first()[0] or 0.0
    protected = stored(held.join(counted.hint("shuffle_merge"), "entity").withColumn("most", most), "pii-protected")
    words = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    words = stored(words.where((F.col("n_term") >= min_texts) & (F.col("n_term") <= widest)), "pii-words")
    near = of_keys(docs, stored(protected.select("key").distinct(), "pii-keys"))
    near = stored(near.select("key", F.explode(terms_of(F.col("text"))).alias("term")).distinct(), "pii-near")
    near = stored(near.join(words.hint("shuffle_merge"), "term"), "pii-own")
    both = protected.join(near.hint("shuffle_merge"), "key").where(F.col("n_term") <= F.col("most"))
    pairs = both.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("n_docs").alias("n_pair"), F.count("*").alias("texts"))
    pmi = F.log2(F.lit(total) * F.col("n_pair") / F.col("n_term") / F.col("n_entity"))
    scored = pairs.where(F.col("texts") >= min_texts).select("entity", "term", "n_term", "n_pair", (pmi / F.log2(F.lit(total) / F.col("n_entity"))).alias("disclosure"))
    scored = scored.where(F.log2(F.col("n_term") / F.col("n_pair")) <= left_bits + 1e-9)
    return scored.select("entity", "term", "disclosure").withColumn("disclosure", F.least("disclosure", F.lit(1.0))).where(F.col("disclosure") >= threshold)


def disclosing_terms(docs: DataFrame, min_texts: int = MIN_TEXTS, threshold: float = GENERALISE, left_bits: float = LEFT_BITS) -> DataFrame:
    """(term, disclosure): the most that a term reveals of any entity, where that reaches the thresholds."""
    held = stored(entities_of(docs), "pii-held")
    pairs = disclosing_pairs(docs, held, min_texts, threshold, left_bits)
    return stored(pairs.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-strong")


def one_bit(term: Column) -> Column:
    """A long with one bit set, chosen by the term's hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(term), F.lit(64)).cast("int"))


def term_spans(docs: DataFrame, strong: DataFrame) -> DataFrame:
    """docs(key, text) -> key, terms: array<struct<start,end,disclosure>> where strong terms stand."""
    strong = strong.hint("broadcast" if strong.count() <= BROADCAST_ROWS // 4 else "shuffle_merge")
    holds = docs.select("key", F.explode(terms_of(F.col("text"))).alias("term")).join(strong, "term", "left_semi")
    masks = stored(holds.groupBy("key").agg(F.bit_or(one_bit(F.col("term"))).alias("mask")), "pii-holding")
    few = masks.count() <= BROADCAST_ROWS // 4
    texts = docs.join(masks.hint("broadcast" if few else "shuffle_merge"), "key").dropDuplicates(["key"])
    base = F.concat(*(F.transform(v, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("term"))) for v in base_spans("text").values()))
    found = F.transform(F.expr(spans_of("text", TERM_LETTERS)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("term")))
    texts = stored(texts.select("key", "mask", F.array_sort(F.concat(base, found)).alias("all")), "pii-base")
    # A term that begins inside a base span goes with it.
    covered = F.expr(running("transform(all, x -> IF(x.term = '', x.end, 0))", "greatest(x, y)"))
    free = F.arrays_zip(F.col("all").alias("word"), covered.alias("to"))
    # The mask turns away nearly all words that the join would turn away, before they become rows.
    may = lambda x: (x["word"]["term"] != "") & (x["to"] <= x["word"]["start"]) & (F.col("mask").bitwiseAND(one_bit(x["word"]["term"])) != 0)
    words = texts.select("key", F.explode(F.filter(free, may)).alias("s")).select("key", "s.word.*")
    hits = stored(words, "pii-places").join(strong, "term")
    return stored(hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms")), "pii-terms")


def with_spans(docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS, threshold: float = GENERALISE, left_bits: float = LEFT_BITS, out: str = "__pii") -> DataFrame:
    """docs with one more column, a struct of span arrays: email, ip, card, phone, term."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    columns = dict(zip(docs.columns, names))
    rows = docs.toDF(*names).withColumn("key", F.md5(F.col(columns[text_col])))
    texts = rows.where(F.col(columns[text_col]).isNotNull()).select("key", F.col(columns[text_col]).alias("text"))
    found = term_spans(texts, disclosing_terms(texts, min_texts, threshold, left_bits))
    n = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    rows = rows.join(found.hint("broadcast" if n <= BROADCAST_ROWS // 4 else "shuffle_merge"), "key", "left")
    spans = base_spans(columns[text_col])
    terms = F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,disclosure:double>>"))
    kept = [F.col(x).alias(c) for c, x in columns.items() if c != out]
    return rows.select(*kept, F.struct(*(s.alias(k) for k, s in spans.items()), terms.alias("term")).alias(out))


def sanitised(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs whose texts have placeholders in place of personal data and revealing terms.

    Spans that overlap are replaced from the left; the rest of a later one goes with it.
    Null texts stay null.
    """
    rows = plain_names(docs, text_col)
    marked = with_spans(rows, text_col, **options)

    def piece(kind: str, put: Callable[[Column], Column]) -> Column:
        return F.transform(f"__pii.{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), put(s).alias("put")))

    base = [piece(k, lambda s, k=k: F.lit(f"[{k.upper()}]")) for k in KINDS]
    terms = piece("term", lambda s: F.when(s["disclosure"] >= REMOVE, "").otherwise("[TERM]"))
    marked = marked.select(*map(quoted, rows.columns), F.array_sort(F.concat(*base, terms)).alias("__pii"))
    new = F.expr(replaced(quoted(text_col), "__pii"))
    return marked.select(*(new.alias(c) if c == text_col else F.col(quoted(c)) for c in rows.columns)).toDF(*docs.columns)


def op2_disclosure(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and all spans; terms by what becomes of them."""
    found = with_spans(docs.select("doc_id", "text"))
    base = F.concat(*(label(k, F.col(f"__pii.{k}")) for k in KINDS))
    gone = F.filter("__pii.term", lambda s: s["disclosure"] >= REMOVE)
    general = F.filter("__pii.term", lambda s: s["disclosure"] < REMOVE)
    return found.select(
        "doc_id",
        *(F.size(f"__pii.{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, label("generalise", general), label("remove", gone)), ",").alias("spans"),
        F.size(general).cast("long").alias("n_generalise"),
        F.size(gone).cast("long").alias("n_remove"),
    )
