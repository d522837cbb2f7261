"""Operator 6, secret scans: base patterns plus multipart credential linking.

The base patterns (assign, access, hex) are reported wherever they pass.  Weak candidates
(user names and client ids, short or unnamed secrets, secrets with symbols that the base
patterns end at or refuse, service addresses) are reported only
where the other parts of a credential stand in the same scope, a stretch of SCOPE code points:
an identifier needs a secret, a secret an identifier, an endpoint one of each.  Candidates meet
by an interval join on the document and on buckets as wide as a scope, so that each meets only
its neighbourhood however long the text is.

Only DataFrame functions are used; all patterns run without backtracking.  Defined results:
null and empty texts have no spans; each row is judged, repeated or not; null ids count as an
id of their own; extra columns are ignored or passed through; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import quoted, spans_of, stored

# The base kinds and their patterns, then the weak ones.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}+", "hex": r"[0-9a-f]{16,}+"}
WEAK = {
    "weak_id": r"""(?i:user(?:_?name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@._-]{3,}+""",
    "weak_secret": r"""(?i:password|passwd|secret|token|api_?key|pwd|pass|passphrase|auth_?key|private_?key|credential)["']?\x20*+[:=]\x20*+["']?[^\s"',;]{6,}+"""
    r"""|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{20,}+""",
    "weak_endpoint": r"""(?i:https?|s?ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqps?|jdbc:[a-z]{2,12}+)://[^\s"'<>]++"""
    r"""|(?i:host|server|endpoint)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9._-]{4,}+""",
}
PART = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "weak_endpoint": "endpoint"}
ORDER = list(PART)
SCOPE = 400
MIN_ASSIGNED = 12


def packed(span: Column) -> Column:
    """Start and end in one long: sets of longs are compared by hashing."""
    return span["start"].cast("long") * F.lit(1 << 32) + span["end"]


def unpacked(x: Column) -> Column:
    return F.struct(F.shiftright(x, 32).cast("int").alias("start"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end"))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: its id, a key of id and text, and the spans of each kind."""
    text = quoted(text_col)
    assign = F.filter(F.expr(spans_of(text, ASSIGN)), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_ASSIGNED)
    kinds = [assign.alias("assign")] + [F.expr(spans_of(text, p)).alias(k) for k, p in [*BASE.items(), *WEAK.items()] if k != "assign"]
    # A secret that the base pattern reports as it stands is not weak.
    weak = F.transform(F.array_except(F.transform("weak_secret", packed), F.transform("assign", packed)), unpacked)
    bare = [(weak if k == "weak_secret" else F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias(k) for k in ORDER]
    key = [F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.hash(F.col(text_col)).alias("k2")]
    return docs.select(F.col(id_col).alias("id"), *key, *kinds).select("id", "k1", "k2", *bare)


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """k1, k2, spans: the weak candidates of found = scan(...) that complementary parts confirm."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(PART[kind]).alias("part"), s["start"].alias("start"), s["end"].alias("end")))

    hopeful = found.where((F.size("weak_id") + F.size("weak_secret") + F.size("weak_endpoint") > 0) & (F.size("weak_id") + F.size("access") > 0) & (F.size("weak_secret") + F.size("assign") + F.size("hex") > 0))
    parts = hopeful.select("k1", "k2", F.explode(F.concat(*(named(k) for k in ORDER))).alias("s")).distinct()
    parts = stored(parts.select("k1", "k2", "s.*", F.floor(F.col("s.start") / scope).cast("long").alias("bucket")), "secret-parts")

    def near(weak: DataFrame, part: str) -> DataFrame:
        """The rows of weak that a part of that sort starts or ends within a scope of."""
        w = weak.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1))).alias("w")
        p = parts.where(F.col("part") == part).alias("p")
        same = (F.col("w.k1") == F.col("p.k1")) & (F.col("w.k2") == F.col("p.k2")) & (F.col("w.bucket") == F.col("p.bucket"))
        gap = (F.abs(F.col("w.start") - F.col("p.start")) <= scope) & ((F.col("w.end") <= F.col("p.start")) | (F.col("p.end") <= F.col("w.start")))
        return w.join(p.hint("shuffle_merge"), same & gap, "left_semi").drop("bucket").distinct()

    whole = parts.withColumn("bucket", F.floor(F.col("start") / scope).cast("long"))
    ids = near(whole.where("kind = 'weak_id'"), "secret")
    secrets = near(whole.where("kind = 'weak_secret'"), "id")
    ends = near(whole.where("kind = 'weak_endpoint'"), "id").withColumn("bucket", F.floor(F.col("start") / scope).cast("long"))
    every = ids.unionByName(secrets).unionByName(near(ends, "secret"))
    return stored(every.groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked")), "secret-links")


def with_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_linked, base and spans.

    base and spans are array<struct<start,rank,end,kind>> in order of start, then kind.
    """
    found = stored(scan(docs, id_col, text_col), "secret-scan")
    more = linked(found, scope).withColumnRenamed("k1", "l1").withColumnRenamed("k2", "l2")
    both = found.join(more.hint("shuffle_merge"), (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def placed(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    rank = F.array(*(F.lit(k) for k in ORDER))
    extra = F.transform(F.coalesce("linked", none), lambda s: F.struct(s["start"].alias("start"), (F.array_position(rank, s["kind"]) - 1).cast("int").alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    base = F.concat(*(placed(k) for k in BASE))
    return both.select(
        F.col("id").alias(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.size(extra).cast("long").alias("n_linked"),
        F.array_sort(base).alias("base"),
        F.array_sort(F.concat(base, extra)).alias("spans"),
    )


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and all spans."""
    found = with_secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), "n_linked")
