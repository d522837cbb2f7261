"""Operator 3, URL filters: allow and block rules, and boosted trees for the URLs without one.

The longest rule whose host is the URL's host or a parent of it, and whose path begins the
URL's path, decides.  URLs with a rule are the labelled ones; gradient-boosted trees learn the
lexical features from at most TRAIN_ROWS different ones (the documented bound of the model: up
to half of each verdict, those with the least hashes, weighted by what their verdict has in
all): lengths, depth, digit ratio, character entropy, parameter counts, and how
often URLs of the same suffix are blocked, counted over all labelled rows (while the trees learn,
over those of other folds than the URL's own).

DataFrame functions and Spark's own trees only.  Defined results: a null URL or one without
`://` has empty host and path, no rule, and the trees' verdict on it; with one class of label
that class is the verdict, with none `allow`; each row is judged; a URL that fills the table is
one example; extra columns are passed through (a column named as the output is replaced); an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored

# The rules (host/path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
TRAIN_ROWS = 20_000
SMOOTH = 20.0
FOLDS = 5
FEATURES = ["length", "host_length", "path_length", "labels", "depth", "digit_ratio", "hyphens", "entropy", "params", "longest_part", "suffix_block"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest fitting rule, or null.  The rule list is a parameter, one branch each."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits: one pass over the sorted characters."""
    chars = F.array_sort(F.split(text, ""))
    start = F.struct(F.lit("").alias("c"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sum"))
    plogp = lambda n: F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)

    def step(acc: Column, c: Column) -> Column:
        same = c == acc["c"]
        return F.struct(
            c.alias("c"),
            F.when(same, acc["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"),
            F.when(same, acc["sum"]).otherwise(acc["sum"] + plogp(acc["n"])).alias("sum"),
        )

    total = F.aggregate(chars, start, step, lambda acc: acc["sum"] + plogp(acc["n"]))
    n = F.char_length(text)
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def lexical(pages: DataFrame, url_col: str, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """The columns of pages as in0, in1, ... and struct __url: host, path, rule, label (1.0 block, 0.0 allow), raw features."""
    at = pages.columns.index(url_col)
    df = pages.toDF(*(f"in{i}" for i in range(len(pages.columns))))
    url = F.coalesce(F.col(f"in{at}"), F.lit(""))
    host, path = host_and_path(url)
    verdicts = F.create_map(*(F.lit(x) for r in rules for x in r))
    df = df.withColumn("__url", F.struct(host.alias("host"), path.alias("path")))
    df = df.withColumn("__rule", rule_of(F.col("__url.host"), F.col("__url.path"), rules))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    number = lambda c: c.cast("double")
    return df.withColumn(
        "__url",
        F.struct(
            F.col("__url.host").alias("host"),
            F.col("__url.path").alias("path"),
            F.col("__rule").alias("rule"),
            F.when(F.col("__rule").isNotNull(), (verdicts[F.col("__rule")] == "block").cast("double")).alias("label"),
            F.substring_index("__url.host", ".", -1).alias("suffix"),
            number(F.char_length(url)).alias("length"),
            number(F.char_length("__url.host")).alias("host_length"),
            number(F.char_length("__url.path")).alias("path_length"),
            number(F.size(F.split("__url.host", r"\."))).alias("labels"),
            number(F.size(F.filter(F.split("__url.path", "/"), lambda p: p != ""))).alias("depth"),
            (F.char_length(F.regexp_replace(url, "[^0-9]+", "")) / F.greatest(F.char_length(url), F.lit(1))).alias("digit_ratio"),
            number(F.char_length(F.regexp_replace(url, "[^-_]+", ""))).alias("hyphens"),
            entropy(url).alias("entropy"),
            F.when(query == "", 0.0).otherwise(number(F.size(F.split(query, "&")))).alias("params"),
            number(F.array_max(F.transform(F.split(url, r"[/.?#&=]"), lambda p: F.char_length(p)))).alias("longest_part"),
            F.xxhash64(url).bitwiseAND((1 << 53) - 1).alias("hash"),
        ),
    ).drop("__rule")


#: Classes of hashes per verdict that the bound of the sample is counted in.
BINS = 4096


def sample_bounds(labelled: DataFrame, train_rows: int) -> dict[float, tuple[int, float]]:
    """Per label: the hash below which different URLs are taken, and the weight of each of them.

    Hashes (0 to 2^53 - 1) of a stretch that should hold twice the rows wanted are counted in
    BINS classes; the classes from below that stay within the bound are taken.
    """
    urls = stored(labelled.groupBy("label", "hash").agg(F.count("*").alias("n")), "url-hashes")
    most, space, found = train_rows // 2, 1 << 53, {}
    for label, n in ((r.label, r.n) for r in urls.groupBy("label").agg(F.count("*").alias("n")).collect()):
        if n <= most:
            found[label] = (space, 1.0)
            continue
        wide = max(1, int(space * min(1.0, 2 * most / n)) // BINS)
        low = urls.where((F.col("label") == label) & (F.col("hash") < wide * BINS))
        counts = {r.bin: r.n for r in low.groupBy(F.floor(F.col("hash") / wide).cast("long").alias("bin")).agg(F.count("*").alias("n")).collect()}
        taken = bins = 0
        while bins < BINS and taken + counts.get(bins, 0) <= most:
            taken += counts.get(bins, 0)
            bins += 1
        found[label] = (wide * bins, n / max(1, taken))
    return found


def fitted(labelled: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 7) -> tuple | float:
    """labelled(label, suffix, hash, features) -> the trees, the suffixes' rates they know (a stored table of
    at most train_rows suffixes) and the rate of all others; or the one label there is (0.0 if none).

    A row's own label is no part of the rate that the trees learn with it: rows are dealt to FOLDS
    by the URL's hash, and each sees the rate of its suffix in the other folds.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    fold = F.pmod(F.xxhash64("hash"), F.lit(FOLDS)).cast("int").alias("fold")
    by_fold = stored(labelled.groupBy("suffix", fold).agg(F.count("*").alias("n"), F.sum("label").alias("blocked")), "url-suffixes")
    suffixes = by_fold.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    n, blocked = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        return blocked / n if n else 0.0
    below, weight = F.lit(0), F.lit(1.0)
    for label, (hash_bound, each) in sample_bounds(labelled, train_rows).items():
        below, weight = F.when(F.col("label") == label, hash_bound).otherwise(below), F.when(F.col("label") == label, each).otherwise(weight)
    sample = labelled.where(F.col("hash") < below).dropDuplicates(["label", "hash"])
    prior = float(blocked) / n
    rate = lambda b, k: (b + prior * SMOOTH) / (k + SMOOTH)
    # Suffixes of the bounded sample only: at most that many rows.
    sample = stored(sample.withColumn("weight", weight).select("*", fold), "url-urls")
    known = stored(sample.select("suffix").distinct().join(suffixes.hint("shuffle_merge"), "suffix").select("suffix", "n", "blocked", rate(F.col("blocked"), F.col("n")).alias("suffix_block")), "url-known")
    own = by_fold.select("suffix", "fold", F.col("n").alias("own_n"), F.col("blocked").alias("own_blocked"))
    sample = sample.join(F.broadcast(known.drop("suffix_block")), "suffix").join(own.hint("shuffle_merge"), ["suffix", "fold"])
    sample = sample.withColumn("suffix_block", rate(F.col("blocked") - F.col("own_blocked"), F.col("n") - F.col("own_n"))).select("label", "weight", "hash", *FEATURES)
    sample = stored(sample.repartition(8, "hash").sortWithinPartitions("hash", *FEATURES), "url-sample")
    pack = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=15, maxDepth=4, stepSize=0.2, seed=seed)
    return trees.fit(pack.transform(sample)), known.select("suffix", "suffix_block"), prior


def scored(df: DataFrame, model: tuple) -> DataFrame:
    """df(__url, ...) with the trees' prediction and probability."""
    from pyspark.ml.feature import VectorAssembler

    trees, known, prior = model
    own = df.columns
    rows = df.join(F.broadcast(known).withColumnRenamed("suffix", "__suffix"), F.col("__url.suffix") == F.col("__suffix"), "left")
    rows = rows.select(*own, *(F.col(f"__url.{c}") for c in FEATURES[:-1]), F.coalesce("suffix_block", F.lit(prior)).alias("suffix_block"))
    return trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def held_out_area(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, train_rows: int = TRAIN_ROWS, seed: int = 7) -> float:
    """Area under the ROC curve on the labelled URLs of a third of the hosts, learned from the other hosts."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    known = stored(lexical(pages.select(url_col), url_col, rules).select("__url").where("__url.label IS NOT NULL"), "url-labelled")
    apart = F.pmod(F.xxhash64("__url.host"), F.lit(3)) == 0
    model = fitted(known.where(~apart).select("__url.*"), train_rows, seed)
    if isinstance(model, float):
        return 0.5
    rows = scored(known.where(apart), model).withColumn("label", F.col("__url.label"))
    return BinaryClassificationEvaluator(labelCol="label").evaluate(rows.select("label", "rawPrediction"))


def judged(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, train_rows: int = TRAIN_ROWS, seed: int = 7, out: str = "__url") -> DataFrame:
    """pages with one more column, a struct: host, path, rule, verdict and the trees' block score."""
    from pyspark.ml.functions import vector_to_array

    df = lexical(pages, url_col, rules)
    kept = [F.col(f"in{i}").alias(c) for i, c in enumerate(pages.columns) if c != out]

    def verdicts(other: Column, score: Column) -> Column:
        by_rule = F.when(F.col("__url.label") == 1, "block").when(F.col("__url.label") == 0, "allow").otherwise(other)
        return F.struct("__url.host", "__url.path", "__url.rule", by_rule.alias("verdict"), score.alias("score")).alias(out)

    model = fitted(df.select("__url.*").where("label is not null"), train_rows, seed)
    if isinstance(model, float):
        return df.select(*kept, verdicts(F.lit("block" if model > 0 else "allow"), F.lit(model)))
    by_trees = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return scored(df, model).select(*kept, verdicts(by_trees, F.round(vector_to_array("probability")[1], 6)))


def op3_urls(pages: DataFrame) -> DataFrame:
    return judged(pages.select("page_id", "url")).select("page_id", "__url.host", "__url.path", "__url.rule", "__url.verdict", "__url.score")
