"""Clusters of articles over time: keywords, vocabulary drift, emerging and fading topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.signals import words
from sparkloom.operators.trends import daily_counts, narratives
from sparkloom.sources.scratch import stored


def word_table(articles: DataFrame, key: str, min_length: int = 4) -> DataFrame:
    """key, word, n: words of min_length letters up; stored, as its size can't be foreseen."""
    w = articles.select(key, F.explode(words(F.col("text"))).alias("word")).where(F.length("word") >= min_length)
    return stored(w.groupBy(key, "word").agg(F.count("*").alias("n")), "words")


def top_words(table: DataFrame, key: str, keep: int) -> DataFrame:
    """The keep most frequent words of each key, with rank and share of the key's words.

    The rank stands alone above the table, so that each task keeps its own first keep words of a key
    before anything is shuffled; totals are sums.  No task meets a whole vocabulary.
    """
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))
    first = table.withColumn("rank", r).where(F.col("rank") <= keep)
    total = table.groupBy(key).agg(F.sum("n").alias("total"))
    return first.join(total.hint("shuffle_merge"), key).withColumn("share", F.col("n") / F.col("total")).drop("total")


def cluster_narratives(articles: DataFrame, cluster: str = "cluster", keywords: int = 10) -> DataFrame:
    """Narratives of clusters (-1 is the outlier cluster and left out), with their keywords."""
    a = articles.where(F.col(cluster) >= 0)
    n = narratives(daily_counts(a, cluster), cluster, min_days=1)
    k = top_words(word_table(a, cluster), cluster, keywords).groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ",").alias("keywords"))
    return n.join(k.hint("shuffle_merge"), cluster, "left")


def class_tfidf(articles: DataFrame, cluster: str = "cluster", keep: int = 10) -> DataFrame:
    """cluster, rank, word, weight by class-based TF-IDF: share in the class times log(1 + A / f)."""
    t = word_table(articles, cluster)
    per = t.groupBy(cluster).agg(F.sum("n").alias("total"))
    mean = per.agg(F.avg("total").alias("a"))
    f = t.groupBy("word").agg(F.sum("n").alias("f"))
    j = t.join(per.hint("shuffle_merge"), cluster).join(f.hint("shuffle_merge"), "word").crossJoin(F.broadcast(mean))  # one row
    j = j.withColumn("weight", F.round(F.col("n") / F.col("total") * F.log(1 + F.col("a") / F.col("f")), 6))
    r = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("weight"), "word"))
    return j.withColumn("rank", r).where(F.col("rank") <= keep).select(cluster, F.col("rank").cast("long").alias("rank"), "word", "weight")


def mutation(articles: DataFrame, days: int = 7, min_articles: int = 3, keep: int = 20) -> DataFrame:
    """Vocabulary drift between consecutive windows of days, anchored at the first article.

    Per window: articles, words kept, gained and lost of the top list against the window before
    (windows with too few articles are skipped), retention, drift over the 50 commonest words'
    shares, growth of the number of articles, and the words kept, gained and lost.
    """
    dated = articles.where(F.col("ts").isNotNull())
    first = dated.agg(F.min("ts").alias("t0"))
    w = dated.crossJoin(F.broadcast(first)).withColumn("window_id", F.floor((F.unix_micros("ts") - F.unix_micros("t0")) / (days * 86_400_000_000)))  # one row
    n = w.groupBy("window_id").agg(F.count("*").alias("n_articles")).where(F.col("n_articles") >= min_articles)
    order = Window.orderBy("window_id")  # one row a window, not a row of the table
    n = n.withColumn("previous", F.lag("window_id").over(order)).withColumn("previous_articles", F.lag("n_articles").over(order))
    t = stored(top_words(word_table(w, "window_id"), "window_id", 50).select("window_id", "word", "rank", "share"), "window-words")
    n = stored(n, "windows")  # a row each
    now = n.join(t.hint("shuffle_merge"), "window_id").select("window_id", "previous", "word", "rank", "share")
    before = t.select(F.col("window_id").alias("previous"), "word", F.col("rank").alias("rank_before"), F.col("share").alias("share_before"))
    both = now.where("previous IS NOT NULL").join(before.hint("shuffle_merge"), ["previous", "word"])
    kept = both.groupBy("window_id").agg(F.count_if((F.col("rank") <= keep) & (F.col("rank_before") <= keep)).alias("retained"), F.sum(F.least("share", "share_before")).alias("overlap"), _listed("word", (F.col("rank") <= keep) & (F.col("rank_before") <= keep)).alias("retained_words"))
    of = n.where("previous IS NOT NULL").select("window_id", "previous")
    lists = of.join(t.where(F.col("rank") <= keep).select("window_id", "word", F.lit(1).alias("now")).hint("shuffle_merge"), "window_id")
    gone = of.join(t.where(F.col("rank") <= keep).select(F.col("window_id").alias("previous"), "word", F.lit(1).alias("then")).hint("shuffle_merge"), "previous")
    each = lists.select("window_id", "word", "now").join(gone.select("window_id", "word", "then").hint("shuffle_merge"), ["window_id", "word"], "full")
    moved = each.groupBy("window_id").agg(_listed("word", F.col("then").isNull()).alias("emerged_words"), _listed("word", F.col("now").isNull()).alias("disappeared_words"))
    size = t.where(F.col("rank") <= keep).groupBy("window_id").agg(F.count("*").alias("size"))
    out = n.where("previous IS NOT NULL").join(size.hint("shuffle_merge"), "window_id", "left").join(size.select(F.col("window_id").alias("previous"), F.col("size").alias("size_before")).hint("shuffle_merge"), "previous", "left")
    out = out.join(kept.hint("shuffle_merge"), "window_id", "left").join(moved.hint("shuffle_merge"), "window_id", "left").fillna(0, ["retained", "overlap", "size", "size_before"]).fillna("", ["retained_words", "emerged_words", "disappeared_words"])
    return out.select(
        "window_id", "n_articles", "retained", (F.col("size") - F.col("retained")).alias("emerged"), (F.col("size_before") - F.col("retained")).alias("disappeared"),
        F.round(100 * F.col("retained") / F.greatest("size_before", F.lit(1)), 1).alias("retention"), F.round(1 - F.col("overlap"), 4).alias("drift"),
        F.round(100 * (F.col("n_articles") - F.col("previous_articles")) / F.col("previous_articles"), 1).alias("growth"),
        "retained_words", "emerged_words", "disappeared_words",
    )


def _listed(word: str, test: Column) -> Column:
    """The words that pass, in order, with commas: of top lists, so few."""
    return F.array_join(F.array_sort(F.collect_set(F.when(test, F.col(word)))), ",")


RISING, FALLING = ("emerging", "accelerating", "growing"), ("declining", "fading", "dormant")


def _topics(entities: DataFrame, clusters: DataFrame, phases: tuple[str, ...]) -> DataFrame:
    cols = ["phase", "acceleration", "recent_7_days", "total_mentions"]
    e = entities.select(F.lit("entity").alias("kind"), F.col("entity").cast("string").alias("topic"), *cols)
    c = clusters.select(F.lit("cluster").alias("kind"), F.col("cluster").cast("string").alias("topic"), *cols)
    return e.unionByName(c).where(F.col("phase").isin(*phases))


def emerging_topics(entities: DataFrame, clusters: DataFrame, n: int = 10) -> DataFrame:
    return _topics(entities, clusters, RISING).orderBy(F.desc("acceleration"), F.desc("recent_7_days"), "kind", "topic").limit(n)


def disappearing_topics(entities: DataFrame, clusters: DataFrame, n: int = 10) -> DataFrame:
    return _topics(entities, clusters, FALLING).orderBy("acceleration", F.desc("total_mentions"), "kind", "topic").limit(n)


def narrative_summary(n: DataFrame) -> DataFrame:
    return n.groupBy("phase").agg(F.count("*").alias("n"), F.sum("total_mentions").alias("mentions"))


def topic_evolution(articles: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, total, first_seen, last_seen, momentum: mentions of the later half of its active days less the earlier."""
    d = daily_counts(articles, cluster)
    w = Window.partitionBy(cluster)
    half = F.row_number().over(w.orderBy("day")) * 2 > F.count("*").over(w)
    s = d.withColumn("late", half).groupBy(cluster).agg(F.sum("n").alias("total"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(-F.col("n"))).alias("momentum"))
    return s


def cluster_vectors(vectors: DataFrame, k: int, min_size: int = 3, seed: int = 42) -> DataFrame:
    """id, cluster by k-means over embeddings; clusters smaller than min_size become -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.withColumn("features", array_to_vector("embedding"))
    out = KMeans(k=k, seed=seed, maxIter=10, predictionCol="c").fit(v).transform(v)
    sizes = out.groupBy("c").agg(F.count("*").alias("size"))
    return out.join(F.broadcast(sizes), "c").select("id", F.when(F.col("size") >= min_size, F.col("c")).otherwise(-1).alias("cluster"))  # k rows
