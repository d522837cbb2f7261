import math
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.llm.common import read
from sparkloom.llm.urls import RULES, entropy, judged, lexical, op3_urls, sample_bounds

SF01 = "/root/testdata/sf0.01"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [r for r, _ in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def check(rows):
    verdicts = dict(RULES)
    for r, url in rows:
        assert (r.host, r.path, r.rule) == brute(url), url
        assert r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block")


def test_against_brute_force(spark):
    pages = read(spark, SF01, "pages")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    out = op3_urls(pages).collect()
    assert len(out) == len(urls)
    check([(r, urls[r.page_id]) for r in out])


def test_trees_agree_with_the_rules(spark):
    pages = read(spark, SF01, "pages")
    out = op3_urls(pages).where("rule is not null")
    assert out.where("(score > 0.5) = (verdict = 'block')").count() >= 0.8 * out.count()


def test_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?a://b", "a://b://c/d", "http://example.com", "http://xexample.com/en/", "ftp://x.example.com/en/?q", "http://É.net/es/", "http://a.net/fr/#", "http://com/", "http://" + "a" * 60000 + ".org/" + "b/" * 9000, "http://a.net?x/es/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, None, "y")], "page_id long, url string, host string")
    out = op3_urls(pages).collect()
    assert len(out) == len(urls) + 1
    check([(r, urls[r.page_id]) for r in out])
    assert op3_urls(pages.limit(0)).count() == 0
    one = op3_urls(spark.createDataFrame([(1, "http://a.com/"), (2, "http://a.org/")], "page_id long, url string")).collect()
    assert {r.verdict for r in one} == {"allow"}


def test_entropy(spark):
    for text in ["", "a", "abca", "http://x.y/z?é"]:
        n = len(text)
        want = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
        got = spark.createDataFrame([(text,)], "t string").select(entropy(F.col("t"))).first()[0]
        assert abs(got - want) < 1e-9


def test_many_rows_of_few_urls(spark):
    urls = ["http://a.com/x", "http://b.net/es/y", "http://c.org/z", "http://d.com/1?q=2"]
    rows = spark.range(100_000).select(F.col("id").alias("page_id"), F.element_at(F.array(*map(F.lit, urls)), (F.col("id") % 4 + 1).cast("int")).alias("url"), F.lit(1).alias("__url"))
    out = {(r.url, r["v"].verdict, r["count"]) for r in judged(rows, out="v").groupBy("url", "v").count().collect()}
    assert {(u, v) for u, v, _ in out if ".org" not in u} == {(urls[0], "allow"), (urls[1], "block"), (urls[3], "allow")} and {n for *_, n in out} == {25_000}


def test_the_sample_keeps_its_bound(spark):
    rows = [(i, f"http://h{i % 977}.{'com' if i % 10 else 'net'}/{'' if i % 10 else 'es/'}p{i}") for i in range(30_000)]
    pages = spark.createDataFrame(rows + rows[:500] * 8, "page_id long, url string")
    labelled = lexical(pages, "url", RULES).select("__url.*").where("label is not null")
    for most in (2_000, 20_000, 100_000):
        n = {0.0: 27_000, 1.0: 3_000}
        for label, (below, weight) in sample_bounds(labelled, most).items():
            taken = labelled.where((F.col("label") == label) & (F.col("hash") < below)).select("hash").distinct().count()
            assert min(n[label], 0.97 * most / 2) <= taken <= most / 2 and abs(taken * weight - n[label]) < 1e-6 * n[label]


def test_quality_on_hosts_that_were_not_learned(spark):
    """Area under the curve on a third of the hosts: 0.65 on sf0.1, 0.73 on sf0.01 when this was written."""
    from sparkloom.llm.common import read
    from sparkloom.llm.urls import held_out_area

    assert held_out_area(read(spark, "/root/testdata/sf0.01", "pages")) >= 0.6
    # A suffix that decides is learned from other hosts, and a single label says nothing.
    urls = [(f"http://h{i}.{'bad' if i % 3 else 'good'}/p{i * 7 % 13}",) for i in range(300)]
    pages = spark.createDataFrame(urls, "url string")
    assert held_out_area(pages, rules=(("bad/", "block"), ("good/", "allow"))) >= 0.99
    assert held_out_area(pages, rules=(("bad/", "block"),)) == 0.5


def test_a_row_is_no_part_of_its_own_suffix_rate(spark):
    """Every suffix stands once: its rate in the other folds is the prior, so trees learn nothing from it."""
    from sparkloom.llm.urls import fitted, lexical

    urls = [(f"http://site.s{i:03}x/page",) for i in range(200)]
    rules = tuple((f"s{i:03}x/", "block" if i % 2 else "allow") for i in range(200))
    labelled = lexical(spark.createDataFrame(urls, "url string"), "url", rules).select("__url.*")
    trees, known, prior = fitted(labelled)
    assert prior == 0.5 and known.count() == 200
    assert trees.featureImportances.toArray()[-1] == 0
