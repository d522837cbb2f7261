"""Each stage of the corpus pipeline on its own input, held against the brute forces of its operator's tests."""

import re

import corpus_pipeline
from sparkloom.llm.common import read, stored
from tests.llm import test_disclosure, test_fertility, test_minmax, test_packing, test_templates

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "pii", "packing"]
    given = texts(docs)

    good = stored(stages["quality"](spark, docs, SF), "test-quality")
    kept = texts(good)
    assert good.columns == docs.columns and kept and all(given[i] == t for i, t in kept.items())
    assert not any(test_fertility.brute(t)[-1] for t in kept.values())

    single = stored(stages["near_dedup"](spark, good, SF), "test-dedup")
    home = test_minmax.brute(list(kept.items()), words=5)
    assert single.columns == docs.columns and texts(single) == {i: t for i, t in kept.items() if home[i][2]}

    clean = stored(stages["decontaminate"](spark, single, SF), "test-clean")
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    bad = {d for d, _ in test_templates.brute(list(texts(single).items()), items)}
    assert clean.columns == docs.columns and texts(clean) == {i: t for i, t in texts(single).items() if i not in bad}

    private = stored(stages["pii"](spark, clean, SF), "test-pii")
    before, after = texts(clean), texts(private)
    assert private.columns == docs.columns and before.keys() == after.keys()
    for i, t in after.items():
        hits = [m for k, p in test_disclosure.RULES for m in re.finditer(p, before[i]) if test_disclosure.fits(k, m[0])]
        assert ("[EMAIL]" in t or "[IP]" in t or "[CARD]" in t or "[PHONE]" in t) if hits else not re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", t) or t == before[i]

    rows = stages["packing"](spark, private, SF).collect()
    test_packing.sound(rows, {i: len(t.encode().split()) for i, t in after.items()})


def test_stages_on_odd_rows(spark):
    long_ = " ".join(f"w{i}" for i in range(3000))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, None), (3, long_, "en", "s", 9), (3, long_, "en", "s", 9), (None, long_ + " a@b.co", None, "s", 1), (4, " \n", "xx", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        found = out.collect()
        if name == "pii":
            assert len(found) == len(rows) and sum(r.text is None for r in found) == 2 and any(r.text and "[EMAIL]" in r.text for r in found)
        elif name == "quality":
            assert {r.doc_id for r in found} <= {3, None} and all(r.text for r in found)
        elif name == "near_dedup":
            assert sorted(str(r.doc_id) for r in found if r.text == long_) == ["3"]
        elif name == "decontaminate":
            assert len(found) == len(rows)
        else:
            assert len(found) == len(rows)


ODD_NAMES = ["meta.url", "back`tick", "__fertility", "__pii", "id", "key", "component_id", "kept", "window", "column 1", "Text", "DOC_ID", "size"]


def test_stages_on_odd_names_and_string_ids(spark):
    good = corpus_pipeline.quality(spark, read(spark, SF, "documents").where("lang = 'en'"), SF)
    one, other = [r.text for r in good.where("length(text) < 5000").orderBy("doc_id").limit(2).collect()]
    rows = [("b", one, "en", "s", 9), ("a", one, "en", "s", 9), ("c", other + " a@b.co", "en", None, 9), (None, "", None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long")
    left = {"quality": {"a", "b", "c"}, "near_dedup": {"a", "c", None}, "decontaminate": {"a", "b", "c", None}, "pii": {"a", "b", "c", None}}
    docs = plain.select("*", *(plain.source.alias(f"x{i}") for i in range(len(ODD_NAMES)))).toDF(*plain.columns, *ODD_NAMES)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        found = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and {r[0] for r in found} == left[name]
            assert all(set(r[5:]) == {r[3]} for r in found)


def test_run_leaves_the_stages_tables_alone(spark):
    import os

    from sparkloom.llm.common import scratch_dir

    folder = scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 100
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before}
    assert left == {f"stage-{name}" for name, _ in corpus_pipeline.STAGES}
