"""Every operator and stage over columns whose names clash with helpers, hold dots or differ in case,
and over a very long text."""

import pytest

import corpus_pipeline
from orrery.llm import decontaminate, langid, licenses, linededup, lm, mixing, neardup, simhash, sketch, tokencounts, warc

from .brute import documents

EXTRA = ["_h", "_id", "_n", "_lines", "mix_size", "a.b", "DOC_ID", "row", "c0", "h", "nn", "text_", "key", "chunk", "ord"]
WORDS = ["the", "of", "and", "river", "stone", "garden", "music", "letter", "window", "morning"]


def rows():
    out = [(i, " ".join(WORDS[(i * k + k) % 10] + str(i % 7 if k % 9 else "") for k in range(30 + i)), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(40)]
    out += [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, "All rights reserved. " + " ".join(f"w{i % 5000}" for i in range(300_000)), "en", "s1", 1)]
    return [(*r, *range(len(EXTRA))) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, rows(), "".join(f", `{c}` int" for c in EXTRA))


@pytest.fixture(scope="module")
def bench(spark):
    item = " ".join(f"w{i}" for i in range(4000, 4040))
    return spark.createDataFrame([(7, item, 1, 2)], "item_id long, text string, `a.b` int, ITEM_ID int")


def test_operators(spark, docs, bench):
    n = docs.count()
    for f in (simhash.near_duplicates, mixing.mix, langid.identify, lm.score, sketch.fingerprints):
        assert f(docs).count() == n, f
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == {(902, "all-rights-reserved")}
    assert {(r.doc_id, r.item_id, r.containment) for r in decontaminate.search(docs, bench).collect()} == {(902, 7, 1.0)}
    assert sum(r.docs for r in tokencounts.totals(docs).collect() if r.tokenizer == "words-1") > 30
    found = linededup.deduplicate(docs)
    assert found.columns == [c for c in docs.columns if c != "_lines"] + ["_lines"] and found.count() == n
    assert {tuple(r[5:8]) + tuple(r[8:-1]) for r in found.collect()} == {tuple(i for i, c in enumerate(EXTRA) if c != "_lines")}


def test_pages(spark):
    pages = spark.createDataFrame([(i, "u", "h" * (i % 3), i, 0) for i in range(9)], "page_id long, url string, html string, digest int, PAGE_ID int")
    assert warc.round_trip(pages).count() == 9


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, bench, tmp_path, stage):
    bench.toDF("item_id", "text", "a.b", "x").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, str(tmp_path))
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
        extra = {tuple(r[5:]) for r in out.collect()}
    else:
        left = [i for i, c in enumerate(EXTRA) if c != "mix_size"]
        assert out.columns == [c for c in docs.columns if c != "mix_size"] + ["mix_size", "mix_target", "mix_taken"]
        extra = {tuple(r[5:-3]) for r in out.collect()}
        assert extra == {tuple(left)}
        return
    assert extra == {tuple(range(len(EXTRA)))}
    ids = {r[0] for r in out.collect()}
    assert (902 in ids) == (name != "benchmark decontamination") and len(ids) > 5


def test_a_name_that_is_not_there(spark):
    with pytest.raises(ValueError, match="named text"):
        simhash.near_duplicates(spark.createDataFrame([(1, 2)], "doc_id long, words int"))


def test_neardup_of_very_long_texts(spark):
    long = " ".join(f"v{i % 70_000}" for i in range(200_000))
    other = long.replace("v5 ", "changed ", 1)
    kept = neardup.one_of_each(documents(spark, [(1, long, "en", "s", 1), (2, other, "en", "s", 1), (3, "short text of five words", "en", "s", 1)])).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
