import itertools
import random

import corpus_pipeline
from orrery.llm import linededup, mixing, neardup

from .brute import documents, shingles


def similarity(a, b):
    a, b = set(shingles(a, 5)), set(shingles(b, 5))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_duplicates_against_exact_similarity(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 25, 120, 900]))]
        for edits in [0] * rng.choice([1, 1, 3]) + [rng.choice([1, 2, 8, 40]) for _ in range(3)]:
            text = list(base)
            for _ in range(min(edits, len(text) // 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text), "en", "s", 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "only null id here now", "en", "s", 1), (3, rows[3][1], "en", "s", 1)]
    docs = documents(spark, [(*r, 1) for r in rows], ", root int")
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 900 in ids and 901 not in ids
    text = {r[0]: r[1] for r in rows}
    left = [p for p in itertools.combinations([i for i in ids if i is not None], 2) if similarity(text[p[0]], text[p[1]]) >= 0.8]
    pairs = [p for p in itertools.combinations([r[0] for r in rows if r[0] is not None and r[0] < 900], 2) if similarity(text[p[0]], text[p[1]]) >= 0.8]
    assert len(pairs) > 100 and len(left) <= 0.03 * len(pairs)
    for gone in set(text) - set(ids):
        assert max(similarity(text[gone], text[other]) for other in text if other != gone) >= 0.7


def test_rows_of_the_mix(spark):
    rows = [(i % 20, "w " * (1 + i % 5), "en", None if i % 3 else "a", 1) for i in range(60)] + [(None, "x", "en", "b", 1)]
    docs = documents(spark, rows)
    got = mixing.mixed_in(docs).collect()
    total = sum(len(r[1].split()) for r in rows)
    assert sum(r.mix_taken for r in got) == int(1.5 * total) and all(0 < r.mix_taken <= 2 * r.mix_size for r in got)


def test_emptied_documents_go(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a\n{passage}", "en", "s", 1), (2, passage, "en", "s", 1), (3, f"{passage}\nb", "en", "s", 9), (4, None, None, None, None), (5, "", "en", "s", 0)]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in linededup.remaining(documents(spark, rows)).collect()) == [(1, rows[0][1], 1), (3, "b", 1), (4, None, None), (5, "", 0)]


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = {"aa": ["the", "of", "and", "ing"], "bb": ["der", "und", "für", "ung"]}
    say = lambda lang, n: " ".join("".join(rng.choice(vocabulary[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, say("aa" if i % 2 else "bb", 80), "aa" if i % 2 else "bb", f"s{i % 3}", 1) for i in range(60)]
    item = say("aa", 40)
    rows += [(100, rows[5][1], "aa", "s0", 1), (101, f"{say('aa', 30)} {item}", "aa", "s0", 1), (102, "123 456", "aa", "s0", 1), (103, rows[7][1].replace("the", "of", 1), "aa", "s1", 1)]
    for name, df in (("documents", documents(spark, rows)), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, str(tmp_path))
        assert i == len(corpus_pipeline.STAGES) - 1 or after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
    before = spark.read.parquet(f"{tmp_path}/stage3")
    assert {r.doc_id for r in before.collect()} == set(range(60))
    assert {r.doc_id for r in docs.collect()} <= set(range(60))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
