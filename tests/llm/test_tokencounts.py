from collections import Counter

import pytest
from pyspark.errors import PySparkException

from orrery.llm import tokencounts
from orrery.llm.scratch import Scratch

from .brute import documents, words

CHANGES = "op string, doc_id long, source string, lang string, text string, tokens int"


def plain(live):
    out = Counter()
    for rows in live.values():
        for source, lang, text in rows:
            out[source, lang, "w", "docs"] += 1
            out[source, lang, "w", "tokens"] += len(words(text))
    return {k: v for k, v in out.items() if v}


def got(rollup):
    return {(r.source, r.lang, r.tokenizer, c): r[c] for r in rollup.totals().collect() for c in ("docs", "tokens") if r[c]}


def test_deltas_against_recount(spark):
    rollup = tokencounts.Rollup(spark, Scratch(spark, "test").path("rollup"), {"w": tokencounts.count_words})
    assert rollup.totals().collect() == []
    batches = [
        [("insert", i, f"s{i % 3}", "en" if i % 2 else None, "a b " * i) for i in range(20)] + [("insert", None, None, "en", "x"), ("insert", None, None, "en", "x y"), ("insert", 3, "s0", "en", "again"), ("insert", 50, "s1", "de", None)],
        [("delete", 3, None, None, None), ("delete", 3, None, None, None), ("delete", 999, None, None, None), ("revise", 4, "s9", "fr", "new text here"), ("revise", 77, "s9", "fr", "late")],
        [],
        [("delete", None, None, None, None), ("delete", 4, None, None, None), ("insert", 4, "s9", "fr", "one"), ("insert", 60, "s1", "de", "w " * 300000)],
    ]
    live = {}
    for n, batch in enumerate(batches):
        df = spark.createDataFrame([(*x, 1) for x in batch], CHANGES)
        assert rollup.apply(f"b/{n}", df)
        for op, i, *_ in batch:
            if op != "insert":
                live.pop(i, None)
        for op, i, *row in batch:
            if op != "delete":
                live.setdefault(i, []).append(row)
        assert got(rollup) == plain(live)
        assert not rollup.apply(f"b/{n}", df)
        assert got(rollup) == plain(live)
    assert rollup.batches() == {"b/0", "b/1", "b/2", "b/3"}


def test_a_batch_that_breaks_off_is_not_seen(spark):
    rollup = tokencounts.Rollup(spark, Scratch(spark, "test").path("rollup"), {"w": tokencounts.count_words})
    good = spark.createDataFrame([("insert", 1, "s", "en", "a b", 1)], CHANGES)
    with pytest.raises(PySparkException):
        rollup.apply("one", good.union(spark.createDataFrame([("upsert", 2, "s", "en", "c", 1)], CHANGES)))
    assert rollup.totals().collect() == [] and rollup.apply("one", good)
    assert got(rollup) == {("s", "en", "w", "docs"): 1, ("s", "en", "w", "tokens"): 2}


def test_batches_that_race_are_worked_out_again(spark):
    rollup = tokencounts.Rollup(spark, Scratch(spark, "test").path("rollup"), {"w": tokencounts.count_words})
    rollup.apply("first", spark.createDataFrame([("insert", 1, "s", "en", "a b c", 1), ("insert", 2, "s", "en", "d", 1)], CHANGES))
    gone = spark.createDataFrame([("delete", 1, None, None, None, 1)], CHANGES)
    rival = tokencounts.Rollup(spark, rollup.folder, rollup.counters)
    real, calls = rollup._claim, []

    def late(number, body):
        if not calls:  # the other deletes the same document between this one's look and its commit
            calls.append(rival.apply("other", gone))
        return real(number, body)

    rollup._claim = late
    assert rollup.apply("mine", gone) and calls == [True]
    assert got(rollup) == {("s", "en", "w", "docs"): 1, ("s", "en", "w", "tokens"): 1}
    calls.clear()

    def same(number, body):
        if not calls:
            calls.append(rival.apply("same", gone))
        return real(number, body)

    rollup._claim = same
    assert not rollup.apply("same", gone)
    assert rollup.batches() == {"first", "other", "mine", "same"}


def test_a_marker_that_was_not_finished_does_no_harm(spark):
    rollup = tokencounts.Rollup(spark, Scratch(spark, "test").path("rollup"), {"w": tokencounts.count_words})
    rollup.apply("one", spark.createDataFrame([("insert", 1, "s", "en", "a b", 1)], CHANGES))
    path, fs = rollup._path("commits", "feed.new")
    fs.create(path, True).close()  # as a driver leaves it that dies while it writes
    assert rollup.batches() == {"one"} and got(rollup)
    assert rollup.apply("two", spark.createDataFrame([("insert", 2, "s", "en", "c", 1)], CHANGES))


def test_compaction(spark):
    rollup = tokencounts.Rollup(spark, Scratch(spark, "test").path("rollup"), {"w": tokencounts.count_words}, compact=2)
    for n in range(6):
        df = spark.createDataFrame([("insert", n, "s", "en", "a " * n, 1), ("delete", n - 2, None, None, None, 1)], CHANGES)
        assert rollup.apply(f"b{n}", df) and not rollup.apply(f"b{n}", df)
        assert got(rollup).get(("s", "en", "w", "tokens"), 0) == sum(range(max(0, n - 1), n + 1))
    assert len(rollup._log()[1]) <= 3 and rollup.batches() == {f"b{n}" for n in range(6)}
    assert not rollup.apply("b0", df)


def test_the_query_against_sql_and_the_tokenizers(spark):
    import duckdb

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = [tuple(r) for r in tokencounts.totals(docs).select("source", "lang", "tokenizer", "docs", "tokens").collect()]
    live, hashed = {}, {r["doc_id"]: r["c"] % 10 for r in docs.selectExpr("doc_id", "crc32(cast(cast(doc_id as string) as binary)) c").collect()}
    for r in docs.collect():
        if hashed[r["doc_id"]] != 7:
            live[r["doc_id"]] = ("revised", r["lang"], f"{r['text']} {r['text']}") if hashed[r["doc_id"]] == 3 else (r["source"], r["lang"], r["text"])
    assert {hashed[i] for i in hashed} == set(range(10))
    for name, count in tokencounts.tokenizers().items():
        want = Counter()
        for source, lang, text in live.values():
            want[source, lang] += count(text)
        assert {(s, g): n for s, g, t, _, n in found if t == name} == want
    con = duckdb.connect()
    con.register("live", spark.createDataFrame([(k, *v) for k, v in live.items()], "doc_id long, source string, lang string, text string").toPandas())
    sql = r"SELECT source, lang, 'words-1', count(*), CAST(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS BIGINT) FROM live GROUP BY source, lang"
    assert sorted(con.execute(sql).fetchall()) == sorted(x for x in found if x[2] == "words-1")


def test_other_tokenizers():
    for kind, name in ((tokencounts.PieceFile, "piece_bpe_32k.model"), (tokencounts.JsonFile, "word_bpe_49k.json")):
        count = kind(f"{tokencounts.FOLDER}/{name}")
        assert 2 <= count("Hello world") <= 4 and count("") == 0


def test_versions(spark):
    rows = [(3, "Hello world, it's 2024!", "en", "s", 1), (2, None, "en", "s", 0), (5, "<|endoftext|>", "en", "s", 1), (None, "x", None, None, 1)]
    kept = [r for r in rows if r[0] is None or spark.sql(f"select crc32(cast('{r[0]}' as binary)) % 10").first()[0] not in (3, 7)]
    found = {r.tokenizer: (r.docs, r.tokens) for r in tokencounts.totals(documents(spark, kept[:-1])).collect()}
    bpe = tokencounts.tokenizers()["byte_bpe_50k"]
    assert found["words-1"] == (len(kept) - 1, sum(len(words(r[1])) for r in kept[:-1]))
    assert found["byte_bpe_50k"] == (len(kept) - 1, sum(bpe(r[1]) if r[1] else 0 for r in kept[:-1]))
    assert bpe("Hello world") == 2 and bpe("<|endoftext|>") > 1
    assert {(r.source, r.lang) for r in tokencounts.totals(documents(spark, rows[-1:])).collect()} == {(None, None)}
