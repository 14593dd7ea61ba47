from orrery.llm import mixing

from .brute import documents


def test_targets_and_words_taken(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 4}" if i % 5 else None, 1) for i in range(300)]
    rows += [(900, None, None, "s0", None), (901, "", "en", "void", 0), (901, "", "en", "void", 0), (None, "a b", "en", "s1", 3), (902, "x " * 5000, "en", "s9", 1)]
    found = mixing.mix(documents(spark, [(*r, 1, "k") for r in rows], ", size int, key string")).collect()
    assert len(found) == len(rows)
    total = sum(r.size for r in found)
    assert sum(r.taken for r in found) == int(1.5 * total)
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in found)
    source = {r[0]: r[3] for r in rows}
    aims, taken = {}, {}
    for r in found:
        aims[source[r.doc_id]] = r.target
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert abs(sum(aims.values()) - 1.5 * total) < 1e-6
    assert all(abs(taken[s] - aims[s]) <= (5000 if s == "s9" else 50) for s in aims)
    again = mixing.mix(documents(spark, rows[::-1])).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_no_words(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(documents(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)])).collect()] == [0, 0]


def test_rows_alike_without_an_id(spark):
    """A third of all rows are one text without an id, read in several partitions."""
    rows = [(None, "a b c", "en", "s0", 5)] * 400 + [(i, f"w{i} " * (1 + i % 5), "en", f"s{i % 2}", 1) for i in range(800)]
    docs = documents(spark, rows).repartition(7)
    found = mixing.mix(docs).collect()
    total = sum(r.size for r in found)
    assert len(found) == 1200 and sum(r.taken for r in found) == int(1.5 * total)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(documents(spark, rows).coalesce(1)).collect()))
    kept = mixing.mixed_in(docs).collect()
    assert sorted((r.doc_id or -1, r.mix_taken) for r in kept) == sorted((r.doc_id or -1, r.taken) for r in found if r.taken)


def test_columns_of_any_name(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 3}", 1, 2, 3, 4, 5) for i in range(60)]
    docs = documents(spark, rows, ", _id int, `a.b` int, mix_size int, DOC_ID int")
    kept = mixing.mixed_in(docs)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "_id", "a.b", "DOC_ID", "mix_size", "mix_target", "mix_taken"]
    found = {r[0]: r for r in kept.collect()}
    assert all(r[5:8] == (2, 3, 5) and r[8] == 1 + i % 7 for i, r in found.items())
    assert sum(r[10] for r in found.values()) == int(1.5 * sum(1 + i % 7 for i in range(60)))


def test_native_plan(spark, capsys):
    mixing.mix(documents(spark, [(1, "a b", "en", "s", 1)])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
