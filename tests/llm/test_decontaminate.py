import random

from orrery.llm import decontaminate

from .brute import documents, shingles, words


def test_search_against_exact_containment(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([3, 6, 12, 40, 90]))) for i in range(40)] + [(50, ""), (51, None), (None, say(20)), (1, say(30))]
    rows = []
    for i in range(80):
        text = say(rng.choice([5, 200, 6000]))
        if i % 2:
            own = words(items[rng.randrange(40)][1])
            if i % 4 == 1 and len(own) > 30:
                own[rng.randrange(len(own))] = "changed"
            text = f"{text} {' '.join(own).upper()}\n{say(50)}"
        rows.append((i, text, "en", "s", 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, items[4][1], "en", "s", 1), (3, rows[3][1], "en", "s", 1)]
    expected = []
    for d, text, *_ in rows:
        for i, item in items:
            n = min(5, len(words(item)))
            own = set(shingles(item, 5))
            have = set(shingles(text, n)) if n and len(words(text)) >= n else set()
            if own and len(own & have) / len(own) >= 0.8:
                expected.append((d, i, len(own & have) / len(own)))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    docs = documents(spark, rows)
    found = [tuple(r) for r in decontaminate.search(docs, bench).collect()]
    assert set(found) <= set(expected)
    assert len(found) >= 0.98 * len(expected) > 20
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    bad = {x[0] for x in found}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None and r[0] not in bad)


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.search(documents(spark, []), bench).collect() == []
    assert decontaminate.search(documents(spark, [(1, "a b", "en", "s", 3)]), bench).collect() == []
