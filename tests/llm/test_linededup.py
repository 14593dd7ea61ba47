import hashlib
import random

from orrery.llm import linededup

from .brute import documents


def deleted(texts, min_words):
    """For texts in order: the lines covered by a maximal repeated run that began earlier."""
    lines = [t.split("\n") for t in texts]
    flat = [(d, i) for d, x in enumerate(lines) for i in range(len(x))]
    gone = set()
    for at, (d, i) in enumerate(flat):
        longest = 0
        for e, j in flat[:at]:
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n]:
                n += 1
            longest = max(longest, n)
        if sum(len(x.split()) for x in lines[d][i : i + longest]) >= min_words and longest:
            gone |= {(d, i + n) for n in range(longest)}
    return ["\n".join(x for i, x in enumerate(ls) if (d, i) not in gone) for d, ls in enumerate(lines)]


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 3, 9]))) for _ in range(12)]
    texts = []
    for _ in range(40):
        lines = []
        while len(lines) < rng.choice([1, 5, 30]):
            k = rng.randrange(len(pool))
            lines += pool[k : k + rng.randint(1, 6)] if rng.random() < 0.8 else [f"new {rng.random()} " * rng.randint(1, 4)]
        texts.append("\n".join(lines))
    texts += ["", "long " * 40000, "long " * 40000, texts[3]]
    for min_words in (12, 1):
        rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)]
        found = linededup.deduplicate(documents(spark, rows, ", h string"), min_words).collect()
        assert [r.text for r in sorted(found, key=lambda r: r.doc_id)] == deleted(texts, min_words)
        assert all(r.h == "x" for r in found)


def test_defined_cases(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    rows = [(1, None, None, None, None), (2, f"a\n{passage}\nb", "en", "s", 1), (3, f"c\n{passage}", "en", "s", 1), (3, f"c\n{passage}", "en", "s", 1), (4, passage, "en", "s", 1), (None, "n", "en", "s", 1)]
    found = linededup.deduplicate(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text, r._lines.n, r._lines.removed) for r in found), key=str) == sorted(
        [(1, None, 0, 0), (2, rows[1][1], 3, 0), (3, "c", 2, 1), (3, "c", 2, 1), (4, "", 1, 1), (None, "n", 1, 0)], key=str
    )
    assert linededup.deduplicate(documents(spark, [])).collect() == []


def test_suffix_array_and_common_prefixes(spark):
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 9]))) for _ in range(6)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.choice([1, 9, 40]))) for _ in range(30)] + ["\n".join(["same"] * 100)] * 2
    found = sorted(linededup.suffix_array(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), 4).collect(), key=lambda r: r.place)
    lines = [t.split("\n") for t in texts]
    starts = [(r.doc_id, r.line) for r in found]
    assert len(set(starts)) == len(starts) > 500

    def shared(a, b):
        x, y = lines[a[0]][a[1] :], lines[b[0]][b[1] :]
        return next((n for n, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))

    assert [r.lcp for r in found] == [0] + [shared(a, b) for a, b in zip(starts, starts[1:])]
    # an order of suffixes: those of any common prefix stand together
    for m in (1, 2, 5, 20):
        groups = [tuple(lines[d][i : i + m]) for d, i in starts if i + m <= len(lines[d])]
        assert len({g for g, h in zip(groups, [None, *groups]) if g != h}) == sum(g != h for g, h in zip(groups, [None, *groups]))
