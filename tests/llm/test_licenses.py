import random

from hypothesis import given, settings, strategies as st

from orrery.llm import licenses

from .brute import documents


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert len(pairs) <= table[-1][-1]
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert len(pairs) == table[-1][-1]  # all words are anchors


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=30, unique=True))
def test_longest_increasing_subsequence(values):
    found = [b for _, b in licenses._increasing(list(enumerate(values)))]
    best = [1] * len(values)
    for i, v in enumerate(values):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < v), default=0)
    assert found == sorted(found) and len(found) == max(best, default=0)


def plain_scan(text, templates, coverage):
    """All windows of every template, aligned without a filter before it."""
    words, out = licenses.tokens(text), []
    for name, template in sorted(templates.items()):
        own = licenses.tokens(template)
        places = []
        for at in range(len(words)):
            if words[at] in own and own.index(words[at]) <= len(own) * (1 - coverage) + 1e-9:
                matched = licenses.align(words[at : at + 2 * len(own)], own)
                if matched and len(matched) / len(own) >= coverage - 1e-9:
                    places.append((-len(matched), matched[-1][0] - matched[0][0], at + matched[0][0], at + matched[-1][0]))
        kept = []
        for k, _, a, b in sorted(places):
            if all(b < x or y < a for _, x, y in kept):
                kept.append((-k, a, b))
        out += [(name, k / len(own), a, b - a + 1) for k, a, b in sorted(kept, key=lambda x: x[1])]
    return out


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_every_place_against_a_plain_scan(data):
    words = st.sampled_from(["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"])
    templates = {f"t{i}": " ".join(data.draw(st.lists(words, min_size=1, max_size=12))) for i in range(3)}
    parts = [data.draw(st.one_of(st.lists(words, max_size=8).map(" ".join), st.sampled_from(sorted(templates.values())))) for _ in range(data.draw(st.integers(0, 6)))]
    text, coverage = " ".join(parts), data.draw(st.sampled_from([0.6, 0.8, 1.0]))
    assert [x[:4] for x in licenses.Scanner(templates, coverage).scan(text)] == plain_scan(text, templates, coverage)


def test_places_do_not_depend_on_their_offset():
    inserted = "Released under the well known and much used MIT License"
    for offset in range(12):
        found = licenses.Scanner(licenses.TEMPLATES).scan("word " * offset + inserted + " end" * 20)
        assert [(x[0], x[2], x[3]) for x in found] == [("MIT", offset, 10)]
    text = "Released under the MIT License. Then some words. Released under the MIT License. All rights reserved."
    assert [(x[0], x[4]) for x in licenses.Scanner(licenses.TEMPLATES).scan(text)] == [("MIT", "Released under the MIT License")] * 2 + [("all-rights-reserved", "All rights reserved")]


def test_planted_licenses(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["the", "of", "license", "under", "or", "copy", "w1", "w2"]) for _ in range(n))
    within = {name: {x[0] for x in licenses.Scanner(licenses.TEMPLATES).scan(text)} for name, text in licenses.TEMPLATES.items()}
    rows, planted, allowed = [], set(), set()
    for i, (name, text) in enumerate(sorted(licenses.TEMPLATES.items()) * 4):
        own = text.split()
        if i >= len(within) and len(own) > 6:
            own[rng.randrange(len(own))] = "changed"
        rows.append((i, f"{say(rng.choice([0, 7, 900]))}\n{' '.join(own).upper()} {say(rng.choice([0, 40]))}", "en", "s", 1))
        planted.add((i, name))
        allowed |= {(i, x) for x in within[name]}
    clean = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "we had no rights and were not reserved", "en", "s", 1), (903, say(20000), "en", "s", 1), (None, "All rights reserved", "en", "s", 1), (None, "All rights reserved", "en", "s", 1)]
    found = licenses.scan(documents(spark, [(*r, 1) for r in rows + clean], ", coverage int")).collect()
    pairs = {(r.doc_id, r.license) for r in found}
    assert planted <= pairs <= allowed | {(None, "all-rights-reserved")}
    assert sum(r.doc_id is None for r in found) == 2
    assert all(0.8 <= r.coverage <= 1 for r in found)


def test_empty(spark):
    assert licenses.scan(documents(spark, [])).collect() == []
    assert licenses.scan(documents(spark, [(1, "x", "en", "s", 1)]), {"none": "", "x": "x"}).first().license == "x"
