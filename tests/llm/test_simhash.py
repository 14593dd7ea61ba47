import itertools
import random

import pytest

from orrery.llm import simhash
from orrery.llm.scratch import Scratch

from .brute import documents, groups
from .brute import simhash as plain


def expected(rows):
    fps = [plain(r[1]) for r in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    root = groups(len(rows), near)
    least = {}
    for r, g in zip(rows, root):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], f"{f:016x}", least.get(g)) for r, f, g in zip(rows, fps, root)), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 400]))]
        for _ in range(rng.choice([1, 1, 4])):
            rows.append((len(rows), " ".join(text), "en", "s", 1))
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, " \t\n", "en", "s", 3), (903, "One TWO", "en", "s", 7), (904, "one two", "en", "s", 7)]
    rows += [(None, "one two", "en", "s", 7), (903, "One TWO", "en", "s", 7), (905, "é " * 30000, "fr", "s", 60000)]
    found = simhash.near_duplicates(documents(spark, [(*r, 1) for r in rows], ", component_id int")).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected(rows)


def test_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_links_keep_components_of_crowded_fingerprints(spark, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(8)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    linked = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), Scratch(spark, "test")).collect()
    at = {x: i for i, x in enumerate(fps)}
    every = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2]
    assert groups(len(fps), [(at[r.u], at[r.v]) for r in linked]) == groups(len(fps), every)
