import itertools
import random

import numpy as np
import pyarrow as pa

from orrery.llm import neardup
from orrery.llm.scratch import Scratch

from .brute import documents, groups


def edited(rng, words, edits, i):
    words = list(words)
    for k, at in enumerate(rng.sample(range(len(words)), edits)):
        words[at] = f"e{i}x{k}"
    return " ".join(words)


def fingerprinted(texts):
    """Check fingerprints and small shingles, as the operator has them."""
    n = len(texts)
    batch = pa.record_batch([pa.array([True] * n), pa.array(range(n)), pa.array(range(n)), pa.array(texts)], names=["nn", "id", "h", "text"])
    out = next(neardup._fingerprints(iter([batch])))
    return np.frombuffer(b"".join(out.column("check").to_pylist()), np.uint64).reshape(n, -1), out.column("small").to_pylist()


def near(texts, i, others):
    check, small = fingerprinted([texts[i], *(texts[k] for k in others)])
    return neardup._Check(neardup.SIMILARITY).near(check[1:], check[:1], small[1:], small[:1])


def roots(spark, texts):
    found = neardup.groups(documents(spark, [(i, x, "en", "s", 1) for i, x in enumerate(texts)]), Scratch(spark, "test")).collect()
    return {r.id: r.root for r in found}


def test_hub_of_very_many_edited_copies(spark, monkeypatch):
    """Copies near to one common original only, in groups of many times UNIT."""
    monkeypatch.setattr(neardup, "UNIT", 16)
    rng = random.Random(3)
    original = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(original)] + [edited(rng, original, 8, i) for i in range(1000)]
    close = 1 + np.flatnonzero(near(texts, 0, range(1, len(texts))))
    root = roots(spark, texts)
    assert len(close) > 700 and sum(root[int(i)] != root[0] for i in close) <= 0.002 * len(close)


def test_large_groups_without_a_hub(spark, monkeypatch):
    """All near pairs of a large group are linked, and no others."""
    monkeypatch.setattr(neardup, "UNIT", 40)
    rng = random.Random(5)
    original = [f"w{i}" for i in range(68)]
    texts = [edited(rng, original, rng.choice([1, 2]), i) for i in range(150)]
    pairs = [p for p in itertools.combinations(range(len(texts)), 2)]
    check, small = fingerprinted(texts)
    a, b = np.array(pairs).T
    ok = neardup._Check(neardup.SIMILARITY).near(check[a], check[b], [small[i] for i in a], [small[i] for i in b])
    want = groups(len(texts), [p for p, x in zip(pairs, ok) if x])
    root = roots(spark, texts)
    got = groups(len(texts), [p for p in pairs if root[p[0]] == root[p[1]]])
    assert 10 < len(set(want)) < 140 and got == want


def test_candidates_of_contiguous_edits_do_not_hang_on_the_number_of_texts(spark):
    """Appended and replaced paragraphs among very many other texts."""
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    texts = []
    for i in range(300):
        base = say(400)
        texts += [" ".join(base), " ".join(base + say(80) if i % 2 else base[:180] + say(36) + base[216:])]
    check, small = fingerprinted(texts)
    ok = neardup._Check(neardup.SIMILARITY).near(check[::2], check[1::2], small[::2], small[1::2])
    root = roots(spark, texts + [f"a{i} b{i}" for i in range(50000)])
    lost = sum(root[2 * i] != root[2 * i + 1] for i in np.flatnonzero(ok).tolist())
    assert ok.sum() > 150 and lost <= 0.01 * ok.sum()


def test_keys_of_every_similarity():
    """Pairs share a key as often as the similarity says, at any number of texts."""
    rng = np.random.default_rng(2)
    for common, each, least in ((400, 50, 0.99), (450, 25, 0.999)):
        found = 0
        for _ in range(1000):
            h = np.unique(rng.integers(0, 1 << 64, common + 2 * each, dtype=np.uint64))
            rng.shuffle(h)
            found += bool((neardup.keys(h[: common + each]) == neardup.keys(np.concatenate((h[:common], h[common + each :])))).any())
        assert found >= least * 1000
