import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from orrery.llm import lm

from .brute import documents, words


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


class Plain:
    """Context trees with a node object for each context and decision."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        for t in texts:
            for context, symbol in self.symbols(t):
                for node, bit in self.decisions(symbol):
                    for d in range(lm.DEPTH + 1):
                        self.counts[context[lm.DEPTH - d :], node][bit] += 1
        self.children = defaultdict(set)
        for context, node in self.counts:
            if context:
                self.children[context[1:], node].add((context, node))
        self.memo = {}

    @staticmethod
    def symbols(text):
        data = b"\xff" * lm.DEPTH + lower(text) + b"\xff"
        return [(data[i - lm.DEPTH : i], data[i]) for i in range(lm.DEPTH, len(data))]

    @staticmethod
    def decisions(symbol):
        return [((1 << j) | (symbol >> (8 - j)), symbol >> (7 - j) & 1) for j in range(8)]

    def pe(self, at):
        a, b = self.counts.get(at, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, at):
        return sum(self.pw(c) for c in self.children.get(at, ()))

    def pw(self, at):
        if at not in self.memo:
            pe = self.pe(at)
            if len(at[0]) == lm.DEPTH:
                self.memo[at] = pe
            else:
                below = self.below(at)
                self.memo[at] = max(pe, below) + math.log1p(math.exp(-abs(pe - below))) - math.log(2)
        return self.memo[at]

    def score(self, text):
        total = 0.0
        for context, symbol in self.symbols(text):
            for node, bit in self.decisions(symbol):
                p = None
                for d in range(lm.DEPTH, -1, -1):
                    at = context[lm.DEPTH - d :], node
                    n = self.counts.get(at, (0, 0))
                    estimate = (n[bit] + 0.5) / (sum(n) + 1)
                    w = 1.0 if p is None else 1 / (1 + math.exp(min(700.0, self.below(at) - self.pe(at))))
                    p = estimate if p is None else w * estimate + (1 - w) * p
                total += math.log10(p)
        return total


def expected(rows):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    train = [r[1] for r, h in zip(rows, held) if not h]
    counts = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    plain = Plain(train)
    out = []
    for r, h in zip(rows, held):
        tokens = [*words(r[1]), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((r[0], h, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, plain.score(r[1])))
    return out


def rows_of():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice(["ti", "on", "The", "é", "a"]) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 10, 40]))), "en", "s", 1) for i in range(40)]
    return rows + [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "null id", "en", "s", 1), (3, rows[3][1], "en", "s", 1)]


@pytest.mark.parametrize("parts, rows_at_once", [(4, lm.ROWS), (13, 40)])
def test_against_plain_context_trees(spark, monkeypatch, parts, rows_at_once):
    monkeypatch.setattr(lm, "ROWS", rows_at_once)
    rows = rows_of()
    found = lm.score(documents(spark, [(*r, 1) for r in rows], ", score int").repartition(parts)).collect()
    want = sorted(expected(rows), key=str)
    for a, b in zip(sorted((tuple(r) for r in found), key=str), want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_empty_and_nothing_to_learn_from(spark):
    assert lm.score(documents(spark, [])).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm.score(documents(spark, [(only, "ab", "en", "s", 2)])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 2, 0, 0)
    assert row.base_score == pytest.approx(0.0) and row.score == pytest.approx(3 * 8 * math.log10(0.5))


def test_large_counts():
    import numpy as np

    a, b = np.array([0.0, 5.0, 70000.0, 3e9]), np.array([0.0, 90000.0, 2.0, 4e8])
    exact = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b)]
    assert np.allclose(lm._kt(a, b), exact, rtol=1e-9)


def test_a_very_long_text_and_words_of_held_out_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1001, "ab " * 700_000, "en", "s", 1), (1002, "new words", "en", "s", 1), (held, "unheard ab", "en", "s", 1)]
    found = {r.doc_id: r for r in lm.score(documents(spark, rows)).collect()}
    assert found[1001].n_tokens == 700_001 and 0 > found[1001].score > -60_000
    assert (found[held].n_tokens, found[held].n_known) == (3, 2)


def test_documents_are_dealt_once_and_no_model_reaches_the_driver(spark, monkeypatch):
    """Documents meet the answers where they were written, without an exchange."""
    plans = []
    real = lm.Scratch.save

    def save(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(self, df, name)

    monkeypatch.setattr(lm.Scratch, "save", save)
    monkeypatch.setattr("pyspark.sql.DataFrame.toArrow", None)
    monkeypatch.setattr("pyspark.sql.DataFrame.collect", None)
    lm.score(documents(spark, [(i, f"text {i}", "en", "s", 1) for i in range(50)]).repartition(3))
    plan = dict(plans)["scores"]
    left = plan[plan.index("CoGroup") : plan.index("SortMergeJoin") if "SortMergeJoin" in plan else plan.index("HashJoin")]
    assert left.count("Exchange hashpartitioning(chunk") == 1  # the answers'


def test_every_chunk_has_a_label_and_buckets_are_even(spark):
    for chunks, buckets in ((1, 1), (12, 12), (1000, 16), (7, 3)):
        found = lm._labels(spark, chunks, buckets).selectExpr("number", "chunk", f"pmod(hash(chunk), {buckets}) bucket").collect()
        assert sorted(r.number for r in found) == list(range(chunks)) and len({r.chunk for r in found}) == chunks
        assert all(r.bucket == r.number % buckets for r in found)
