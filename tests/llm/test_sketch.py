import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from orrery.llm import sketch

from .brute import documents

LIMIT = -(1 << 63) + (1 << 64) // sketch.ONE_IN


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]
    found = set()
    for i in range(max(1, len(words) - 4)) if words else ():
        h = 42
        for x in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        found.add(signed(h))
    return sorted(x for x in found if x < LIMIT)


def share(a, b):
    n = min(len(a), len(b))
    return len(set(a) & set(b)) / n if n else float(len(a) == len(b))


def expected(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    places = sorted({key(r) for r in rows})
    text_of = {}
    for r in rows:
        t = r[1] or ""
        h = signed(xxhash.xxh64_intdigest(t.encode(), 42))
        text_of.setdefault(key(r), []).append((h, t))
    out = []
    for r in rows:
        t = r[1] or ""
        following = min(text_of[places[(places.index(key(r)) + 1) % len(places)]])[1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, e = plain(t), plain(edited)
        hexed = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in s)
        out.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(e), share(a, e), share(a, plain(following))))
    return sorted(out, key=str)


def test_against_plain_version(spark):
    rng = random.Random(4)
    rows = [(i * 3, " ".join(f"Wörd{rng.randrange(500)}𝄞" for _ in range(rng.choice([1, 4, 5, 30, 700]))) + rng.choice(["", "\n\t"]), "en", "s", 1) for i in range(60)]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, " \n", "en", "s", 2), (None, "x y", "en", "s", 1), (6, rows[2][1], "en", "s", 1), (903, "v " * 300000, "en", "s", 1), (904, rows[4][1], "en", "s", 1), (9, "another text", "en", "s", 1)]
    found = sketch.fingerprints(documents(spark, [(*r, 1, "h") for r in rows], ", id int, h string")).collect()
    for a, b in zip(sorted((tuple(r) for r in found), key=str), expected(rows), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_one_row_and_empty(spark):
    assert sketch.fingerprints(documents(spark, [])).collect() == []
    row = sketch.fingerprints(documents(spark, [(1, "a b c d e f", "en", "s", 1)])).first()
    assert row.near_next == 1.0


def test_sketches_merge(spark):
    a, b = " ".join(map(str, range(400))), " ".join(map(str, range(300, 900)))
    df = spark.createDataFrame([(a, b, a, b)], "a string, b string, x string, y string")
    df = sketch.with_sketch(sketch.with_sketch(df, "a", "sa"), "b", "sb")
    from pyspark.sql import functions as F

    got = df.select(sketch.merged(F.col("sa"), F.col("sb")).alias("m")).first().m
    assert got == sorted(set(plain(a)) | set(plain(b)))


def test_native_plan(spark, capsys):
    sketch.fingerprints(documents(spark, [(1, "a b", "en", "s", 1)])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_error_against_exact_containment(spark):
    """Likeness against the exact containment of five-word shingles, short texts in long ones too."""
    rng, rows, exact = random.Random(8), [], {}
    for i in range(300):
        long = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 400, 4000]))]
        n = rng.choice([10, 20, 40, 200])
        part = long[: n // 2] + [f"x{rng.randrange(10**6)}" for _ in range(n - n // 2)] if i % 3 == 0 else long[5 : 5 + n] if i % 3 == 1 else [f"y{rng.randrange(10**6)}" for _ in range(n)]
        rows.append((i, " ".join(long), " ".join(part)))
        grams = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in (long, part)]
        exact[i] = (len(grams[0] & grams[1]) / min(map(len, grams)), min(map(len, grams)))
    df = spark.createDataFrame(rows, "id long, a string, b string")
    found = sketch.with_sketch(sketch.with_sketch(df, "a", "x"), "b", "y").select("id", sketch.containment(F.col("x"), F.col("y")).alias("c"), F.size("y").alias("n")).collect()
    for least, most_error in ((1, 0.2), (30, 0.1), (150, 0.06)):
        off = [abs(r["c"] - exact[r["id"]][0]) for r in found if exact[r["id"]][1] >= least]
        assert sum(off) / len(off) <= most_error, (least, sum(off) / len(off))
    assert all(r["c"] == 0 for r in found if exact[r["id"]][0] == 0)
    assert all(r["c"] == 1 for r in found if exact[r["id"]][0] == 1 and r["n"])
