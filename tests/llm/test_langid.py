import random
import zlib

from orrery.llm import langid

from .brute import documents

SYLLABLES = {"aa": ["tion", "the", "ing", "and", "er"], "bb": ["ung", "sch", "der", "für", "ei"], "cc": ["eau", "que", "les", "è", "ment"]}


def rows_of(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([6, 60, 400])))
        rows.append((i, text.capitalize() + ".", lang, "s", len(text)))
    return rows


def test_held_out_accuracy(spark):
    rows = rows_of(300)
    odd = [(900, None, "aa", "s", None), (901, "", "aa", "s", 0), (902, "12 + 3 | 4", "bb", "s", 1), (None, "the and", None, "s", 1), (903, "ß" * 3_000_000, "bb", "s", 1), (904, "日本語", None, "s", 3), (904, "日本語", None, "s", 3)]
    found = langid.identify(documents(spark, [(*r, 1.0) for r in rows + odd], ", score double")).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r.doc_id: r for r in found}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    out = [r for r in rows if by[r[0]].held_out]
    assert sum(by[r[0]].lang_pred == r[2] for r in out) >= 0.97 * len(out) > 30
    assert [(by[i].lang_pred, by[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[903].lang_pred in SYLLABLES and by[904].lang_pred in SYLLABLES


def test_labels_and_ids_are_not_inputs(spark):
    rows = rows_of(120)
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(documents(spark, rows)).collect()}
    hidden = [(i, t, lang if not (zlib.crc32(str(i).encode()) % 4 == 2) else None, "other", 0) for i, t, lang, *_ in rows]
    assert told == {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(documents(spark, hidden)).collect()}


def test_nothing_to_learn_from(spark):
    assert langid.identify(documents(spark, [])).collect() == []
    assert [(r.lang_pred, r.score) for r in langid.identify(documents(spark, [(1, "the", None, None, None)])).collect()] == [("und", 0.0)]
    assert langid.keep_identified(documents(spark, [(1, "the", None, None, None)])).collect() == []


def test_kept_rows_have_all_columns(spark):
    rows = rows_of(120) + [(900, "123", "aa", "s", 3), (901, None, None, None, None)]
    docs = documents(spark, [(*r, 7) for r in rows], ", rank int")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {900, 901} & {r.doc_id for r in kept.collect()} == set() and kept.count() >= 115


def test_every_language_and_letter_is_learned(spark):
    """More languages than once fitted, four of them rare, and scripts of very many letters."""
    rng, rows = random.Random(5), []

    def text(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(40))

    alphabets = {f"l{n:03}": [chr(0x61 + rng.randrange(26)) + chr(0x61 + rng.randrange(26)) for _ in range(12)] for n in range(100)}
    alphabets |= {f"rare{n}": [chr(0x400 + 48 + rng.randrange(32)) + chr(0x400 + 48 + rng.randrange(32)) for _ in range(12)] for n in range(4)}
    ideographs = {f"han{n}": [chr(0x4E00 + 400 * n + i) for i in range(400)] for n in range(4)}
    for name, letters in (alphabets | ideographs).items():
        for _ in range(12 if name.startswith("rare") else 30):
            rows.append((len(rows), text(letters), name, "s", 1))
    found = {r.doc_id: r for r in langid.identify(documents(spark, rows)).collect()}
    for kind in ("l", "rare", "han"):
        out = [found[r[0]].lang_pred == r[2] for r in rows if found[r[0]].held_out and r[2].startswith(kind)]
        assert sum(out) >= 0.95 * len(out) > 5, (kind, sum(out), len(out))


def test_against_plain_kernel_regression():
    """The model's values against kernels of sets, worked out one by one."""
    import unicodedata

    import numpy as np

    rng = random.Random(3)
    letters = langid._letters()
    rows = [(t, g) for _, t, g, *_ in rows_of(60, 9)] + [("日本 " * 3 + "漢字かな", "ja"), ("日本語の文 漢字", "ja"), ("한국어 말", "ko")]
    ranks = [sum(x[1] == g for x in rows[:i]) + 1 for i, (_, g) in enumerate(rows)]
    packed = [langid._distinct_ngrams(letters, t) for t, _ in rows]

    def grams(text):
        s = "".join(c.lower() if unicodedata.category(c)[0] == "L" else " " for c in text)
        while "  " in s:
            s = s.replace("  ", " ")
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    old = langid.LANDMARKS, langid.OF_EACH
    langid.LANDMARKS, langid.OF_EACH = 12, 3
    try:
        models = [langid.fit([g for _, g in rows], ranks, packed, letters, m) for m in (langid.MULTIPLIED, 0)]
    finally:
        langid.LANDMARKS, langid.OF_EACH = old
    assert models[0].weights is not None and models[1].weights is None
    chosen = sorted(sorted(range(len(rows)), key=lambda i: (ranks[i], rows[i][1]))[:15])
    vocabulary = set().union(*(grams(rows[i][0]) for i in chosen))
    sets = [grams(t) & vocabulary for t, _ in rows]
    k = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    kxz = np.array([[k(a, sets[i]) for i in chosen] for a in sets])
    values, vectors = np.linalg.eigh(kxz[chosen])
    half = vectors * (1 / np.sqrt(np.maximum(values, 1e-6 * values.max()))) @ vectors.T
    phi = kxz @ half
    names = sorted({g for _, g in rows})
    y = np.array([[1.0 if g == n else -1.0 for n in names] for _, g in rows])
    coef = half @ np.linalg.solve(phi.T @ phi + langid.RIDGE * np.eye(len(half)), phi.T @ y)
    for text in [rng.choice(rows)[0] for _ in range(10)] + ["der eau 日本 xyz", "Ünïcode ß 漢"]:
        want = np.array([k(grams(text) & vocabulary, sets[i]) for i in chosen]) @ coef
        for model in models:
            assert np.allclose(model.margins(model.presence(text)[None, :])[0], want, atol=2e-4)
