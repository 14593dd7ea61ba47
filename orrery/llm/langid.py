"""Language ID by a string kernel: blended-spectrum n-gram presence, Nyström landmarks and
one-versus-rest kernel ridge regression.

k(x, z) = |G(x) & G(z)| / sqrt(|G(x)| |G(z)|), G the distinct n-grams of 1 to ``MAX_N`` symbols
that the landmarks have.  A symbol is a letter in lower case, whichever the script, or one gap
for a run of anything else.  With landmarks Z the Nyström features are k(x, Z) K_ZZ^(-1/2) and
ridge regression on them gives coefficients b per language, so a score is k(x, Z) b.  As the
kernel is an inner product of presence vectors, Z' b is multiplied out once and documents are
scored in batches by presence matrix x (n-grams x languages); if that matrix would have more
than ``MULTIPLIED`` entries, by presence x Z' x b, which is the same.

Every language with a labelled row is learned.  The learning sample is bounded: at most
``PER_LANGUAGE`` rows of a language and about ``SAMPLE`` rows in all, at least one of each
language.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .rows import pick, place, plain
from .vectors import Table

MAX_N = 3
#: Bounds of the learning sample: rows of each language, rows in all.
PER_LANGUAGE, SAMPLE = 300, 10_000
#: Landmarks: so many, or so many of each language if that is more, but not over ``MOST`` unless
#: there are more languages than that, each of which has one.
LANDMARKS, OF_EACH, MOST = 256, 6, 2048
RIDGE = 1e-2
UNKNOWN = "und"
PIECE = 1 << 20
MULTIPLIED = 1 << 25
#: Symbols, the most frequent ones, whose n-grams are looked up in a plain array.
DENSE = 128


def _letters() -> np.ndarray:
    """Code point to its lower-case letter, 0 if it is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _joined(symbols: np.ndarray) -> np.ndarray:
    """One gap for each run of gaps."""
    gap = symbols == 0
    return symbols[~(gap & np.concatenate(([False], gap[:-1])))]


def _distinct_ngrams(letters: np.ndarray, text: str) -> np.ndarray:
    """Distinct n-grams of the whole text: 20 bits a letter, n above them."""
    s, found = _joined(letters[_codes(text)]).astype(np.int64) & (1 << 20) - 1, []
    for n in range(1, MAX_N + 1):
        if len(s) >= n:
            packed = np.zeros(len(s) - n + 1, np.int64)
            for i in range(n):
                packed = packed << 20 | s[i : len(s) - n + 1 + i]
            found.append(np.unique(packed) | n << 60)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray  # of a code point: 0 a gap, 1 a letter that the sample doesn't have
    places: np.ndarray  # of an n-gram of dense symbols among the known ones, their number if unknown
    others: Table  # the other known n-grams' packed symbols
    landmarks: tuple[np.ndarray, np.ndarray]  # of each known n-gram: end of its part of the second array, of landmarks that have it
    b: np.ndarray  # landmarks x languages, scaled by the landmarks' sizes
    weights: np.ndarray | None  # n-grams x languages

    @property
    def size(self) -> int:
        return len(self.landmarks[0])

    def presence(self, text: str) -> np.ndarray | None:
        """Whether each known n-gram occurs; None if the text has no letter."""
        codes, seen = _codes(text), np.zeros(self.size + 1, bool)
        any_letter, tail = False, np.zeros(0, np.uint32)
        for at in range(0, len(codes), PIECE):
            piece = self.symbols[codes[at : at + PIECE]]
            any_letter = any_letter or bool(piece.any())
            s = _joined(np.concatenate((tail, piece))).astype(np.int64)
            tail, start, width = s[-(MAX_N - 1) :].astype(np.uint32), 0, 1
            small = s < DENSE
            all_small = bool(small.all())
            for n in range(1, MAX_N + 1):
                if len(s) < n:
                    break
                parts = [s[i : len(s) - n + 1 + i] for i in range(n)]
                rare = None
                if not all_small:
                    dense = np.logical_and.reduce([small[i : len(s) - n + 1 + i] for i in range(n)])
                    rare = [p[~dense] for p in parts]
                    parts = [p[dense] for p in parts]
                index = parts[0]
                for p in parts[1:]:
                    index = index * DENSE + p
                width *= DENSE
                seen[self.places[start + index]] = True
                start += width
                if rare is not None and len(rare[0]):
                    found = self.others.find(_packed(rare).view(np.uint64))
                    seen[self.others.values[found[found >= 0]]] = True
        return seen[:-1] if any_letter else None

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Regression values of presence vectors."""
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        if self.weights is not None:
            return (x.astype(np.float32) @ self.weights) / norm
        ends, who = self.landmarks
        common = np.zeros((len(x), len(self.b)))
        for i, row in enumerate(x):
            grams = np.flatnonzero(row)
            counts = np.diff(ends, prepend=0)[grams]
            at = np.repeat(ends[grams] - np.cumsum(counts), counts) + np.arange(counts.sum())
            common[i] = np.bincount(who[at], minlength=len(self.b))
        return (common @ self.b) / norm

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        batch = max(1, min(64, (1 << 24) // max(1, self.size)))
        for at in range(0, len(texts), batch):
            found = [(i, p) for i in range(at, min(at + batch, len(texts))) if texts[i] and (p := self.presence(texts[i])) is not None]
            if not found:
                continue
            for (i, _), m in zip(found, self.margins(np.stack([p for _, p in found])), strict=True):
                best = int(m.argmax())
                names[i], scores[i] = self.languages[best], min(1.0, max(0.0, (float(m[best]) + 1) / 2))
        return names, scores


def _packed(parts: list[np.ndarray]) -> np.ndarray:
    """Symbols of n-grams as one number: 20 bits each, n above them."""
    out = parts[0].astype(np.int64)
    for p in parts[1:]:
        out = out << 20 | p
    return out | len(parts) << 60


def _gram_matrix(rows: list[np.ndarray], size: int, others: list[np.ndarray]) -> np.ndarray:
    """Numbers of common n-grams of each of ``rows`` and each of ``others``, ascending places below ``size``."""
    out = np.zeros((len(rows), len(others)))
    for low in range(0, size, 1 << 14):
        high = min(size, low + (1 << 14))

        def block(of: list[np.ndarray]) -> np.ndarray:
            x = np.zeros((len(of), high - low), np.float32)
            for i, r in enumerate(of):
                x[i, r[np.searchsorted(r, low) : np.searchsorted(r, high)] - low] = 1
            return x

        z = block(others).T
        for at in range(0, len(rows), 1024):
            out[at : at + 1024] += block(rows[at : at + 1024]) @ z
    return out


def fit(languages: list[str], ranks: list[int], ngrams: list[np.ndarray], letters: np.ndarray, multiplied: int = MULTIPLIED) -> Model | None:
    """The model of a sample: each row's language, its place in its language's sample and its
    distinct n-grams, packed letters."""
    if not languages:
        return None
    names = sorted(set(languages))
    letter = (1 << 20) - 1
    alphabet, often = np.unique(np.concatenate([g[g >> 60 == 1] & letter for g in ngrams]), return_counts=True)
    known = alphabet[np.lexsort((alphabet, -often))]
    known = known[known > 0]
    index = np.ones(1 << 20, np.uint32)
    index[0] = 0
    index[known] = np.arange(2, len(known) + 2)
    symbols = np.where(letters > 0, index[letters & letter], 0).astype(np.uint32)

    count = max(LANDMARKS, min(OF_EACH * len(names), MOST), len(names))
    chosen = sorted(sorted(range(len(languages)), key=lambda i: (ranks[i], languages[i]))[:count])
    features = np.unique(np.concatenate([ngrams[i] for i in chosen]))
    rows = []
    for g in ngrams:
        at = np.minimum(np.searchsorted(features, g), len(features) - 1)
        rows.append(np.sort(at[features[at] == g]))
    z = [rows[i] for i in chosen]
    sizes = np.sqrt(np.maximum([len(r) for r in rows], 1))
    k = _gram_matrix(rows, len(features), z) / sizes[:, None] / sizes[chosen][None, :]
    values, vectors = np.linalg.eigh(k[chosen])
    half = vectors * (1 / np.sqrt(np.maximum(values, 1e-6 * values.max()))) @ vectors.T
    phi = k @ half
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    b = half @ np.linalg.solve(phi.T @ phi + RIDGE * np.eye(len(half)), phi.T @ y)
    b /= sizes[chosen][:, None]

    who = np.repeat(np.arange(len(z)), [len(r) for r in z])
    gram = np.concatenate(z)
    order = np.lexsort((who, gram))
    landmarks = np.cumsum(np.bincount(gram, minlength=len(features))), who[order].astype(np.int32)
    weights = None
    if len(features) * len(names) <= multiplied:
        weights = np.zeros((len(features), len(names)))
        for own, r in zip(b, z, strict=True):
            weights[r] += own
        weights = weights.astype(np.float32)

    places = np.full(sum(DENSE**n for n in range(1, MAX_N + 1)), len(features), np.int32)
    rare_keys, rare_places, start, width = [], [], 0, 1
    for n in range(1, MAX_N + 1):
        at = np.flatnonzero(features >> 60 == n)
        parts = [index[(features[at] >> 20 * i) & letter].astype(np.int64) for i in range(n - 1, -1, -1)]
        dense = np.logical_and.reduce([p < DENSE for p in parts])
        place = np.zeros(len(at), np.int64)
        for p in parts:
            place = place * DENSE + p
        width *= DENSE
        places[start + place[dense]] = at[dense]
        start += width
        rare_keys.append(_packed([p[~dense] for p in parts]))
        rare_places.append(at[~dense])
    others = Table(np.concatenate(rare_keys).view(np.uint64), np.concatenate(rare_places))
    return Model(names, symbols, places, others, landmarks, b, weights)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``per_language`` rows of each language, chosen by hash, fewer where there
    are more than ``sample`` / ``per_language`` languages; only text and lang of rows that aren't
    held out are learned from."""
    rows = pick(docs, doc_id="long", text="string", lang="string")
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / (1 << 40))
    spark = docs.sparkSession
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row of a label
    if not counts:
        return None
    most = max(1, min(per_language, sample // len(counts)))
    share = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, (3 * most + 30) / r["n"])) for r in counts], "lang string, share double"))
    few = rows.join(share, "lang").where(F.col("u") < F.col("share"))
    few = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("u", "doc_id", "text"))).where(F.col("rank") <= most)
    letters = _letters()
    sent = spark.sparkContext.broadcast(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [_distinct_ngrams(sent.value, t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(grams, pa.binary())], names=["lang", "rank", "grams"])

    found = few.select("lang", "text", "rank").mapInArrow(run, "lang string, rank int, grams binary").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    return fit(found.column("lang").to_pylist(), found.column("rank").to_pylist(), [np.frombuffer(g, np.int64) for g in found.column("grams").to_pylist()], letters)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``.

    lang_pred is a learned language, or ``und`` with score 0 if the text is null or has no
    letter, or if there is nothing to learn from.  score is (1 + the best language's regression
    value) / 2 within 0 and 1.  Ties go to the first language by name.  Rows of null id or null
    language are predicted but not learned from.  An empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            names, scores = sent.value.predict(texts) if sent.value else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = pick(docs, doc_id="long", text="string")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = 0.5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified with ``min_score`` or more."""
    sent, at, rows = docs.sparkSession.sparkContext.broadcast(learn(docs, per_language)), place(docs, "text"), plain(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            names, scores = sent.value.predict(texts) if sent.value else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])).toDF(*docs.columns)
