"""Language-model scores by context-tree weighting over bytes, beside a unigram base score.

A symbol is a byte of the text with A-Z in lower case, and one end after the last; contexts
reach ``DEPTH`` bytes back, the text's start being filled with a byte that UTF-8 never has.
Each byte is coded as eight binary decisions; a decision's node (the bits before it) has a
context tree of its own, whose nodes are the contexts of 0 to ``DEPTH`` bytes with counts n0, n1
of the learning texts.  With Krichevsky-Trofimov probability Pe of a node's counts,
    Pw = Pe at full depth,  Pw = (Pe + product of the children's Pw) / 2 above,
and the probability of a bit mixes the estimates (n_bit + 1/2) / (n0 + n1 + 1) of all depths: at
each depth the weight of stopping is Pe / (Pe + product of the children's Pw), as the counts
leave it.  -score / bytes is the code length a byte.

Counts of (context, byte) are summed from every document; held-out documents add their keys with
count 0, so every probability that scoring needs is worked out once for each distinct key.  Three
bytes of context part the keys: depths 3 and more are worked out for whole triples at a time, at
most 2^24 keys each, and the depths above from sums over them.

The model stays on the executors.  Documents are written in chunks of about ``CHUNK`` bytes, and
a chunk asks for its distinct keys once; what they are worth comes back by a join on the key and
meets the chunk's documents, which are not dealt again.  So a task holds one chunk with its keys,
whatever the number of keys of the corpus, and the corpus is read once for counts and once for
scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil, log10, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .rows import pick
from .scratch import Scratch
from .vectors import _LOWER, Table, word_hashes

DEPTH = 5
#: Bytes of a chunk of documents as the table holds them, more or less.
CHUNK = 32 << 20
#: Buckets that chunks are dealt to, at most; a task reads a bucket, one chunk after the other.
BUCKETS = 8192
#: Keys after which a task merges what it has counted.
MERGE = 2_000_000
#: Rows of whole triples that are worked out at once.
ROWS = 500_000
#: Mark of the keys of words beside those of contexts.
_WORD = np.uint64(1 << 63)
_EDGE = 0xFF
_LN10 = np.log(10.0)
_TERMS = np.arange(0, 1 << 16, dtype=np.float64)
_LOG_HALF = np.concatenate(([0.0], np.cumsum(np.log(_TERMS + 0.5))))  # ln of 1/2 * 3/2 * ... (n factors)
_LOG_FACT = np.concatenate(([0.0], np.cumsum(np.log(_TERMS + 1.0))))


def keys_of(text: str | None) -> np.ndarray:
    """Of each byte of the text and its end: the bytes before it, last first, then itself."""
    whole = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    padded = np.concatenate((np.full(DEPTH, _EDGE, np.uint8), whole, np.array([_EDGE], np.uint8))).astype(np.uint64)
    n, key = len(whole) + 1, np.zeros(len(whole) + 1, np.uint64)
    for back in range(1, DEPTH + 1):
        key = key << np.uint64(8) | padded[DEPTH - back : DEPTH - back + n]
    return key << np.uint64(8) | padded[DEPTH : DEPTH + n]


class _Counter:
    """Distinct keys with the number of their learning occurrences."""

    def __init__(self):
        self.parts, self.raw, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: bool) -> None:
        self.raw.append((keys, counts))
        self.size += len(keys)
        if self.size >= MERGE:
            self.fold()

    def fold(self) -> None:
        for flag in (True, False):
            if own := [k for k, f in self.raw if f is flag]:
                keys, n = np.unique(np.concatenate(own), return_counts=True)
                self.parts.append((keys, n if flag else np.zeros(len(keys), np.int64)))
        self.raw, self.size = [], 0
        if sum(len(k) for k, _ in self.parts) >= MERGE:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys = np.concatenate([k for k, _ in self.parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([n for _, n in self.parts])[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.parts = [(keys[first], np.add.reduceat(n, first))]

    def flush(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.fold()
        self.merge()
        yield from self.parts
        self.parts = []


def _word_keys(text: str | None) -> np.ndarray:
    return word_hashes(text) | _WORD


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (chunk, held_out, text) to the distinct keys of each chunk (chunk, key, n); n counts
    learning occurrences."""

    def flush(chunk: int | None, counter: _Counter) -> Iterator[pa.RecordBatch]:
        for keys, n in counter.flush():
            for at in range(0, len(keys), 200_000):
                part = keys[at : at + 200_000]
                yield pa.record_batch([pa.array(np.full(len(part), chunk, np.int32)), pa.array(part.view(np.int64)), pa.array(n[at : at + 200_000].astype(np.int64))], names=["chunk", "key", "n"])

    now, counter = None, _Counter()
    for batch in batches:
        for chunk, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if chunk != now:
                yield from flush(now, counter)
                now = chunk
            text = text.as_py()
            counter.add(keys_of(text), not held_out)
            counter.add(_word_keys(text), not held_out)
    yield from flush(now, counter)


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""

    def of(table: np.ndarray, shift: float, n: np.ndarray) -> np.ndarray:
        out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
        if (big := n >= len(table)).any():  # Stirling's series of ln Gamma(n + shift)
            x = n[big] + shift
            ln_gamma = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * pi) + 1 / (12 * x) - 1 / (360 * x**3)
            out[big] = ln_gamma - (0.5 * np.log(pi) if shift == 0.5 else 0)
        return out

    return of(_LOG_HALF, 0.5, n0) + of(_LOG_HALF, 0.5, n1) - of(_LOG_FACT, 1.0, n0 + n1)


def _stop_weight(log_pe: np.ndarray, log_children: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(log_children - log_pe, -700, 700)))


def _weighted(log_pe: np.ndarray, log_children: np.ndarray) -> np.ndarray:
    return np.logaddexp(log_pe, log_children) - np.log(2)


def _bits(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 8) nodes and bits of the decisions that code each byte."""
    s = symbols.astype(np.int64)[:, None]
    j = np.arange(8)[None, :]
    return (1 << j) | (s >> (8 - j)), (s >> (7 - j)) & 1


def _deep(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """For all keys of whole triples: (key, 8) probabilities of the bits as the depths from 3 on
    mix them, and of each (triple, node) its place, n0, n1 and ln Pw."""
    node, bit = _bits(key & 0xFF)
    node, bit, counts = node.ravel(), bit.ravel(), np.repeat(n.astype(np.float64), 8)
    stack, log_pw, above = [], None, None
    for depth in range(DEPTH, 2, -1):
        place = np.repeat(key >> (8 * (DEPTH - depth + 1)), 8) << 8 | node
        ids, inverse = np.unique(place, return_inverse=True)
        n1 = np.bincount(inverse, counts * bit, len(ids))
        n0 = np.bincount(inverse, counts, len(ids)) - n1
        log_pe = _kt(n0, n1)
        if log_pw is None:
            weight, log_pw = np.ones(len(ids)), log_pe
        else:  # ids of the level below, seen from here: without the farthest byte
            parent = np.searchsorted(ids, (above >> 16) << 8 | above & 0xFF)
            children = np.bincount(parent, log_pw, len(ids))
            weight, log_pw = _stop_weight(log_pe, children), _weighted(log_pe, children)
        above = ids
        n_bit = np.where(bit == 1, n1[inverse], n0[inverse])
        stack.append((weight[inverse], (n_bit + 0.5) / ((n0 + n1)[inverse] + 1)))
    p = stack[0][1]
    for weight, estimate in stack[1:]:
        p = weight * estimate + (1 - weight) * p
    return p.reshape(-1, 8), ids, n0, n1, log_pw


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of their first column, whole groups of it at a time, ``ROWS`` or more."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        at = int(np.searchsorted(group, group[-1]))
        if at and size + at >= ROWS:
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held, size, batch = [], 0, batch.slice(at)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _depth3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole(batches):
        _, ids, n0, n1, log_pw = _deep(rows.column("key").to_numpy(), rows.column("n").to_numpy())
        yield pa.record_batch([pa.array((ids >> 8).astype(np.int32)), pa.array((ids & 0xFF).astype(np.int16)), pa.array(n0), pa.array(n1), pa.array(log_pw)], names=["place", "node", "n0", "n1", "pw"])


def _mixed_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, node, n0, n1, below) to the weight of stopping and ln Pw there."""
    for batch in batches:
        n0, n1, below = (batch.column(i).to_numpy() for i in (2, 3, 4))
        log_pe = _kt(n0, n1)
        yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(_stop_weight(log_pe, below)), pa.array(_weighted(log_pe, below))], names=["place", "node", "n0", "n1", "w", "pw"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole triples, for each its nodes with what the depths above add, then its keys, to (key, value)."""
    for rows in _whole(batches):
        triple, is_key = rows.column("triple").to_numpy(), rows.column("is_key").to_numpy(zero_copy_only=False)
        key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
        head, own = ~is_key, key[is_key]
        heads = triple[head].astype(np.int64) << 8 | key[head]
        zero, one, factor = (rows.column(c).to_numpy()[head] for c in ("zero", "one", "factor"))
        order = np.argsort(heads)
        deeper = _deep(own, n[is_key])[0]
        node, bit = _bits(own & 0xFF)
        at = order[np.searchsorted(heads, (own >> 24)[:, None] << 8 | node, sorter=order)]
        p = np.where(bit == 1, one[at], zero[at]) + factor[at] * deeper
        yield pa.record_batch([pa.array(own), pa.array(np.log10(p).sum(axis=1))], names=["key", "value"])


def model(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, value) of each (key, n): log10 of its byte's probability after its context."""
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.withColumn("triple", F.shiftright("key", 8 * (DEPTH - 2)).cast("int"))
    by_triple = keys.select("triple", "key", "n").repartition(parts, "triple").sortWithinPartitions("triple")
    schema = "place int, node short, n0 double, n1 double"
    deep = scratch.save(by_triple.mapInArrow(_depth3, f"{schema}, pw double"), "depth3")

    def above(below: DataFrame, name: str) -> DataFrame:
        sums = below.groupBy(F.shiftright("place", 8).alias("place"), "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1")], F.sum("pw").alias("below"))
        return scratch.save(sums.mapInArrow(_mixed_levels, f"{schema}, w double, pw double"), name)

    two = above(deep, "depth2")
    one = above(two, "depth1")  # at most 2^16 rows
    root = above(one, "depth0")  # at most 2^8 rows
    a, b, c = two.alias("a"), F.broadcast(one).alias("b"), F.broadcast(root).alias("c")
    levels = a.join(b, (F.shiftright("a.place", 8) == F.col("b.place")) & (F.col("a.node") == F.col("b.node"))).join(c, F.col("b.node") == F.col("c.node"))
    estimate = lambda t, bit: (F.col(f"{t}.n{bit}") + 0.5) / (F.col(f"{t}.n0") + F.col(f"{t}.n1") + 1)
    go = lambda t: 1 - F.col(f"{t}.w")
    adds = [F.col("c.w") * estimate("c", i) + go("c") * (F.col("b.w") * estimate("b", i) + go("b") * F.col("a.w") * estimate("a", i)) for i in (0, 1)]
    levels = levels.select("a.place", "a.node", adds[0].alias("zero"), adds[1].alias("one"), (go("c") * go("b") * go("a")).alias("factor"))
    levels = scratch.save(levels, "levels")
    heads = deep.select(F.col("place").alias("triple"), "node", F.shiftright("place", 8).alias("place")).join(levels, ["place", "node"])
    nothing = F.lit(0.0)
    both = heads.select("triple", F.lit(False).alias("is_key"), F.col("node").cast("long").alias("key"), F.lit(0).cast("long").alias("n"), "zero", "one", "factor").union(
        keys.select("triple", F.lit(True), "key", "n", nothing, nothing, nothing)
    )
    ordered = both.repartition(parts, "triple").sortWithinPartitions("triple", "is_key")
    return ordered.mapInArrow(_scored, "key long, value double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 10, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _chunk_scores(denominator: float):
    """The documents of a chunk and the values of its keys to their scores."""

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        keys, worth = values.column("key").to_numpy().view(np.uint64), values.column("value").to_numpy()
        is_word = keys >= _WORD
        grams, words = Table(keys[~is_word], worth[~is_word]), Table(keys[is_word], worth[is_word])
        logs = np.log10((words.values + 0.1) / denominator)
        rows = []
        for text in docs.column("text"):
            text, score = text.as_py(), 0.0
            own = keys_of(text)
            for at in range(0, len(own), 1 << 18):
                score += float(grams.values[grams.find(own[at : at + (1 << 18)])].sum())
            found = words.find(_word_keys(text))
            known = found[words.values[found] > 0]
            rows.append((len(found), len(known), float(logs[known].sum()), score))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
        return pa.Table.from_arrays([docs.column("doc_id"), docs.column("held_out"), *columns], names=["doc_id", "held_out", "words", "known", "base", "score"])

    return run


def _labels(spark: SparkSession, chunks: int, buckets: int) -> DataFrame:
    """(number, chunk): for each number of a chunk an integer that Spark deals to bucket
    ``number`` modulo ``buckets``, so that buckets hold as many chunks each.  A row of 8 bytes
    for each ``CHUNK`` of documents: this is what is broadcast."""
    each = ceil(chunks / buckets)
    tries = spark.range(int(buckets * (each + 4 * sqrt(each) + 20))).select(F.col("id").cast("int").alias("chunk"))
    tries = tries.withColumn("bucket", F.pmod(F.hash("chunk"), F.lit(buckets)))
    nth = F.row_number().over(W.partitionBy("bucket").orderBy("chunk")) - 1
    return tries.withColumn("number", F.col("bucket") + nth * buckets).where(F.col("number") < chunks).select("number", "chunk")


def score(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row per row of ``docs``.

    Whole texts, A-Z in lower case; a null text is an empty one and has the end only.  Learns
    from the rows that aren't held out; a row of null id is learned from.  Repeated rows are
    learned from as often as they occur and get equal scores.  With nothing to learn from, each
    bit has probability 1/2 and the base score is that of the formula with N = V = 0.  An empty
    table gives an empty table.  Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a table whose size Spark can't tell has a chunk for each partition of a shuffle
    chunks = max(spark.sparkContext.defaultParallelism, ceil(size / chunk) if size < 1 << 55 else parts)
    rows = pick(docs, doc_id="long", text="string")
    # a chunk is what some of the tasks read; writing the documents with it fixes it
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", F.pmod(F.spark_partition_id(), F.lit(chunks)).cast("int").alias("number"))
    buckets = min(chunks, BUCKETS)
    rows = rows.join(F.broadcast(_labels(spark, chunks, buckets)), "number").drop("number")
    name = f"orrery_lm_{uuid.uuid4().hex}"
    rows.write.option("path", scratch.path("docs")).option("compression", "snappy").bucketBy(buckets, "chunk").saveAsTable(name)
    scratch.saved.add("docs")
    try:
        dealt = spark.table(name)
        counted = dealt.select("chunk", "held_out", "text").mapInArrow(_count, "chunk int, key long, n long")
        asked = scratch.save(counted.repartition(parts, "key").groupBy("key", "chunk").agg(F.sum("n").alias("n")), "asked")
        counts = scratch.save(asked.groupBy("key").agg(F.sum("n").alias("n")), "counts")
        ends = dealt.where(~F.col("held_out")).count()
        total = counts.where("key < 0 and n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).first()
        n, v = (total["n"] or 0) + ends, total["distinct"] + (ends > 0)
        denominator = n + 0.1 * (v + 1)
        values = model(counts.where("key >= 0"), scratch).union(counts.where("key < 0").select("key", F.col("n").cast("double")))
        values = scratch.save(values, "values")
        answers = asked.select("key", "chunk").join(values, "key")
        schema = "doc_id long, held_out boolean, words long, known long, base double, score double"
        found = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_chunk_scores(denominator), schema)
        found = scratch.save(found, "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    scratch.keep("scores")
    of_end, of_new = log10((ends + 0.1) / denominator), log10(0.1 / denominator)
    return found.select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + (1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + (F.col("words") - F.col("known")) * F.lit(of_new) + F.lit(of_end)).alias("base_score"),
        "score",
    )
