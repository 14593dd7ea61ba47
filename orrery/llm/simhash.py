"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is a ring of three segments.  If two fingerprints differ in at most two bits,
some start on the ring exists from which every chain of 1, 2, 3 consecutive segments differs
in at most 0, 1, 2 bits: the budget grows in proportion to the chain's length.  Chains of two
segments are found by equality under a mask that leaves out one bit of the second, and the last
check is the full Hamming distance.  Every step groups by a key; no pairs within a group are
made.  Keys shared by two fingerprints give one pair to check; fingerprints under a key shared
by more are linked through the words one bit away from them, which two fingerprints share
exactly if they differ in at most two bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected
from .rows import pick
from .scratch import Scratch
from .text import shingle_hashes, words_of

#: (first bit, width) of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_DISTANCE = 2
#: Rows of 16 bytes up to which a table of keys is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash; zero without words."""
    hashes = shingle_hashes(words_of(text), shingle, seed)
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        part = np.ascontiguousarray(hashes[at : at + 16384])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _chain_masks() -> list[int]:
    """For each start on the ring and each bit p of the segment after it: the bits of the two
    segments but p.  Equal words under such a mask are a chain of two within its budget."""
    masks = []
    for i, (a, wide) in enumerate(SEGMENTS):
        b, width = SEGMENTS[(i + 1) % 3]
        whole = ((1 << wide) - 1) << a | ((1 << width) - 1) << b
        masks += [whole & ~(1 << p) for p in range(b, b + width)]
    return masks


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) over a table of distinct fingerprints ``fp``: a set of links of at most two bits
    with the same components as all such links."""
    fp = F.col("fp")
    keys = F.posexplode(F.array(*[fp.bitwiseAND(F.lit(_signed(m))) for m in _chain_masks()])).alias("mask", "key")
    chained = distinct.select("fp", keys)
    chains = scratch.save(chained.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "chains")
    pairs = chains.where("n = 2").select("u", "v")
    many = chains.where("n > 2").select("mask", "key")
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    crowded = scratch.save(chained.join(many, ["mask", "key"], "left_semi").select("fp").distinct(), "crowded")
    near = F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << p))) for p in range(64)])
    around = crowded.select("fp", F.explode(near).alias("middle"))
    least = around.groupBy("middle").agg(F.count("*").alias("n"), F.min("fp").alias("v")).where("n > 1").select("middle", "v")
    stars = around.join(least, "middle").select(fp.alias("u"), "v")
    found = pairs.union(stars).where("u <> v")
    return found.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    Texts without words, null texts among them, have fingerprint zero and are linked like any
    other.  Repeated rows get equal rows.  A null doc_id never is the least of a component; a
    component of null ids only has component_id null.  An empty table gives an empty table.
    Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    ids = scratch.save(fingerprints(docs, shingle, seed), "fingerprints")
    least = scratch.save(ids.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    stars = connected(links(least.select("fp"), scratch), scratch)
    rooted = least.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.save(named, "named")
    by_fp = scratch.save(rooted.join(named, "root").select("fp", "component_id"), "components")
    scratch.keep("fingerprints", "components")
    return ids.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
