"""Document fingerprints as threshold-scaled sketches, in DataFrame operations only.

A sketch keeps every shingle hash that lies in the lowest ``FRACTION`` of the 64-bit range, so its
size follows the document's, sketches merge by union, and shares of common hashes estimate
containment between documents of very unequal length.  The fraction is the same for every text:
a text of m distinct shingles keeps none with probability (1 - FRACTION)^m, and an estimate of
containment c from a smaller text of m shingles has a standard error of
sqrt(c (1 - c) / (m FRACTION)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .rows import pick
from .scratch import Scratch
from .text import WORD_JAVA

SHINGLE = 5
#: One in so many hashes is kept.
ONE_IN = 4
_THRESHOLD = -(1 << 63) + (1 << 64) // ONE_IN


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the sketch of column ``text`` in place of that column: ascending array<long>."""
    others = [F.col(c) for c in df.columns if c != text]
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD_JAVA), F.lit(0))
    # explode: the arrays become attributes, which the functions below read at no cost
    hashed = df.select(*others, F.explode(F.array(F.transform(words, lambda w: F.xxhash64(w)))).alias("_w"))
    w = F.col("_w")
    runs = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]))
    shingled = hashed.select(*others, F.explode(F.array(F.slice(runs, 1, F.when(F.size(w) == 0, 0).otherwise(F.greatest(F.lit(1), F.size(w) - (SHINGLE - 1)))))).alias("_s"))
    kept = F.filter("_s", lambda h: h < F.lit(_THRESHOLD))
    return shingled.select(*others, F.array_sort(F.array_distinct(kept)).alias(name))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch's hashes that the other has; of two empty sketches 1, of one 0."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def as_text(sketch: Column) -> Column:
    """A sketch as a string, 16 hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _next_of(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(nn, id, most, to_nn, to_id, to_h): each id with the next one in ascending order, null
    first, the last with the first.  ``ids``: distinct (nn, id, most, h)."""
    ordered = ids.repartitionByRange(max(1, ids.sparkSession.sparkContext.defaultParallelism * 2), "nn", "id").sortWithinPartitions("nn", "id")
    ordered = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    ends = ordered.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last")).orderBy("part").collect()  # one row per partition
    if not ends:
        return ordered.select("nn", "id", "most", F.col("nn").alias("to_nn"), F.col("id").alias("to_id"), F.col("h").alias("to_h"))
    after = F.create_map(*[x for i, r in enumerate(ends) for x in (F.lit(r["last"]), F.lit(ends[(i + 1) % len(ends)]["first"]))])
    aimed = ordered.select("nn", "id", "most", F.coalesce(F.try_element_at(after, F.col("at")), F.col("at") + 1).alias("at"))
    return aimed.join(ordered.select("at", F.col("nn").alias("to_nn"), F.col("id").alias("to_id"), F.col("h").alias("to_h")), "at").drop("at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next):
    one row per row of ``docs``.

    The edited text has the last floor(n_chars/2) code points replaced by the first as many, or
    all, of the next document's, in ascending doc_id; after the last comes the first.  A null
    text is empty; a null doc_id comes before all others.  Rows of one doc_id are one place in
    that order: the next document of each is that of the next id, and of several texts under the
    next id the one of the lowest XXH64.  Repeated rows get equal rows.  Texts without words, and
    those of few words of which no hash is kept, have the empty fingerprint.  An empty table gives an empty table.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sketch")
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, doc_id="long", text="string").select(F.col("doc_id").isNotNull().alias("nn"), F.coalesce("doc_id", F.lit(0)).alias("id"), text.alias("text"))
    ids = rows.groupBy("nn", "id").agg(F.max(F.char_length("text")).alias("most"), F.min(F.xxhash64("text")).alias("h"), F.count("*").alias("n"))
    ids = scratch.save(ids, "ids")
    repeated = ids.where("n > 1").limit(1).count() > 0
    chain = scratch.save(_next_of(ids.drop("n"), scratch), "chain")

    # the same exchange of the texts by id serves both joins: it has the same columns for both
    lent = rows.join(chain.select(F.col("nn").alias("of_nn"), F.col("id").alias("of_id"), "most", F.col("to_nn").alias("nn"), F.col("to_id").alias("id"), "to_h"), ["nn", "id"]).where(F.xxhash64("text").bitwiseXOR(F.col("to_h")) == 0)
    head = F.substring("text", F.lit(1), F.floor(F.col("most") / 2).cast("int")).alias("head")
    lent = with_sketch(lent.select(F.col("of_nn").alias("nn"), F.col("of_id").alias("id"), head, "text"), "text", "next")
    if repeated:
        lent = lent.dropDuplicates(["nn", "id"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("head", F.lit(1), half))
    pairs = rows.join(lent, ["nn", "id"]).withColumn("n_chars", F.char_length("text").cast("long")).select("nn", "id", "n_chars", "next", "text", edited.alias("edited"))
    pairs = pairs.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    found = with_sketch(with_sketch(pairs, "text", "own"), "edited", "changed")
    own, changed = F.col("own"), F.col("changed")
    return found.select(
        F.when(F.col("nn"), F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(own).alias("fingerprint"),
        as_text(changed).alias("edited_fingerprint"),
        containment(own, changed).cast("double").alias("near_edited"),
        containment(own, F.col("next")).cast("double").alias("near_next"),
    )
