"""Line dedup: repeated runs of lines by a suffix array over line-ID sequences.

A text is its lines, split at line feeds; a line's ID is the 128-bit XXH3 of its bytes.  Suffixes
of the stretches of repeated lines are ranked by their first 2^k lines, doubling k: a rank at
k+1 is the place of the pair (rank at i, rank at i + 2^k) in a distributed sort of the distinct
pairs.  The doubling ends when it tells no more suffixes apart, or at the length of the longest
window (below), up to which prefixes matter; the last ranks order the suffix array.  The longest common prefix of two neighbours comes from the ranks too: from the deepest
that they share on, each lower depth adds its lines where the ranks behind the common lines are
equal.  Lines that occur once are in no repeated run and end a stretch.

A repeated run counts if it has ``min_words`` words.  Any such run is the union of windows
inside it that just reach that many words, taken from each first line forwards and from each
last line backwards.  The suffixes that share a window of m lines are the LCP interval around
it: the stretch of the array up to the last entry before, and the next after, whose common
prefix with its predecessor is less than m.  In each interval the earliest suffix stays and the
later copies of the m lines are deleted; together these are the later copies of all maximal
repeated runs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .rows import packed, pick, place, unpacked
from .scratch import Scratch

MIN_WORDS = 50


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        ids, words, at = [], [], [0]
        for text in batch.column(2):
            if (text := text.as_py()) is not None:
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                ids += [digest(x) for x in lines]
                words += [len(x.split()) for x in lines]
            at.append(len(ids))
        offsets, halves = pa.array(at, pa.int32()), np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
        yield pa.record_batch(
            [batch.column(0), batch.column(1), *(pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((halves[:, 0].copy(), pa.int64()), (halves[:, 1].copy(), pa.int64()), (words, pa.int32())))],
            names=["doc_id", "h", "ids", "more", "words"],
        )


def windows_of(idx: np.ndarray, words: np.ndarray, min_words: int) -> dict[int, set[int]]:
    """First line to lengths of the windows that just reach ``min_words``, over lines ``idx``
    (ascending) that may be part of a repeated run.  Windows don't span a gap in ``idx``."""
    found: dict[int, set[int]] = {}
    for part in np.split(np.arange(len(idx)), np.flatnonzero(np.diff(idx) != 1) + 1):
        if not len(part):
            continue
        sums = np.concatenate(([0], np.cumsum(words[part])))
        if sums[-1] < min_words:
            continue
        first, n = int(idx[part[0]]), len(part)
        ends = np.searchsorted(sums, sums[:-1] + max(min_words, 1), side="left")
        for s, e in enumerate(ends.tolist()):
            if e <= n:
                found.setdefault(first + s, set()).add(e - s)
        starts = np.searchsorted(sums, sums[1:] - max(min_words, 1), side="right") - 1
        for e, s in enumerate(starts.tolist(), 1):
            if s >= 0:
                found.setdefault(first + s, set()).add(e - s)
    return found


def _positions(min_words: int):
    """Repeated lines of a document to the lines of its stretches that have enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ord_, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines.sort(key=lambda x: x["idx"])
                idx = np.array([x["idx"] for x in lines])
                words = np.array([x["w"] for x in lines])
                starts = windows_of(idx, words, min_words)
                cuts = np.flatnonzero(np.diff(idx) != 1) + 1
                for part in np.split(np.arange(len(idx)), cuts):
                    if words[part].sum() >= min_words:
                        rows += [(ord_, int(idx[i]), lines[i]["id"], lines[i]["more"], len(part) - at, sorted(starts.get(int(idx[i]), ()))) for at, i in enumerate(part.tolist())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())), strict=True)], names=["ord", "idx", "id", "more", "left", "spans"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            mask = np.ones(n, bool)
            for s in spans:
                mask[s["idx"] : s["idx"] + s["m"]] = False
            keep.append(mask.tolist())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keep, pa.list_(pa.bool_()))], names=["doc_id", "h", "keep"])


def _sequences(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(ord, doc_id, h, ids, more, words): documents in the order of (doc_id, h), null first,
    with their lines; rows of equal doc_id and text are one."""
    keyed = pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("h"), "text")
    lines = keyed.mapInArrow(_lines, "doc_id long, h long, ids array<long>, more array<long>, words array<int>").where(F.size("ids") > 0)
    lines = scratch.save(lines.dropDuplicates(["doc_id", "h"]), "unordered")
    lines = scratch.save(
        lines.repartitionByRange(max(1, docs.sparkSession.sparkContext.defaultParallelism * 2), "doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("ord", F.monotonically_increasing_id()), "ordered"
    )
    scratch.drop("unordered")
    return lines


def _places(lines: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(ord, idx, id, more, left, spans): lines that occur twice or more, in stretches of enough
    words, with the number of lines up to the stretch's end and the lengths of the windows that
    start there."""
    each = lines.select("ord", F.posexplode(F.arrays_zip("ids", "more", "words")).alias("idx", "line")).select("ord", "idx", F.col("line.ids").alias("id"), F.col("line.more").alias("more"), F.col("line.words").alias("w"))
    # tables that are joined with what they were summed from are written first: a join of two
    # plain exchanges can be split where one line or interval has very many places
    twice = scratch.save(each.groupBy("id", "more").agg(F.count("*").alias("n")).where("n > 1").select("id", "more"), "twice")
    repeated = each.join(twice, ["id", "more"], "left_semi").groupBy("ord").agg(F.collect_list(F.struct("idx", "id", "more", "w")).alias("lines"))
    return scratch.save(repeated.mapInArrow(_positions(min_words), "ord long, idx int, id long, more long, left int, spans array<int>"), "places")


def _ranked(scratch: Scratch, pairs: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(ord, idx, r) of all (ord, idx, a, b), and the number of different r, which have the order of (a, b)."""
    classes = pairs.select("a", "b").distinct().repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    ordered = scratch.save(classes.withColumn("r", F.monotonically_increasing_id()), f"classes{k}")
    ranks = scratch.save(pairs.join(ordered, ["a", "b"]).select("ord", "idx", "r"), f"ranks{k}")
    number = ordered.count()
    scratch.drop(f"classes{k}", f"pairs{k}")
    return ranks, number


def _doubled(places: DataFrame, scratch: Scratch, longest: int | None = None) -> list[DataFrame]:
    """Ranks (ord, idx, r) by the first 1, 2, 4, ... lines of a stretch, up to those of
    ``longest`` lines or those that tell apart all that longer ones do."""
    pairs = places.select("ord", "idx", F.col("id").alias("a"), F.col("more").alias("b"))
    ranks, number = _ranked(scratch, pairs, 0)
    found = [ranks]
    while number and not (longest and 1 << (len(found) - 1) >= longest):
        reach = 1 << (len(found) - 1)
        ahead = F.first("r").over(W.partitionBy("ord").orderBy("idx").rangeBetween(reach, reach))
        pairs = found[-1].select("ord", "idx", F.col("r").alias("a"), F.coalesce(ahead, F.lit(-1)).alias("b"))  # -1: the stretch has ended
        ranks, finer = _ranked(scratch, scratch.save(pairs, f"pairs{len(found)}"), len(found))
        if finer == number:
            break
        found.append(ranks)
        number = finer
    return found if number else []


def _array(places: DataFrame, ranks: list[DataFrame], scratch: Scratch) -> DataFrame:
    """The suffix array (p, ord, idx, spans, lcp) of the places where a window starts, ascending
    in p; lcp is the number of lines that an entry shares with the one before it."""
    every = ranks[0].withColumn("k", F.lit(0))
    for k, df in enumerate(ranks[1:], 1):
        every = every.union(df.withColumn("k", F.lit(k)))
    paths = every.groupBy("ord", "idx").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("path")).select("ord", "idx", F.col("path.r").alias("path"))
    starts = places.where(F.size("spans") > 0).select("ord", "idx", "left", "spans").join(paths, ["ord", "idx"])
    starts = scratch.save(starts.withColumn("r", F.element_at("path", -1)), "starts")
    array = starts.repartitionByRange("r", "ord", "idx").sortWithinPartitions("r", "ord", "idx").withColumn("p", F.monotonically_increasing_id())
    array = scratch.save(array, "array")
    ends = array.groupBy(F.shiftright("p", 33).alias("part")).agg(F.min("p").alias("first"), F.max("p").alias("last")).orderBy("part").collect()  # a row of a partition
    jumps = F.create_map(*[x for a, b in zip(ends, ends[1:], strict=False) for x in (F.lit(b["first"]), F.lit(a["last"]))]) if len(ends) > 1 else None
    before = F.col("p") - 1 if jumps is None else F.coalesce(F.try_element_at(jumps, F.col("p")), F.col("p") - 1)
    others = array.select(F.col("p").alias("q"), F.col("ord").alias("ord2"), F.col("idx").alias("idx2"), F.col("path").alias("path2"))
    shared = F.size(F.filter(F.zip_with("path", "path2", lambda a, b: a == b), lambda x: x))
    pairs = array.withColumn("q", before).join(others, "q", "left").withColumn("depth", F.when(F.col("ord2").isNull(), 0).otherwise(shared) - 1)
    pairs = pairs.select("p", "ord", "idx", "left", "spans", "ord2", "idx2", "depth", F.when(F.col("depth") < 0, 0).otherwise(F.expr("shiftleft(1, greatest(depth, 0))")).alias("lcp"))
    pairs = scratch.save(pairs, "neighbours")
    active = None
    for k in range(len(ranks) - 2, -1, -1):
        entering = pairs.where(F.col("depth") == k + 1)
        active = entering if active is None else active.union(entering)
        a = ranks[k].select("ord", F.col("idx").alias("at"), F.col("r").alias("r1"))
        b = ranks[k].select(F.col("ord").alias("ord2"), F.col("idx").alias("at2"), F.col("r").alias("r2"))
        both = active.withColumns({"at": F.col("idx") + F.col("lcp"), "at2": F.col("idx2") + F.col("lcp")}).join(a, ["ord", "at"], "left").join(b, ["ord2", "at2"], "left")
        more = F.when(F.col("r1") == F.col("r2"), 1 << k).otherwise(0)
        active = scratch.save(both.withColumn("lcp", F.col("lcp") + more).select(*pairs.columns), f"lcp{k}")
        scratch.drop(f"lcp{k + 1}")
    whole = pairs.where("depth <= 0")
    found = whole if active is None else whole.union(active)
    # suffixes that end together are equal at every depth
    return found.select("p", "ord", "idx", "spans", F.least("lcp", "left").alias("lcp"))


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of the array, in order: the entries that have a smaller lcp than all after them in it."""
    part, ps, lcps, rows = None, [], [], []
    for batch in batches:
        for key, p, lcp in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != part:
                if part is not None:
                    rows.append((part, ps, lcps))
                part, ps, lcps = key, [], []
            _push(ps, lcps, p, lcp)
    if part is not None:
        rows.append((part, ps, lcps))
    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)], names=["part", "ps", "lcps"])


def _push(ps: list[int], lcps: list[int], p: int, lcp: int) -> None:
    while lcps and lcps[-1] >= lcp:
        ps.pop()
        lcps.pop()
    ps.append(p)
    lcps.append(lcp)


def _bounds(sent):
    """Windows (ord, idx, m) to the first entry ``q`` of the LCP interval of their m lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ps, lcps, before = None, [], [], ([], [])
        for batch in batches:
            rows = []
            for key, p, lcp, ord_, idx, spans in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if key != part:
                    part, ps, lcps, before = key, [], [], sent.value[key]
                _push(ps, lcps, p, lcp)
                for m in spans:
                    at = bisect_left(lcps, m) - 1
                    rows.append((ord_, idx, m, ps[at] if at >= 0 else before[0][bisect_left(before[1], m) - 1]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["ord", "idx", "m", "q"])

    return run


def _intervals(array: DataFrame, scratch: Scratch) -> DataFrame:
    """(ord, idx, m, q): windows of m lines with the LCP interval that they are in.

    The driver gets of each part of the array its entries of smaller lcp than all after, at most
    one for each length of a common prefix.
    """
    parted = array.select(F.shiftright("p", 33).alias("part"), "p", "lcp", "ord", "idx", "spans").repartition("part").sortWithinPartitions("part", "p")
    found = parted.select("part", "p", "lcp").mapInArrow(_minima, "part long, ps array<long>, lcps array<int>").orderBy("part").collect()
    carried, ps, lcps = {}, [], []
    for r in found:
        carried[r["part"]] = (list(ps), list(lcps))
        for p, lcp in zip(r["ps"], r["lcps"], strict=True):
            _push(ps, lcps, p, lcp)
    return scratch.save(parted.mapInArrow(_bounds(scratch.spark.sparkContext.broadcast(carried)), "ord long, idx int, m int, q long"), "intervals")


def suffix_array(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(place, doc_id, h, line, lcp): the suffix array of the lines at which a window of repeated
    lines of ``min_words`` words starts; h is the XXH64 of the text, line counts from 0."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = _sequences(docs, scratch)
    places = _places(lines, min_words, scratch)
    ranks = _doubled(places, scratch)
    if not ranks:
        return docs.sparkSession.createDataFrame([], "place long, doc_id long, h long, line int, lcp int")
    array = _array(places, ranks, scratch)
    return array.join(lines.select("ord", "doc_id", "h"), "ord").select(F.col("p").alias("place"), "doc_id", "h", F.col("idx").alias("line"), "lcp")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, keep): for each document with deleted lines, which of its lines stay.

    h is the XXH64 of the text; documents are in the order of (doc_id, h), null first.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = _sequences(docs, scratch)
    places = _places(lines, min_words, scratch)
    longest = places.select(F.max(F.array_max("spans"))).first()[0]
    ranks = _doubled(places, scratch, longest) if longest else []
    if not ranks:
        return scratch.save(docs.sparkSession.createDataFrame([], "doc_id long, h long, keep array<boolean>"), "kept")
    named = _intervals(_array(places, ranks, scratch), scratch)
    first = named.groupBy("m", "q").agg(F.count("*").alias("n"), F.min(F.struct("ord", "idx")).alias("first")).where("n > 1").drop("n")
    first = scratch.save(first, "first")
    marks = named.join(first, ["m", "q"]).where(F.struct("ord", "idx") > F.col("first")).select("ord", "idx", "m")
    spans_of = marks.groupBy("ord").agg(F.collect_list(F.struct("idx", "m")).alias("spans"))
    kept = lines.select("ord", "doc_id", "h", F.size("ids").alias("n")).join(spans_of, "ord").select("doc_id", "h", "n", "spans")
    kept = scratch.save(kept.mapInArrow(_kept, "doc_id long, h long, keep array<boolean>"), "kept")
    scratch.keep("kept")
    return kept


def _cleaned(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, changed, cleaned, n, removed): the caller's rows, texts without later copies and numbers of lines."""
    kept = later_copies(docs, min_words)
    keyed = packed(docs, doc_id="long", text="string").withColumn("h", F.xxhash64("text")).alias("d")
    # texts are dealt by document at every size: what stays of the lines grows with the input
    joined = keyed.join(kept.hint("merge").alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.h") == F.col("k.h")), "left")
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    left = F.filter(F.split("text", "\n", -1), lambda x, i: F.get(F.col("keep"), i))
    cleaned = F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    removed = F.when(F.col("keep").isNull(), F.lit(0)).otherwise(F.size(F.filter("keep", lambda x: ~x)))
    return joined.select("row", cleaned.alias("cleaned"), n.cast("long").alias("n"), removed.cast("long").alias("removed"))


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, text without the later copies of repeated runs of lines, and
    struct _lines(n, removed).

    Runs of fewer than ``min_words`` words stay, whatever their number of copies.  A null text
    stays null and has no lines; an empty text has one empty line.  Rows of equal doc_id and
    text are one document: each of them gets the same text.  Between documents of one doc_id the
    one of the smaller XXH64 is earlier; null ids are earliest.  A document whose lines all go
    keeps its row with an empty text.  An empty table gives an empty table.  Columns may have
    any names; one named _lines makes room for the counts.
    """
    return unpacked(_cleaned(docs, min_words), docs, {place(docs, "text"): F.col("cleaned")}, {"_lines": F.struct("n", "removed")})


def remaining(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """:func:`deduplicate` without the rows that lost lines and have no word left, with the
    columns of ``docs``; n_chars, where there is one, follows the text."""
    found = _cleaned(docs, min_words).where((F.col("removed") == 0) | F.col("cleaned").rlike("[^\\x20\\x09-\\x0D]"))
    replaced = {place(docs, "text"): F.col("cleaned")}
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        at = place(docs, "n_chars")
        replaced[at] = F.when(F.col("removed") > 0, F.char_length("cleaned")).otherwise(F.col(f"row.c{at}")).cast(docs.schema[at].dataType)
    return unpacked(found, docs, replaced)
