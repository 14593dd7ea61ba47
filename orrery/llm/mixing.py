"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source queue in shuffled order, whole queue after whole queue (a second pass
repeats the source).  A document's virtual finish time is the number of its source's tokens up
to its end divided by the source's target; the queues are merged in the order of these times
and the merged list is cut at the budget.

No task's share grows with the data.  A source's queue is cut into hash ranges of about
``GROUP`` rows; sums before a range are added up in two levels, first those of coarse ranges and
then those of the ranges inside one.  Rows that are alike in source, id and text are summed by the
partition that they were read in.  The merged list is cut into coarse and then fine ranges of
finish time, of which only the ones that hold the cut are looked into.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from .rows import packed, pick, unpacked
from .scratch import Scratch
from .text import WORD_JAVA

#: Rows of a hash range or a range of finish times, on average.
GROUP = 256


def targets(totals: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """(source, source_size) to those with srank, target: shares of ``budget`` x all tokens by weight.

    Sources in the order of code points, null last, take ``weights`` in turn.  A target is at
    most ``most`` x its source's tokens; the excess is shared anew by weight.  With sources by
    cap/weight, the level of the others after the first j are capped is (budget - caps) / weights,
    which rises up to the right j and falls after it: the level is its maximum.
    """
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    ranked = totals.withColumn("srank", order).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("srank") - 1) % len(weights) + 1).cast("double"))
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = W.orderBy(F.col("cap") / F.col("w"), "srank")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    all_of_it = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(float(budget)) * F.sum("source_size").over(all_of_it) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levelled = capped.withColumn("level", level).withColumn("level", F.max("level").over(all_of_it))
    return levelled.select("source", "source_size", "srank", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _before(partition: list[str], order: list[str], value: str):
    """Sum of ``value`` over the rows of the partition that come first."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _key(salt: str):
    """Place in the shuffled order: the same for rows of equal id and text only."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{salt}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), text).cast("binary"))


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def _mixed(docs: DataFrame, weights: tuple[float, ...], budget: float, most: float, salt: str) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, taken): a row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = pick(docs, doc_id="long", source="string", text="string")
    # a row's number among those alike in the partition that it is read in is fixed by writing it
    rows = scratch.save(rows.select("doc_id", "source", _size().alias("size"), _key(salt).alias("key"), F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at")), "sizes")
    totals = scratch.save(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "totals")
    known = totals.agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("source_size").alias("size")).first()
    n, total = known["n"] or 0, known["size"] or 0
    digits = max(2, math.ceil(math.log(max(2, (known["most"] or 0) / GROUP), 16)))
    aims = targets(totals.select("source", "source_size"), weights, budget, most)

    alike = ["source", "part", "key", "pid"]
    ranged = rows.withColumn("part", F.substring("key", 1, digits))
    cells = scratch.save(ranged.groupBy(*alike).agg(F.sum("size").alias("cell_size")), "cells")
    parts = cells.groupBy("source", "part").agg(F.sum("cell_size").alias("part_size")).withColumn("top", F.substring("part", 1, digits // 2))
    tops = parts.groupBy("source", "top").agg(F.sum("part_size").alias("top_size"))
    tops = tops.select("source", "top", _before(["source"], ["top"], "top_size").alias("top_base"))
    parts = parts.withColumn("part_base", _before(["source", "top"], ["part"], "part_size"))
    cells = cells.withColumn("cell_base", _before(["source", "part"], ["key", "pid"], "cell_size"))
    a, b, c = parts.alias("a"), tops.alias("b"), aims.alias("c")
    bases = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.top") == F.col("b.top"))).join(c, F.col("a.source").eqNullSafe(F.col("c.source")))
    bases = bases.select("a.source", "a.part", (F.col("top_base") + F.col("part_base")).alias("base"), "c.source_size", "c.srank", "c.target")
    a, b = cells.alias("a"), bases.alias("b")
    based = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.part") == F.col("b.part")))
    based = scratch.save(based.select("a.source", "a.key", "a.pid", (F.col("base") + F.col("cell_base")).alias("base"), "source_size", "srank", "target"), "bases")
    inside = W.partitionBy("source", "key", "pid").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    a, b = rows.withColumn("upto", F.sum("size").over(inside)).alias("a"), based.alias("b")
    queued = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.pid") == F.col("b.pid"))).select(
        "a.doc_id", "a.source", "a.size", "a.key", "b.source_size", "b.srank", "b.target", (F.col("b.base") + F.col("a.upto")).alias("upto")
    )
    live = (F.col("size") > 0) & (F.col("target") > 0)
    queued = scratch.save(
        queued.withColumn("first", F.when(live, F.col("upto") / F.col("target"))).withColumn("second", F.when(live, (F.col("upto") + F.col("source_size")) / F.col("target"))),
        "queued",
    )
    words = math.floor(budget * total)
    times = queued.where(F.col("first").isNotNull()).select("srank", "size", F.explode(F.array("first", "second")).alias("finish"))
    taken = _taken(times, words, n)
    found = scratch.save(queued.select("doc_id", "source", "size", "key", "source_size", "target", taken.cast("long").alias("taken")), "mixed")
    scratch.keep("mixed")
    return found


def _taken(times: DataFrame, words: int, n: int):
    """What the mix takes of a row with ``size``, ``first`` and ``second`` finish, if the first
    ``words`` words of all ``times`` (srank, size, finish) in their order are taken."""
    step = max(1, math.ceil(math.sqrt(2 * n / GROUP)))
    late = F.least("finish", F.lit(8.0))  # the cut is near 1, where every source has its target
    level = {"before": 0}
    for scale in (step, step * step):
        bins = times.groupBy(F.floor(late * scale).alias("bin")).agg(F.sum("size").alias("bin_size"))
        bins = bins.withColumn("before", F.lit(level["before"]) + F.coalesce(F.sum("bin_size").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        level = bins.where((F.col("before") < words) & (F.col("before") + F.col("bin_size") >= words)).first()
        if level is None:  # nothing is taken, or all
            return F.lit(0).cast("long") if words == 0 else F.when(F.col("first").isNotNull(), 2 * F.col("size")).otherwise(0)
        times = times.where(F.floor(late * scale) == level["bin"])
    order = W.orderBy("finish", "srank").rowsBetween(W.unboundedPreceding, -1)
    near = times.withColumn("before", F.lit(level["before"]) + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = near.where((F.col("before") < words) & (F.col("before") + F.col("size") >= words)).first()

    def of(finish: str):
        f, rank = F.col(finish), F.col("srank")
        whole = (f < last["finish"]) | ((f == last["finish"]) & (rank < last["srank"]))
        return F.when(whole, F.col("size")).when((f == last["finish"]) & (rank == last["srank"]), F.lit(words - last["before"])).otherwise(F.lit(0))

    return of("first") + of("second")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, salt: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per row of ``docs``.

    size counts words, 0 for a null text; taken counts the words that the mix takes, a second
    pass included.  The last document is cut so that the words taken are the budget's whole
    part.  A null source is a source, the last one.  Rows of equal id and text stand beside each
    other in the shuffled order and are separate rows.  Documents without words take nothing.
    An empty table gives an empty table.  Other columns are not read.
    """
    return _mixed(docs, weights, budget, most, salt).select("doc_id", "size", "source_size", "target", "taken")


def mixed_in(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, salt: str = "mix") -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, all columns, with mix_size, mix_target
    and mix_taken, which take the place of columns of these names.  Of rows of equal id, source
    and text each has the words of one of them, in any order."""
    found = _mixed(docs, weights, budget, most, salt)
    of = W.partitionBy("key", "source")
    found = found.withColumn("number", F.row_number().over(of.orderBy(F.desc("taken")))).where("taken > 0").alias("b")
    rows = packed(docs, doc_id="long", source="string", text="string").select("row", "source", _key(salt).alias("key"))
    rows = rows.withColumn("number", F.row_number().over(of.orderBy("key"))).alias("a")
    on = (F.col("a.key") == F.col("b.key")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.number") == F.col("b.number"))
    joined = rows.join(found.hint("merge"), on).select("a.row", "b.size", "b.target", "b.taken")
    return unpacked(joined, docs, added={"mix_size": F.col("size"), "mix_target": F.col("target"), "mix_taken": F.col("taken")})
