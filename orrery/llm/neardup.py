"""One document of each group of near-duplicates, by wide SimHash fingerprints.

The five-word shingles of two texts are compared through a fingerprint of ``CHECK_BITS`` bits,
each bit the majority of a hash bit over the text's distinct shingles; sets of Jaccard similarity
J differ in a share of acos(2J / (1 + J)) / pi of the bits.  At J = 0.8 that is a seventh of the
bits, more than any exact split into segments can index, so candidates come from minima: a text
has ``BANDS`` keys, each of the least hashes of its shingles under ``ROWS`` hash functions, and a
candidate pair agrees in one key.  It does with probability 1 - (1 - J^ROWS)^BANDS, 0.999 at 0.8,
whatever the number of texts and wherever they differ.  A candidate then passes the full Hamming
check of the fingerprint, after the cumulative differences of chains of its words are held against
their share of the budget.  Majorities of few shingles are coarse: texts of at most ``SMALL``
shingles pass a wider check and then the exact one.

The group of texts of a key is handled as a unit of about ``UNIT`` texts, which gives the links of
a spanning forest of its close texts, not all pairs.  A larger group is dealt out into such units
first; of what these leave unlinked, the most linked text of each larger component is compared
with the whole group, and then every text outside the group's main component with all others, in
blocks over many tasks.  So all pairs of a group are decided, however large it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected
from .rows import packed, pick, unpacked
from .scratch import Scratch
from .text import mixed, rolling_shingles
from .vectors import word_hashes

SHINGLE, SIMILARITY = 5, 0.8
CHECK_BITS = 1024
#: Keys of a text, and minima of a key.
BANDS, ROWS = 24, 6
#: Distinct shingles up to which the texts' shingles themselves are compared.
SMALL = 64
UNIT = 1024
_ODD, _PERMUTED = (np.random.default_rng(seed).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed, size in ((31, CHECK_BITS // 64), (32, BANDS * ROWS)))


def wide(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The SimHash of the distinct ``hashes``, a 64-bit word for each of ``factors``."""
    hashes, votes = np.unique(hashes), np.zeros(64 * len(factors), np.int64)
    for at in range(0, len(hashes), 2048):
        words = mixed(hashes[at : at + 2048, None] * factors[None, :])
        votes += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)


def keys(shingles: np.ndarray) -> np.ndarray:
    """A text's ``BANDS`` keys from the hashes of its shingles."""
    least = np.full(BANDS * ROWS, -1, np.int64).view(np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, (_PERMUTED[:, None] * shingles[None, at : at + 512]).min(axis=1))
    least, key = least.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * _ODD[0] + least[:, i])
    return key


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same, find, check, small = [], [], [], []
        for text in batch.column(3):
            words = word_hashes(text.as_py())
            whole = rolling_shingles(words, len(words)) if len(words) else np.zeros(1, np.uint64)
            shingles = np.unique(rolling_shingles(words, SHINGLE))
            same.append(whole[0])
            find.append(keys(shingles).view(np.int64).tolist())
            check.append(wide(shingles, _ODD).tobytes())
            small.append(shingles.tobytes() if len(shingles) <= SMALL else b"")
        yield pa.record_batch(
            [*(batch.column(i) for i in range(3)), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(find, pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in (check, small))],
            names=["nn", "id", "h", "t", "find", "check", "small"],
        )


def _close(a: np.ndarray, b: np.ndarray, budget: int) -> np.ndarray:
    """Whether rows of 64-bit words differ in at most ``budget`` bits.  The words are a ring of
    segments: some start must exist from which chains of 1 to 4 words are within their share."""
    differ = np.bitwise_count(a ^ b).astype(np.int32)
    n, chain = differ.shape[1], np.zeros_like(differ)
    alive = np.ones(differ.shape, bool)
    for length in range(1, min(4, n) + 1):
        chain += np.roll(differ, 1 - length, axis=1)
        alive &= chain * n <= length * budget
    return alive.any(axis=1) & (differ.sum(axis=1) <= budget)


class _Check:
    """Whether texts are near, by fingerprints or, of small texts, by their shingles."""

    def __init__(self, similarity: float):
        share = math.acos(2 * similarity / (1 + similarity)) / math.pi
        spread = math.sqrt(CHECK_BITS * share * (1 - share))
        self.similarity = similarity
        self.budget, self.wide = math.floor(CHECK_BITS * share + spread / 2), math.floor(CHECK_BITS * share + 8 * spread)

    def near(self, a: np.ndarray, b: np.ndarray, small_a: list[bytes], small_b: list[bytes]) -> np.ndarray:
        found = _close(a, b, self.wide)
        strict = found.copy()
        strict[found] = _close(a[found] if len(a) == len(found) else a, b[found] if len(b) == len(found) else b, self.budget)
        for i in np.flatnonzero(found).tolist():
            x, y = small_a[i % len(small_a)], small_b[i % len(small_b)]
            if x and y:
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                strict[i] = common >= self.similarity * (len(x) + len(y) - common)
        return strict


def _forest(t: np.ndarray, check: np.ndarray, small: list[bytes], test: _Check) -> list[tuple[int, int]]:
    """Links of a spanning forest of the near texts of one unit."""
    links, left = [], np.arange(len(t))
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = test.near(check[left], check[at][None, :], [small[i] for i in left.tolist()], [small[at]])
            links += [(int(t[at]), int(t[i])) for i in left[near]]
            front += left[near].tolist()
            left = left[~near]
    return links


def _as_links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["u", "v"])


def _links(test: _Check):
    """Units to the links within each."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        unit, t, check, small = _columns(rows)
        starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(unit)])))
        two = starts[sizes == 2]
        links = []
        if len(two):
            near = two[test.near(check[two], check[two + 1], [small[i] for i in two.tolist()], [small[i + 1] for i in two.tolist()])]
            links = list(zip(t[near].tolist(), t[near + 1].tolist(), strict=True))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            links += _forest(t[s : s + n], check[s : s + n], small[s : s + n], test)
        return _as_links(links)

    return of


def _across(test: _Check):
    """Units of two sides to links that join the components (``root``) of all near texts of
    different sides."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        unit, t, check, small = _columns(rows)
        roots, first = rows.column("root").to_numpy().copy(), rows.column("first").to_numpy()
        small = np.array([*small, None], object)[:-1]
        ends = np.flatnonzero(np.concatenate((unit[1:] != unit[:-1], [True]))) + 1
        links = []
        for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            root, others = roots[s:e], s + np.flatnonzero(~first[s:e])
            for i in (s + np.flatnonzero(first[s:e])).tolist():
                b = others[roots[others] != roots[i]]
                if not len(b):
                    continue
                b = b[test.near(check[b], check[i][None, :], small[b], small[i : i + 1])]
                found, at = np.unique(roots[b], return_index=True)
                links += [(int(t[i]), int(x)) for x in t[b[at]]]
                root[np.isin(root, found)] = roots[i]
        return _as_links(links)

    return of


def _columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    check = np.frombuffer(b"".join(rows.column("check").to_pylist()), np.uint64).reshape(-1, CHECK_BITS // 64)
    return rows.column("unit").to_numpy(), rows.column("t").to_numpy(), check, rows.column("small").to_pylist()


def _by_unit(of):
    """Rows in the order of their unit to links, whole units at a time; a unit may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(0).to_numpy()
            n = int(np.searchsorted(unit, unit[-1]))
            if n:
                yield of(pa.Table.from_batches([*held, batch.slice(0, n)]))
                held = []
            held.append(batch.slice(n))
        if held:
            yield of(pa.Table.from_batches(held))

    return run


def _compared(units: DataFrame, texts: DataFrame, of, scratch: Scratch, name: str) -> DataFrame:
    """(u, v): links of the texts ``t`` of each ``unit``."""
    p = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in units.columns if c not in ("unit", "t")]
    ordered = units.join(texts.select("t", "check", "small"), "t").select("unit", "t", "check", "small", *others).repartition(p, "unit").sortWithinPartitions("unit")
    return scratch.save(ordered.mapInArrow(_by_unit(of), "u long, v long"), name)


def _part(n: Column) -> Column:
    """Of a group dealt into ``n`` parts, the part of a row."""
    return F.pmod(F.xxhash64("t", "key"), n)


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _rest(large: DataFrame, texts: DataFrame, edges: DataFrame, stars: DataFrame, test: _Check, scratch: Scratch) -> DataFrame:
    """``stars`` with the links that comparing all texts of each group of ``large`` adds: (t, key, n).

    ``edges`` are the links found within parts.  No pair of one component is compared again.
    """

    def open_groups(name: str) -> DataFrame:
        """Members with their root, of groups of several roots; ``main`` is the commonest root, that ``most`` members have."""
        rooted = large.join(stars.select(F.col("u").alias("t"), F.col("v").alias("root")), "t", "left")
        rooted = scratch.save(rooted.select("key", "n", "t", F.coalesce("root", "t").alias("root")), f"{name}-rooted")
        sized = rooted.groupBy("key", "root").agg(F.count("*").alias("m"))
        mains = sized.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("m", "root")).alias("main")).where("roots > 1")
        opened = rooted.join(mains.select("key", F.col("main.root").alias("main"), F.col("main.m").alias("most")), "key")
        return scratch.save(opened, f"{name}-open")

    parts = F.ceil(F.col("n") / UNIT)
    side = lambda df, unit, first: df.select(F.xxhash64("key", *unit).alias("unit"), "t", "root", F.lit(first).alias("first"))
    members = open_groups("hubs")
    if not members.limit(1).count():
        return stars
    linked = members.join(edges.groupBy(F.col("u").alias("t")).agg(F.count("*").alias("links")), "t")
    hubs = members.groupBy("key", "n", "root").agg(F.count("*").alias("m")).where(F.col("m") * UNIT >= F.col("n")).select("key", "root")
    hubs = linked.join(hubs, ["key", "root"]).groupBy("key", "n", "root").agg(F.max(F.struct("links", "t")).alias("hub"))
    hubs = hubs.select("key", "root", F.col("hub.t").alias("t"), _each(parts).alias("part"))
    found = _compared(side(hubs, ["part"], True).union(side(members, [_part(parts)], False)), texts, _across(test), scratch, "hub-links")
    stars = connected(stars.union(found), scratch, "hub-stars")

    members = open_groups("strays")
    if not members.limit(1).count():
        return stars
    blocks = F.ceil((F.col("n") - F.col("most")) / UNIT)
    strays = members.where("root <> main").select("*", _part(blocks).alias("block"), _each(parts).alias("part"))
    others = members.select("*", _part(parts).alias("part"), _each(blocks).alias("block"))
    found = _compared(side(strays, ["block", "part"], True).union(side(others, ["block", "part"], False)), texts, _across(test), scratch, "stray-links")
    return connected(stars.union(found), scratch, "stray-stars")


def _key() -> list[Column]:
    """What tells rows of (doc_id, text) apart."""
    return [F.col("doc_id").isNotNull().alias("nn"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h")]


def groups(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """(nn, id, h, root): a row per row of ``docs``; rows of one root are near-duplicates.

    (nn, id) is doc_id, h the XXH64 of the text.  Texts of equal words are one text.
    """
    keyed = pick(docs, doc_id="long", text="string").select(*_key(), "text")
    marked = scratch.save(keyed.mapInArrow(_fingerprints, "nn boolean, id long, h long, t long, find array<long>, check binary, small binary"), "fingerprints")
    texts = scratch.save(marked.groupBy("t").agg(*[F.first(c).alias(c) for c in ("find", "check", "small")]), "texts")
    cells = texts.select("t", F.explode("find").alias("key"))
    sizes = cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.save(cells.join(sizes, "key").select("t", "key", "n"), "members")
    test, parts = _Check(similarity), F.ceil(F.col("n") / UNIT)
    units = members.select("t", F.xxhash64("key", _part(parts)).alias("unit"))
    edges = _compared(units, texts, _links(test), scratch, "links")
    stars = connected(edges, scratch)
    large = members.where(F.col("n") > UNIT)
    if large.limit(1).count():
        stars = _rest(large, texts, edges, stars, test, scratch)
    roots = marked.select("nn", "id", "h", "t").join(stars.select(F.col("u").alias("t"), F.col("v").alias("root")), "t", "left")
    found = scratch.save(roots.select("nn", "id", "h", F.coalesce("root", "t").alias("root")), "groups")
    scratch.keep("groups")
    return found


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, without those near another row that stays.

    Of a group the row of the least doc_id stays, null last, then that of the lowest XXH64 of its
    text; repeated rows are a group.  Texts without words, null ones too, are one group.  Texts
    of fewer than five words are near only to equal words.  An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    of = groups(docs, scratch, similarity)
    kept = of.groupBy("root").agg(F.min(F.struct((~F.col("nn")).alias("null"), "id", "h")).alias("k")).select((~F.col("k.null")).alias("nn"), F.col("k.id").alias("id"), F.col("k.h").alias("h"))
    kept = scratch.save(kept, "kept")
    repeated = of.groupBy("nn", "id", "h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    found = packed(docs, doc_id="long", text="string").select("row", *_key()).join(kept.hint("merge"), ["nn", "id", "h"], "left_semi")
    if repeated:
        found = found.dropDuplicates(["nn", "id", "h"])
    return unpacked(found, docs)
