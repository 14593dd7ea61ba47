"""Large values in chunks that are stored once for each content.

A blob is a name, a size and the SHA-256 of its chunks in order; a chunk's count of claims is the
sum of signed rows, so claims are added and taken back by appending.  Every table is a list of
immutable folders, named by the newest state of the folder; a change writes folders of its own
and then claims the next state, so it happens whole or not at all, and one that another was
faster than is worked out again over the newer state.
"""

from __future__ import annotations

import hashlib
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import StorageError
from ..store import ABANDONED_S, claim, numbers, state_of

CHUNK = 1 << 20
SCHEMAS = {"chunks": "hash string, bytes binary", "blobs": "name long, size long, hashes array<string>", "claims": "hash string, n long"}


class Blobs:
    """Blobs in ``folder``, which is mounted on every machine."""

    def __init__(self, spark: SparkSession, folder: str, chunk: int = CHUNK):
        self.spark, self.folder, self.chunk = spark, Path(folder).absolute(), chunk
        for name in ("states", "data"):
            (self.folder / name).mkdir(parents=True, exist_ok=True)
        claim(self.folder / "states", {"txid": 0} | {name: [] for name in SCHEMAS})

    def _newest(self) -> dict:
        return state_of(self.folder / "states", max(numbers(self.folder / "states")))

    def _table(self, name: str, state: dict | None = None) -> DataFrame:
        parts = [(self.folder / "data" / p).as_uri() for p in (state or self._newest())[name]]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMAS[name])

    def _part(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet((self.folder / "data" / name).as_uri())
        return name

    def _change(self, change: Callable[[dict], dict]) -> None:
        """Claim the state that ``change`` makes of the newest one, again if another was faster."""
        while True:
            state = self._newest()
            if claim(self.folder / "states", state | change(state) | {"txid": state["txid"] + 1}):
                return

    def chunks(self) -> DataFrame:
        return self._table("chunks")

    def blobs(self) -> DataFrame:
        return self._table("blobs")

    def write(self, values: DataFrame) -> None:
        """Store ``values`` (name, bytes); chunks that are there already aren't written again.
        A blob's chunks start without claims.  A name that is null, given twice or taken, and a
        null value, are errors, and nothing is stored."""
        n = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / self.chunk)).cast("int")
        piece = F.expr(f"substring(bytes, at * {self.chunk} + 1, {self.chunk})")
        parts = values.select(F.col("name").cast("long").alias("name"), "bytes", F.posexplode_outer(F.sequence(F.lit(0), n - 1)).alias("place", "at"))
        parts = parts.select("name", F.col("bytes").isNull().alias("missing"), F.coalesce("at", F.lit(0)).alias("at"), piece.alias("piece")).withColumn("hash", F.sha2("piece", 256))
        given = (self.folder / "data" / self._part(parts)).as_uri()
        parts = self.spark.read.schema("name long, missing boolean, at int, piece binary, hash string").parquet(given)
        wrong = parts.where("name is null or missing").limit(1).collect()
        if wrong:
            raise StorageError("a blob has no name" if wrong[0]["name"] is None else f"blob {wrong[0]['name']} has no bytes")
        if twice := parts.where("at = 0").groupBy("name").count().where("count > 1").limit(1).collect():
            raise StorageError(f"blob {twice[0]['name']} is written twice")
        listed = F.array_sort(F.collect_list(F.struct("at", "hash", F.octet_length("piece").cast("long").alias("n"))))
        rows = parts.groupBy("name").agg(listed.alias("c")).select("name", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("size"), F.col("c.hash").alias("hashes"))
        rows = self._part(rows)

        def change(state: dict) -> dict:
            if known := parts.select("name").join(self._table("blobs", state), "name", "left_semi").limit(1).collect():
                raise StorageError(f"blob {known[0]['name']} exists already")
            fresh = parts.select("hash", F.col("piece").alias("bytes")).dropDuplicates(["hash"]).join(self._table("chunks", state).select("hash"), "hash", "left_anti")
            return {"chunks": [*state["chunks"], self._part(fresh)], "blobs": [*state["blobs"], rows]}

        self._change(change)
        shutil.rmtree(Path(given.removeprefix("file://")), ignore_errors=True)

    def read_all(self) -> DataFrame:
        """(name, bytes) of every blob."""
        state = self._newest()
        at = self._table("blobs", state).select("name", "size", F.posexplode("hashes").alias("at", "hash"))
        return at.join(self._table("chunks", state), "hash").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("c")).select(
            "name", F.aggregate("c", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["bytes"])).alias("bytes")
        )

    def read(self, name: int) -> Iterator[bytes]:
        """One blob, a chunk at a time; its length is checked at the end."""
        state = self._newest()
        at = self._table("blobs", state).where(F.col("name") == name).select("size", F.posexplode("hashes").alias("at", "hash"))
        total = size = 0
        for r in at.join(self._table("chunks", state), "hash").orderBy("at").toLocalIterator():
            if hashlib.sha256(r["bytes"]).hexdigest() != r["hash"]:
                raise StorageError("a chunk differs from its address")
            total, size = total + len(r["bytes"]), r["size"]
            yield bytes(r["bytes"])
        if total != size:
            raise StorageError("the blob is not as long as it says")

    def _claimed(self, names: DataFrame, state: dict) -> DataFrame:
        """(hash, n): how many of the named blobs have a chunk."""
        names = names.select(F.col("name").cast("long").alias("name")).distinct()
        blobs = self._table("blobs", state)
        if unknown := names.join(blobs, "name", "left_anti").limit(1).collect():
            raise StorageError(f"no blob {unknown[0]['name']}")
        return blobs.join(names, "name", "left_semi").select(F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))

    def retain(self, names: DataFrame) -> None:
        self._change(lambda state: {"claims": [*state["claims"], self._part(self._claimed(names, state))]})

    def release(self, names: DataFrame) -> None:
        """Take claims back; chunks that had claims and have none left are deleted."""

        def change(state: dict) -> dict:
            before = self._table("claims", state).groupBy("hash").agg(F.sum("n").alias("had"))
            left = self._claimed(names, state).join(before, "hash", "left").select("hash", F.col("n"), (F.coalesce("had", F.lit(0)) - F.col("n")).alias("left"))
            if left.where("left < 0").limit(1).count():
                raise StorageError("a chunk is released more often than it was retained")
            kept = self._table("chunks", state).join(left.where("left = 0").select("hash"), "hash", "left_anti")
            return {"chunks": [self._part(kept)], "claims": [*state["claims"], self._part(left.select("hash", (-F.col("n")).alias("n")))]}

        self._change(change)

    def check(self) -> DataFrame:
        """(state, chunks): sound ones, those nobody claims, and claims whose bytes are gone."""
        state = self._newest()
        claims = self._table("claims", state).groupBy("hash").agg(F.sum("n").alias("n")).where("n > 0")
        both = self._table("chunks", state).select("hash", F.lit(1).alias("there")).join(claims, "hash", "full_outer")
        kind = F.when(F.col("there").isNull(), "broken").when(F.col("n").isNull(), "unclaimed").otherwise("sound")
        return both.groupBy(kind.alias("state")).agg(F.count("*").alias("chunks"))

    def sweep(self) -> int:
        """Delete folders that the newest state doesn't name and that are ``ABANDONED_S`` old; how many."""
        state = self._newest()
        named = {p for name in SCHEMAS for p in state[name]}
        gone = [p for p in (self.folder / "data").iterdir() if p.name not in named and time.time() - p.stat().st_mtime > ABANDONED_S]
        for path in gone:
            shutil.rmtree(path, ignore_errors=True)
        return len(gone)
