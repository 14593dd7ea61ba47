"""Token counts as delta-maintained rollups.

A batch of changes becomes signed rows (documents, tokens) by document, source, language and
tokenizer version: an insert adds, a delete takes away what the ledger holds of the document, a
revision does both.  Their sums by source, language and version are the batch's delta; totals
are the sum of the deltas of committed batches, so no batch reads the texts of another.

Commits are numbered.  A batch is written to a folder of its own attempt; a marker that names
batch and attempt is written whole under a name of its own and then renamed to the next number,
which fails if that is taken.  So a batch that is sent again changes nothing, an attempt that
broke off is never read, and a batch that another one was faster than is worked out again over
what that one left: no document is taken away twice.  After ``COMPACT`` batches a commit of one
attempt with what stands takes the place of all before it.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .rows import pick
from .scratch import Scratch
from .text import words_of

FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEDGER = "nn boolean, id long, source string, lang string, tokenizer string, docs long, tokens long"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
KEYS = ["source", "lang", "tokenizer"]
COLUMNS = ["nn", "id", *KEYS, "docs", "tokens"]
#: Batches after which commits are compacted.
COMPACT = 64


def count_words(text: str) -> int:
    return len(words_of(text))


class RankFile:
    """Byte-level BPE by a file of ranks; the file is read where the object is made."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.data, self.pattern, self.encoding = Path(path).read_bytes(), pattern, None

    def __getstate__(self):
        return self.__dict__ | {"encoding": None}

    def __call__(self, text: str) -> int:
        if self.encoding is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
            self.encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return len(self.encoding.encode_ordinary(text))


class PieceFile(RankFile):
    """A sentencepiece model."""

    def __call__(self, text: str) -> int:
        if self.encoding is None:
            import sentencepiece

            self.encoding = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return len(self.encoding.encode(text, num_threads=1))


class JsonFile(RankFile):
    """A tokenizer of the ``tokenizers`` library; strings of special tokens are ordinary text."""

    def __call__(self, text: str) -> int:
        if self.encoding is None:
            from tokenizers import Tokenizer

            self.encoding = Tokenizer.from_str(self.data.decode())
            self.encoding.encode_special_tokens = True
        return len(self.encoding.encode(text, add_special_tokens=False))


def tokenizers(folder: str = FOLDER) -> dict[str, Callable[[str], int]]:
    """Version names to counters, those that the query counts with."""
    return {"byte_bpe_50k": RankFile(f"{folder}/byte_bpe_50k.tiktoken"), "byte_bpe_multi_50k": RankFile(f"{folder}/byte_bpe_multi_50k.tiktoken"), "words-1": count_words}


def counted(docs: DataFrame, counters: dict[str, Callable[[str], int]]) -> DataFrame:
    """A ledger row for each row of ``docs`` (doc_id, source, lang, text) and each tokenizer."""
    sent = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(sent.value)
        for batch in batches:
            tokens = [[sent.value[n](t) if t else 0 for n in names] for t in (x.as_py() for x in batch.column(4))]
            for i, name in enumerate(names):
                own = pa.array([t[i] for t in tokens], pa.int64())
                yield pa.record_batch([*(batch.column(k) for k in range(4)), pa.array([name] * len(tokens)), pa.array([1] * len(tokens), pa.int64()), own], names=["nn", "id", "source", "lang", "tokenizer", "docs", "tokens"])

    rows = pick(docs, doc_id="long", source="string", lang="string", text="string")
    keyed = rows.select(F.col("doc_id").isNotNull().alias("nn"), F.coalesce("doc_id", F.lit(0)).alias("id"), "source", "lang", "text")
    return keyed.mapInArrow(run, LEDGER)


class Rollup:
    """Totals of a changing set of documents, kept in ``folder``, a URI that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, counters: dict[str, Callable[[str], int]] | None = None, compact: int = COMPACT):
        self.spark, self.folder, self.counters, self.every = spark, folder.rstrip("/"), tokenizers() if counters is None else counters, compact

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, fs = self._path("commits")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _log(self) -> tuple[int, list[dict]]:
        """The last number, and the commits from the last compaction on."""
        numbers, out = self._numbers(), []
        for n in reversed(numbers):
            path, fs = self._path("commits", str(n))
            stream = fs.open(path)
            out.append(json.loads(stream.readUTF()))
            stream.close()
            if out[-1]["batch"] is None:
                break
        return (numbers or [0])[-1], out[::-1]

    def _claim(self, number: int, body: dict) -> bool:
        """Give the commit its number; False if another has it.  The rename is one step where the
        file system's is; local files are linked."""
        path, fs = self._path("commits", f"{body['attempt']}.new")
        stream = fs.create(path, True)
        stream.writeUTF(json.dumps(body))
        stream.close()
        to, _ = self._path("commits", str(number))
        if path.toUri().getScheme() in (None, "file"):
            try:
                os.link(path.toUri().getPath(), to.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(path, False)
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(path, to, options)
            return True
        except Exception:
            if fs.exists(to):
                fs.delete(path, False)
                return False
            raise

    def _known(self, log: list[dict], batch: str) -> bool:
        if any(c["batch"] == batch for c in log):
            return True
        return bool(log) and log[0]["batch"] is None and self._rows(log[:1], "names", "batch string").where(F.col("batch") == batch).limit(1).count() > 0

    def batches(self) -> set[str]:
        """Names of the committed batches."""
        log = self._log()[1]
        old = {r["batch"] for r in self._rows(log[:1], "names", "batch string").collect()} if log and log[0]["batch"] is None else set()
        return old | {c["batch"] for c in log if c["batch"] is not None}

    def _rows(self, log: list[dict], kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/attempts/{c['attempt']}/{kind}" for c in log]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _ledger(self, log: list[dict]) -> DataFrame:
        rows = self._rows(log, "ledger", LEDGER).groupBy("nn", "id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return rows.where("docs <> 0 or tokens <> 0")

    def ledger(self) -> DataFrame:
        """What stands of each document."""
        return self._ledger(self._log()[1])

    def _totals(self, log: list[dict]) -> DataFrame:
        rows = self._rows(log, "delta", DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of what stands; groups without documents have no row."""
        return self._totals(self._log()[1])

    def compact(self) -> bool:
        """Put one commit with what stands in the place of all before; False if another commit was faster."""
        number, log = self._log()
        attempt = uuid.uuid4().hex
        at = f"{self.folder}/attempts/{attempt}"
        self._ledger(log).write.parquet(f"{at}/ledger")
        self._totals(log).write.parquet(f"{at}/delta")
        names = self.spark.createDataFrame([(c["batch"],) for c in log if c["batch"] is not None], "batch string")
        if log and log[0]["batch"] is None:
            names = names.union(self._rows(log[:1], "names", "batch string"))
        names.write.parquet(f"{at}/names")
        return self._claim(number + 1, {"batch": None, "attempt": attempt})

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` (op, doc_id, source, lang, text) as ``batch``; False if it was committed before.

        op is insert, revise or delete; other values are an error.  Inserts of one id add up, as
        do those of rows without an id, which are one document.  A delete or revision takes away
        all that stood of the id before the batch, once, however often the batch names it; a
        delete of an id that has nothing changes nothing.  A null source or language is a group
        of its own; a null text has no tokens.  An empty batch is committed and changes nothing.
        Texts are counted once, also if other batches are committed meanwhile.
        """
        number, log = self._log()
        if self._known(log, batch):
            return False
        attempt = uuid.uuid4().hex
        changes = pick(changes, op="string", doc_id="long", source="string", lang="string", text="string")
        known = F.when(F.col("op").isin("insert", "revise", "delete"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
        changes = changes.withColumn("op", known)
        at = f"{self.folder}/attempts/{attempt}"
        counted(changes.where("op <> 'delete'"), self.counters).select(*COLUMNS).write.parquet(f"{at}/added")
        ids = changes.where("op <> 'insert'").select(F.col("doc_id").isNotNull().alias("nn"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")).distinct()
        ids.write.parquet(f"{at}/ids")
        added = self.spark.read.schema(LEDGER).parquet(f"{at}/added")
        ids = self.spark.read.schema("nn boolean, id long").parquet(f"{at}/ids")
        while True:
            gone = self._ledger(log).join(ids, ["nn", "id"], "left_semi").withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})
            added.select(*COLUMNS).union(gone.select(*COLUMNS)).write.mode("overwrite").parquet(f"{at}/ledger")
            signed = self.spark.read.schema(LEDGER).parquet(f"{at}/ledger")
            signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{at}/delta")
            if self._claim(number + 1, {"batch": batch, "attempt": attempt}):
                break
            number, log = self._log()
            if self._known(log, batch):
                return False
        if len(log) >= self.every:
            self.compact()
        return True


def totals(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Totals of ``docs`` after three batches, each sent twice: one inserts every row; one
    revises, to its text said twice and in the source "revised", the documents whose crc32 of
    the id as text is 3 modulo 10; one deletes those whose crc32 is 7.  Null ids are neither
    revised nor deleted; rows of one id are revised and deleted together.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    rollup = Rollup(docs.sparkSession, scratch.path("rollup"), tokenizers(folder))
    rows = pick(docs, doc_id="long", source="string", lang="string", text="string")
    text, source, lang, share = F.col("text"), F.col("source"), F.col("lang"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    of = lambda op, *columns: rows.select(F.lit(op).alias("op"), "doc_id", *columns)
    nothing = F.lit(None).cast("string")
    batches = {
        "inserts": of("insert", source, lang, text),
        "revisions": of("revise", F.lit("revised").alias("source"), lang, F.concat_ws(" ", text, text).alias("text")).where(share == 3),
        "deletes": of("delete", nothing.alias("source"), nothing.alias("lang"), nothing.alias("text")).where(share == 7),
    }
    for name, batch in batches.items():
        for _ in range(2):
            rollup.apply(name, batch)
    return rollup.totals()
