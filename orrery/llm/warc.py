"""WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding whole WARC records, and
one skippable frame at its end: the seek table with the compressed and decompressed size of
every frame.  The index maps a record to its bundle, its frame and its place inside the
decompressed frame, so one record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .rows import pick
from .scratch import Scratch

#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Decompressed bytes from which a frame is closed, and compressed bytes from which a bundle is.
FRAME, BUNDLE = 1 << 18, 1 << 30
PREFIX = "urn:orrery:page:"
#: Headers of this operator's own: the page of a record, and the page that a revisit refers to.
PAGE, REFERS = "Orrery-Page", "Orrery-Refers-To-Page"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_type string, bundle string, frame int, frame_at long, record_at int, record_bytes int"
RECORDS = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None, single: bool = True) -> str:
    """A record's ID: the page's, or one of its own if several records have the page's or it has none."""
    return f"<{PREFIX}{page_id}>" if single and page_id is not None else f"<{uuid.uuid4().urn}>"


def _id(head: dict[str, str], name: str) -> int | None:
    return int(head[name]) if name in head else None


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, single: bool = True, single_to: bool = True) -> bytes:
    """One WARC/1.1 record; a revisit has no payload.  ``single`` and ``single_to`` tell whether
    the page, and the one referred to, have one record."""
    block = HTTP + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": _name(page_id, single),
        **({} if page_id is None else {PAGE: str(page_id)}),
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._", errors="replace"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        **({} if kind == "response" else {"WARC-Profile": REVISIT, REFERS: str(refers_to)}),
        **({"WARC-Refers-To": _name(refers_to)} if kind != "response" and single_to else {}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version!r}")
        head = dict(x.split(": ", 1) for x in lines)
        length = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError("a record is cut off")
        yield head, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + length + 4


class BundleWriter:
    """Writes records to one bundle; ``close`` appends the seek table."""

    def __init__(self, stream):
        self.stream, self.frames, self.buffer, self.at = stream, [], io.BytesIO(), 0
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, the frame's offset in the bundle, the record's offset in the frame)."""
        place = len(self.frames), self.at, self.buffer.tell()
        self.buffer.write(data)
        if self.buffer.tell() >= FRAME:
            self.flush()
        return place

    def flush(self) -> None:
        if data := self.buffer.getvalue():
            packed = self.compressor.compress(data)
            self.stream.write(packed)
            self.frames.append((len(packed), len(data)))
            self.at += len(packed)
            self.buffer = io.BytesIO()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


def _open(uri: str):
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def seek_table(stream) -> list[tuple[int, int]]:
    """(compressed, decompressed) bytes of each frame, from the bundle's end."""
    size = stream.size()
    stream.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("the bundle has no seek table of this format")
    stream.seek(size - 9 - 8 * n)
    return list(struct.iter_unpack("<II", stream.read(8 * n)))


def fetch(bundle: str, frame: int, record_at: int, record_bytes: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: reads the seek table and one frame."""
    with _open(bundle) as stream:
        sizes = seek_table(stream)
        stream.seek(sum(x for x, _ in sizes[:frame]))
        data = zstandard.ZstdDecompressor().decompress(stream.read(sizes[frame][0]), max_output_size=sizes[frame][1])
    return next(parse(data[record_at : record_at + record_bytes]))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to bundles in ``folder``, a URI
    that all executors reach; returns the index of the records.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest
    page_id is a response and the others are revisits of it; smaller ones are responses.  A null
    html is the empty payload, a null url an empty one.  A null page_id is smaller than any
    other; where all are null, or rows repeat the largest page_id, each of them is a response.
    Record IDs are unique: one page's row has the page's ID, rows that share a page_id or have
    none get IDs of their own, and revisits of a shared page_id name the page only.
    A bundle belongs to one attempt of one task: the index names only bundles of attempts that
    ended, so a lost executor leaves at most files that nothing refers to.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pick(pages, page_id="long", url="string", html="string").select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= min_bytes
    groups = keyed.where(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")
    # written first, so that the join is one of two plain exchanges, which can be split where
    # very many pages have one payload
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    groups = scratch.save(groups, "groups")
    shared = scratch.save(keyed.groupBy("page_id").agg(F.count("*").alias("rows")).where("rows > 1 and page_id is not null").select("page_id", F.lit(False).alias("single")), "shared")
    single = single_to = F.lit(True)
    if shared.limit(1).count():
        keyed = keyed.join(shared, "page_id", "left")
        groups = groups.join(shared.select(F.col("page_id").alias("keeper"), F.col("single").alias("single_to")), "keeper", "left")
        single, single_to = (F.coalesce(c, F.lit(True)) for c in ("single", "single_to"))
    refers_to = F.when(large & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    joined = keyed.join(groups, "digest", "left").select("page_id", "url", "payload", refers_to.alias("refers_to"), single.alias("single"), single_to.alias("single_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        writer, uri = None, ""
        for batch in batches:
            rows = []
            for page_id, url, body, refers_to, single, single_to in zip(*(batch.column(i) for i in range(6)), strict=True):
                page_id, refers_to = page_id.as_py(), refers_to.as_py()
                if writer is None or writer.at >= BUNDLE:
                    if writer is not None:
                        writer.close()
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer, uri = BundleWriter(store.open_output_stream(f"{path}/{name}", compression=None)), f"{folder}/{name}"
                kind = "response" if refers_to is None else "revisit"
                data = record(page_id, url.as_py(), body.as_py(), kind, refers_to, single.as_py(), single_to.as_py())
                frame, frame_at, at = writer.add(data)
                rows.append((page_id, kind, uri, frame, frame_at, at, len(data)))
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                names=["page_id", "record_type", "bundle", "frame", "frame_at", "record_at", "record_bytes"],
            )
        if writer is not None:
            writer.close()

    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return joined.mapInArrow(run, INDEX)


def read(bundles: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes) of every record of the
    bundles named by ``bundles`` (bundle); a payload that doesn't fit its digest is an error.
    A revisit has payload_bytes null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _open(uri) as stream:
                    sizes = seek_table(stream)
                    stream.seek(0)
                    for packed, whole in sizes:
                        rows = []
                        for head, payload in parse(unpack.decompress(stream.read(packed), max_output_size=whole)):
                            kind, told = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == "response" and digest(payload) != told:
                                raise ValueError(f"{head['WARC-Record-ID']}: the payload differs from its digest")
                            refers_to = _id(head, REFERS) if kind == "revisit" else None
                            rows.append((_id(head, PAGE), kind, refers_to, told, len(payload) if kind == "response" else None))
                        yield pa.record_batch(
                            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                            names=["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"],
                        )

    return bundles.select("bundle").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to bundles in the shared folder and read the bundles back: page_id,
    payload_bytes, payload_digest, record_type, refers_to, a row per row of ``pages``.
    A revisit's payload_bytes are those of the response it refers to."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    index = scratch.save(write(pages, scratch.path("bundles"), min_bytes, scratch), "index")
    names = index.select("bundle").distinct()
    records = scratch.save(read(names.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "bundle")), "records")
    scratch.keep("records")
    whole = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("bytes"))
    joined = records.join(whole, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
