"""SQLite files as a Spark data source, read in ranges of rowid."""

from __future__ import annotations

import json
import math
import sqlite3
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SURVEY = "column string, nulls long, ints long, reals long, texts long, blobs long, max_int long, longest long"
EXACT = 1 << 53


def connect(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.text_factory = _text
    return con


class BadText(bytes):
    """Stored text that is not UTF-8."""


def _text(b: bytes) -> str | BadText:
    try:
        return b.decode()
    except UnicodeDecodeError:
        return BadText(b)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def without_rowid(con: sqlite3.Connection, table: str) -> bool:
    try:
        con.execute(f"SELECT rowid FROM {quoted(table)} LIMIT 0")
        return False
    except sqlite3.OperationalError:
        return True


def shown(f: float) -> str:
    """A float's digits without an exponent or a needless point."""
    if math.isnan(f) or math.isinf(f):
        return "NaN" if math.isnan(f) else "inf" if f > 0 else "-inf"
    text = format(Decimal(repr(f)), "f")
    return text[:-2] if text.endswith(".0") else text


def converted(v, kind: str, where: str):
    """A stored value as the planned type."""
    if v is None:
        return None
    if isinstance(v, BadText):
        raise ValueError(f"{where}: a text is not UTF-8")
    if kind == "int" and type(v) is int:
        return v
    if kind == "float" and (type(v) is float or type(v) is int and abs(v) <= EXACT):
        return float(v)
    if kind == "text" and not isinstance(v, bytes):
        return v if isinstance(v, str) else shown(v) if isinstance(v, float) else str(v)
    if kind == "bytes":
        return v if isinstance(v, bytes) else (v if isinstance(v, str) else shown(v) if isinstance(v, float) else str(v)).encode()
    raise ValueError(f"{where}: a value of the storage class {type(v).__name__} is not in the plan ({kind})")


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options["table"]
        self.plan = json.loads(options["plan"]) if "plan" in options else None
        self.columns = json.loads(options["columns"]) if "columns" in options else []
        self.parts = int(options.get("parts", "8"))

    def partitions(self):
        with connect(self.path) as con:
            if without_rowid(con, self.table):
                return [Range(None, None)]
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(None, None)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def rows(self, part: Range, columns: list[str]):
        names = ", ".join(c if c == "rowid" else quoted(c) for c in columns)
        where = "" if part.low is None else f" WHERE rowid BETWEEN {part.low} AND {part.high}"
        with connect(self.path) as con:
            yield from con.execute(f"SELECT {names} FROM {quoted(self.table)}{where}")

    def read(self, part: Range):
        if self.plan is not None:
            for row in self.rows(part, [p[0] for p in self.plan]):
                yield tuple(converted(v, kind, f"table '{self.table}', column '{name}'") for v, (name, kind) in zip(row, self.plan, strict=True))
            return
        counts = [[0] * 7 for _ in self.columns]
        for row in self.rows(part, [c for c, _ in self.columns]):
            for c, v, (_, affinity) in zip(counts, row, self.columns, strict=True):
                kind = 0 if v is None else 1 if type(v) is int and affinity != "real" else 2 if isinstance(v, (int, float)) else 3 if isinstance(v, (str, BadText)) else 4
                c[kind] += 1
                if kind == 1:
                    c[5] = max(c[5], min(abs(v), (1 << 63) - 1))
                elif kind >= 3:
                    c[6] = max(c[6], len(v.encode()) if isinstance(v, str) else len(v))
        yield from ((name, *c) for c, (name, _) in zip(counts, self.columns, strict=True))


class SqliteFile(DataSource):
    """``plan`` (source column, type) reads rows; ``columns`` (name, affinity) counts storage classes."""

    @classmethod
    def name(cls):
        return "sqlite_file"

    def schema(self):
        if "plan" not in self.options:
            return SURVEY
        kinds = {"int": "bigint", "float": "double", "text": "string", "bytes": "binary"}
        return ", ".join(f"c{i} {kinds[kind]}" for i, (_, kind) in enumerate(json.loads(self.options["plan"])))

    def reader(self, schema: StructType):
        return _Reader(dict(self.options))
