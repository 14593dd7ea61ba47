"""Import of SQLite files: a survey of what is stored, a plan, and one write for each table."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import EngineError
from ..plans.ast import Column, CreateTable, Literal
from ..plans.pretty import value as shown_value
from .sqlite_file import EXACT, SqliteFile, connect, quoted, without_rowid


def affinity(declared: str | None) -> str:
    """The storage affinity of a declared type, by the first part that it contains."""
    up = (declared or "").upper()
    if "INT" in up:
        return "integer"
    if any(x in up for x in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if "BLOB" in up or not up:
        return "blob"
    return "real" if any(x in up for x in ("REAL", "FLOA", "DOUB")) else "numeric"


@dataclass
class Counts:
    nulls: int = 0
    ints: int = 0
    reals: int = 0
    texts: int = 0
    blobs: int = 0
    max_int: int = 0
    longest: int = 0


def decide(c: Counts, of: str, strict: bool = False) -> tuple[str, list[str], list[str]]:
    """(type, notes, problems) of a column from what it holds and its affinity."""
    classes = {n for n in ("ints", "reals", "texts", "blobs") if getattr(c, n)}
    wide = lambda kind, what: (kind, [] if strict else [what], [what] if strict else [])
    if not classes:
        kind = {"integer": "int", "numeric": "int", "real": "float", "text": "text", "blob": "bytes"}[of]
        return kind, [f"holds no values; {kind} follows from its declaration"], []
    if len(classes) == 1:
        return {"ints": "int", "reals": "float", "texts": "text", "blobs": "bytes"}[classes.pop()], [], []
    if classes == {"ints", "reals"}:
        if c.max_int > EXACT:
            return "float", [], [f"holds integers too large for a float (up to {c.max_int})"]
        return wide("float", "integers are widened to float")
    return wide("bytes", "mixed values are kept as bytes") if "blobs" in classes else wide("text", "mixed values are kept as text")


def names_for(names: list[str]) -> list[str]:
    """Names that fit the catalog, distinct without regard to case."""
    out, seen = [], set()
    for name in names:
        base = re.sub(r"[^A-Za-z0-9_]", "_", name) or "_"
        base = f"_{base}" if base[0].isdigit() else base
        base = f"{base}_" if base.lower() in ("not", "and", "or") else base
        found, n = base, 2
        while found.lower() in seen:
            found, n = f"{base}_{n}", n + 1
        seen.add(found.lower())
        out.append(found)
    return out


def default_of(text: str | None, kind: str) -> tuple[Literal | None, str | None]:
    """A declared default as a literal of the column's type, or why it is left out."""
    if text is None or text.strip().upper() == "NULL":
        return None, None
    t = text.strip()
    found = None
    if re.fullmatch(r"[+-]?[0-9]+", t):
        found = int(t)
    elif re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", t):
        found = float(t)
    elif re.fullmatch(r"'(?:[^']|'')*'", t):
        found = t[1:-1].replace("''", "'")
    elif re.fullmatch(r"[xX]'(?:[0-9a-fA-F]{2})*'", t):
        found = bytes.fromhex(t[2:-1])
    own = {int: "int", float: "float", str: "text", bytes: "bytes"}.get(type(found))
    if (own, kind) == ("int", "float"):
        return Literal(float(found)), None
    return (Literal(found), None) if own == kind else (None, f"default {t} is left out")


@dataclass
class TablePlan:
    source: str
    table: str
    columns: list[Column]
    reads: list[tuple[str, str]]
    rows: int
    notes: list[str] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)

    def report(self) -> list[str]:
        lines = [f"table '{self.source}' -> {self.table}, {self.rows} rows"]
        for c, (source, _) in zip(self.columns, self.reads, strict=True):
            flags = "".join(f" @{n}" for n, on in (("key", c.key), ("index", c.index), ("null", c.nullable)) if on)
            lines.append(f"  {source} -> {c.name}: {c.type}{flags}{f' = {shown_value(c.default.value)}' if c.default else ''}")
        return lines + [f"  note: {n}" for n in self.notes] + [f"  problem: {p}" for p in self.problems]


def _source(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    # Spark registers a data source with the active session, whichever is asked
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
    spark.dataSource.register(SqliteFile)
    reader = spark.read.format("sqlite_file").option("path", path).option("table", table)
    for k, v in options.items():
        reader = reader.option(k, json.dumps(v))
    return reader.load()


def _declared(con, table: str) -> list[tuple]:
    """(name, declared type, not null, default, place in the key, hidden) of each column."""
    return [r[1:] for r in con.execute(f"PRAGMA table_xinfo({quoted(table)})")]


def survey(spark: SparkSession, path: str, table: str) -> DataFrame:
    """What each column of a table holds: one pass, counted where it is read."""
    with connect(path) as con:
        columns = [(r[0], affinity(r[1])) for r in _declared(con, table) if r[5] != 2]
    sums = [F.sum(c).alias(c) for c in ("nulls", "ints", "reals", "texts", "blobs")]
    return _source(spark, path, table, columns=columns).groupBy("column").agg(*sums, F.max("max_int").alias("max_int"), F.max("longest").alias("longest"))


def _alias(con, table: str, declared: list[tuple]) -> str | None:
    """The column that is the rowid: a single key column declared INTEGER and stored as the rowid."""
    keys = [r for r in declared if r[4]]
    if len(keys) != 1 or (keys[0][1] or "").upper() != "INTEGER" or without_rowid(con, table):
        return None
    indexed = any(r[3] == "pk" for r in con.execute(f"PRAGMA index_list({quoted(table)})"))
    return None if indexed else keys[0][0]


def plan(spark: SparkSession, path: str, strict: bool = False) -> list[TablePlan]:
    """Plans of all tables of a file; views, triggers and SQLite's own tables are left out."""
    with connect(path) as con:
        tables = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY rowid")]
        skipped = [f"{t} '{n}' is not carried over" for t, n in con.execute("SELECT type, name FROM sqlite_master WHERE type IN ('view', 'trigger') ORDER BY rowid")]
    out = []
    for table, name in zip(tables, names_for(tables), strict=True):
        counts = {r["column"]: Counts(*[r[k] for k in ("nulls", "ints", "reals", "texts", "blobs", "max_int", "longest")]) for r in survey(spark, path, table).collect()}
        with connect(path) as con:
            declared = _declared(con, table)
            rows = con.execute(f"SELECT count(*) FROM {quoted(table)}").fetchone()[0]
            alias, no_rowid = _alias(con, table, declared), without_rowid(con, table)
            indexes = con.execute(f"PRAGMA index_list({quoted(table)})").fetchall()
            single = {}
            notes, problems = list(skipped) if not out else [], []
            for _, index, unique, origin, partial in (r[:5] for r in indexes):
                parts = [r[2] for r in con.execute(f"PRAGMA index_info({quoted(index)})")]
                if origin == "c" and not partial and len(parts) == 1 and parts[0] is not None:
                    single[parts[0]] = index
                elif origin == "c":
                    notes.append(f"index '{index}' is not carried over (one plain column is)")
                if unique and origin in ("c", "u"):
                    notes.append(f"unique constraint '{index}' is not carried over")
            text = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\[[^\]]*\]|`[^`]*`|--[^\n]*|/\*.*?\*/", "''", con.execute("SELECT sql FROM sqlite_master WHERE name = ? AND type = 'table'", (table,)).fetchone()[0], flags=re.S)
            if n := len(re.findall(r"\bCHECK\s*\(", text, re.I)):
                notes.append(f"{n} check constraint{'s are' if n > 1 else ' is'} not carried over; rows that would fail can be written")
            for name in sorted({x.upper() for x in re.findall(r"\bCOLLATE\s+(\w+)", text, re.I)} - {"BINARY"}):
                notes.append(f"collation {name} is not carried over; texts are compared byte by byte")
            if con.execute(f"PRAGMA foreign_key_list({quoted(table)})").fetchone():
                notes.append("foreign keys are not carried over")
        stored = [r for r in declared if r[5] != 2]
        notes += [f"column '{r[0]}' is computed and not carried over" for r in declared if r[5] == 2]
        keys = [alias] if alias else [r[0] for r in sorted((r for r in stored if r[4]), key=lambda r: r[4])]
        why = "no key is declared"
        if not alias and (empty := [k for k in keys if counts.get(k, Counts()).nulls]):
            keys, why = [], f"its key column '{empty[0]}' holds nulls"
        elif not alias and (computed := [r[0] for r in declared if r[4] and r[5] == 2]):
            keys, why = [], f"its key column '{computed[0]}' is computed"
        add_rowid = not keys
        if add_rowid and no_rowid:
            problems.append(f"{why}, and it has no rowid")
        names = names_for((["rowid"] if add_rowid else []) + [r[0] for r in stored])
        columns, reads = [], []
        if add_rowid:
            columns.append(Column(names[0], "int", key=True))
            reads.append(("rowid", "int"))
            notes.append(f"a rowid key is added: {why}")
        for r, column in zip(stored, names[len(columns) :], strict=True):
            c = counts.get(r[0], Counts())
            kind, more, bad = decide(c, affinity(r[1]), strict)
            notes += [f"column '{r[0]}' {n}" for n in more]
            problems += [f"column '{r[0]}' {p}" for p in bad]
            default, why = default_of(r[3], kind)
            if why:
                notes.append(f"column '{r[0]}': {why}")
            key = r[0] in keys
            columns.append(Column(column, kind, nullable=not key and (c.nulls > 0 or not r[2] and not rows), key=key, index=r[0] in single and not key, default=default))
            reads.append((r[0], kind))
        out.append(TablePlan(table, name, columns, reads, rows, notes, problems))
    return out


def import_file(db, path: str, strict: bool = False, dry_run: bool = False) -> list[str]:
    """Import every table of a file into ``db``, one commit each; returns the report.

    Nothing is written if the plan has a problem.  A table's rows are read in ranges by the
    executors, converted to the planned types and counted against the plan.
    """
    spark = db.session.spark
    plans = plan(spark, path, strict)
    report = [line for p in plans for line in p.report()]
    problems = [f"table '{p.source}': {x}" for p in plans for x in p.problems]
    if dry_run:
        return report
    if problems:
        raise EngineError("; ".join(problems))
    for p in plans:
        with db.transaction():
            db.session.run(CreateTable(p.table, tuple(p.columns)))
            rows = _source(spark, path, p.source, plan=p.reads).toDF(*[c.name for c in p.columns])
            n = db.insert_all(p.table, rows)
            if n != p.rows:
                raise EngineError(f"table '{p.source}' has {p.rows} rows, of which {n} were read")
    return report
