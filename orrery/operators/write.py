"""Rows put, set and deleted: each statement gives a table's new list of snapshots."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..errors import ExecError, PlanError
from ..functions.lower import Lowering, fit, held_to, identity
from ..functions.values import evaluate, fitting
from ..plans import pretty
from ..plans.access import access
from ..plans.ast import Del, Put, Set
from ..store import Store, Table
from .query import Scope, check, filtered, inner

TYPES = {"int": T.LongType(), "float": T.DoubleType(), "text": T.StringType(), "bytes": T.BinaryType(), "bool": T.BooleanType()}


def schema(table: Table) -> T.StructType:
    return T.StructType([T.StructField(c.name, TYPES[c.type], True) for c in table.columns])


#: Bytes of files up to which a table's rows are held by the driver.
SMALL = 2 << 20
ARROW = {"int": pa.int64(), "float": pa.float64(), "text": pa.string(), "bytes": pa.binary(), "bool": pa.bool_()}


def small(store: Store, table: Table) -> pa.Table | None:
    """The rows of a table of at most ``SMALL`` bytes, None if it is larger.  Snapshots never
    change, so each is read once."""
    kinds, rows, size = pa.schema([(c.name, ARROW[c.type]) for c in table.columns]), [], 0
    for part in table.parts:
        if part not in store.sizes:
            store.sizes[part] = store.part_bytes(part)
        size += store.sizes[part]
        if size > SMALL:
            return None
    for part in table.parts:
        if part not in store.held:
            store.held[part] = pq.read_table(store.part_folder(part))
            while len(store.held) > 1 and sum(t.nbytes for t in store.held.values()) > HELD:
                store.held.popitem(last=False)
        store.held.move_to_end(part)
        rows.append(store.held[part].select(kinds.names).cast(kinds))
    return pa.concat_tables(rows) if rows else kinds.empty_table()


#: Bytes of small snapshots that are held, and relations of small tables.
HELD, RELATIONS = 64 << 20, 32


def read(spark: SparkSession, store: Store, table: Table, fresh: bool = False) -> DataFrame:
    """A table's rows: a relation of the driver if they are few, which Catalyst filters without a
    job and broadcasts by its size, or else the files.  ``fresh`` reads the files in any case."""
    if not table.parts:
        return spark.createDataFrame([], schema(table))
    if not fresh:
        key = id(spark), table.columns, table.parts
        if key in store.relations:
            return store.relations[key]
        if (rows := small(store, table)) is not None:
            found = store.relations[key] = spark.createDataFrame(rows, schema(table))
            while len(store.relations) > RELATIONS:
                store.relations.popitem(last=False)
            return found
    return spark.read.schema(schema(table)).parquet(*[store.part_path(p) for p in table.parts])


def _write(df: DataFrame, store: Store, table: Table) -> str:
    """A snapshot.  Row groups have Bloom filters of the key and of every indexed column, by which
    a scan for one value skips those that don't hold it: that is what an index is here."""
    name, path = store.new_part()
    writer = df.write.option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in table.columns:
        if (c.key or c.index) and c.type in ("int", "text", "bytes"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c.name}", "true")
    writer.parquet(path)
    return name


def indexed(spark: SparkSession, store: Store, table: Table) -> Table:
    """The table with snapshots that were written with its present indexes."""
    if not table.parts or small(store, table) is not None:
        return table
    return Table(table.name, table.columns, (_write(read(spark, store, table), store, table),))


def _duplicate(key: tuple, table: Table) -> ExecError:
    return ExecError(f"duplicate key ({', '.join(map(pretty.value, key))}) in table '{table.name}'")


def put_rows(spark: SparkSession, store: Store, table: Table, put: Put) -> tuple[Table, int]:
    """Rows of constant expressions; the first row in order that can't be put is the error."""
    names, rows = [c.name for c in table.columns], []
    for row in put.rows:
        given: dict[str, object] = {}
        for name, e in row:
            c = table.column(name)
            if c is None:
                raise PlanError(f"table '{table.name}' has no column '{name}'")
            if name in given:
                raise PlanError(f"column '{name}' appears twice in this row")
            try:
                given[name] = fitting(evaluate(e), c.type, c.nullable)
            except ExecError as x:
                raise ExecError(f"column '{name}': {x}" if _is_misfit(str(x)) else str(x)) from None
        for c in table.columns:
            if c.name not in given:
                if c.default is not None:
                    given[c.name] = fitting(c.default.value, c.type, c.nullable)
                elif c.nullable:
                    given[c.name] = None
                else:
                    raise ExecError(f"column '{c.name}' is missing and has no default")
        rows.append(tuple(given[n] for n in names))
    at = [names.index(c.name) for c in table.keys]
    keys = [tuple(r[i] for i in at) for r in rows]
    seen = _existing(spark, store, table, keys) if table.parts else set()
    for key in map(_comparable, keys):
        if key in seen:
            raise _duplicate(keys[[_comparable(k) for k in keys].index(key)], table)
        seen.add(key)
    kinds = pa.schema([(c.name, ARROW[c.type]) for c in table.columns])
    part = store.write_part(pa.Table.from_arrays([pa.array([r[i] for r in rows], k.type) for i, k in enumerate(kinds)], schema=kinds))
    return Table(table.name, table.columns, (*table.parts, part)), len(rows)


def _is_misfit(message: str) -> bool:
    return "does not fit into a column" in message or message == "null in a column that is not @null"


def _comparable(key: tuple) -> tuple:
    return tuple(bytes(v) if isinstance(v, (bytes, bytearray)) else repr(v) if isinstance(v, float) else v for v in key)


def _existing(spark: SparkSession, store: Store, table: Table, keys: list[tuple]) -> set[tuple]:
    """Those of a statement's keys that the table holds; the first key column is pushed into the scan."""
    if (held := small(store, table)) is not None:
        return set(map(_comparable, zip(*(held.column(c.name).to_pylist() for c in table.keys), strict=True)))
    first = table.keys[0]
    values = list({_comparable(k)[:1]: k[0] for k in keys}.values())
    df = read(spark, store, table).where(F.col(first.name).isin([bytearray(v) if isinstance(v, bytes) else v for v in values]))
    if len(table.keys) > 1:
        wanted = spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in k) for k in keys], T.StructType([T.StructField(c.name, TYPES[c.type]) for c in table.keys]))
        df = df.join(F.broadcast(wanted), [c.name for c in table.keys], "left_semi")
    return {_comparable(tuple(r)) for r in df.select(*[c.name for c in table.keys]).collect()}


def put_frame(spark: SparkSession, store: Store, table: Table, df: DataFrame) -> tuple[Table, int]:
    """All rows of a DataFrame: they are written once, checked where they are, then published."""
    part, fresh = _staged(spark, store, table, df)
    if table.parts:
        own, keys = identity(table.keys), [c.name for c in table.keys]
        mine, theirs = fresh.select(*own), read(spark, store, table).select(*own)
        if (bad := mine.join(theirs, mine.columns, "left_semi").select(*keys).orderBy(*keys).first()) is not None:
            raise _duplicate(tuple(bad), table)
    return Table(table.name, table.columns, (*table.parts, part)), fresh.count()


def upsert_frame(spark: SparkSession, store: Store, table: Table, df: DataFrame) -> tuple[Table, int]:
    """All rows of a DataFrame, in the place of those of the same keys; files without one stay."""
    part, fresh = _staged(spark, store, table, df)
    parts = (part,)
    if table.parts:
        own = identity(table.keys)
        new = fresh.select(*own).toDF(*[f"new {i}" for i in range(len(own))])
        same = F.lit(True)
        for i, x in enumerate(own):
            same = same & (x == F.col(f"`new {i}`"))
        kept, old, n = _files(spark, store, table, lambda rows: rows.join(new, same, "left_semi"), lambda c: c)
        parts = (*kept, _write(old.join(new, same, "left_anti"), store, table), part) if n else (*table.parts, part)
    return Table(table.name, table.columns, parts), fresh.count()


def _staged(spark: SparkSession, store: Store, table: Table, df: DataFrame) -> tuple[str, DataFrame]:
    """The rows of ``df`` as the table takes them, written; no two of them have one key."""
    for name in df.columns:
        if table.column(name) is None:
            raise PlanError(f"table '{table.name}' has no column '{name}'")
    columns = []
    for c in table.columns:
        if c.name in df.columns:
            column = F.col(c.name).cast(TYPES[c.type])
        elif c.default is not None:
            value = fitting(c.default.value, c.type, c.nullable)
            column = F.lit(bytearray(value) if isinstance(value, bytes) else value).cast(TYPES[c.type])
        elif c.nullable:
            column = F.lit(None).cast(TYPES[c.type])
        else:
            raise ExecError(f"column '{c.name}' is missing and has no default")
        if not c.nullable:
            column = F.when(column.isNull(), F.raise_error(F.lit(f"column '{c.name}': null in a column that is not @null"))).otherwise(column)
        columns.append(column.alias(c.name))
    keys = [c.name for c in table.keys]
    # in the order of the keys within each file, so that a lookup skips row groups
    part = _write(df.select(*columns).sortWithinPartitions(*keys), store, table)
    added = Table(table.name, table.columns, (part,))
    fresh = read(spark, store, added)
    twice = fresh.groupBy(*identity(table.keys)).count().where("count > 1").select(*keys)
    if (bad := twice.orderBy(*keys).first()) is not None:
        raise _duplicate(tuple(bad), table)
    return part, fresh


def set_rows(spark: SparkSession, store: Store, table: Table, s: Set) -> tuple[Table, int]:
    """Every assignment reads the old row; other rows of the same files are carried over as they are."""
    scope = Scope([table], set())
    check(scope, s.where)
    assign = {}
    for name, e in s.assign:
        c = table.column(name)
        if c is None:
            raise PlanError(f"table '{table.name}' has no column '{name}'")
        if c.key:
            raise PlanError(f"cannot set key column '{name}' (comes with row moves in phase 3)")
        check(scope, e)
        assign[name] = e
    kept, df, n = _matched(spark, store, table, scope, s.where)
    if not n:
        return table, 0
    lowering = Lowering(scope.lowered)
    columns = []
    for c in table.columns:
        old = F.col(inner(table, c.name))
        new = fit(lowering.value(assign[c.name]), c.type, c.nullable, c.name) if c.name in assign else old
        columns.append((F.when(F.col("_hit"), new).otherwise(old) if c.name in assign else old).alias(c.name))
    return Table(table.name, table.columns, (*kept, _write(df.select(*columns), store, table))), n


def del_rows(spark: SparkSession, store: Store, table: Table, d: Del) -> tuple[Table, int]:
    scope = Scope([table], set())
    check(scope, d.where)
    kept, df, n = _matched(spark, store, table, scope, d.where)
    if not n:
        return table, 0
    left = df.where(~F.col("_hit")).select(*[F.col(inner(table, c.name)).alias(c.name) for c in table.columns])
    return Table(table.name, table.columns, (*kept, _write(left, store, table))), n


def _files(spark: SparkSession, store: Store, table: Table, matching, name) -> tuple[tuple[str, ...], DataFrame, int]:
    """The snapshots and files that hold no row of ``matching``, the rows of the others, and how
    many match.  Columns are named by ``name``.  Filters, statistics and Bloom filters keep the
    search to the row groups that may hold one."""
    renamed = lambda df, *more: df.select(*[F.col(c.name).alias(name(c.name)) for c in table.columns], *more)
    if not table.parts or small(store, table) is not None:
        rows = renamed(read(spark, store, table))
        return (), rows, matching(rows).count()
    files = lambda parts: spark.read.schema(schema(table)).parquet(*map(store.part_path, parts))
    found = matching(renamed(files(table.parts), F.col("_metadata.file_path").alias("_file"))).groupBy("_file").agg(F.count("*").alias("n")).collect()
    touched, kept = {store.part_of(r["_file"]) for r in found}, []
    for part in table.parts:
        own = store.part_files(part)
        rest = [f for f in own if f not in touched]
        kept += [part] if len(rest) == len(own) else rest
    return tuple(kept), renamed(files(sorted(touched))) if touched else None, sum(r["n"] for r in found)


def _matched(spark: SparkSession, store: Store, table: Table, scope: Scope, where) -> tuple[tuple[str, ...], DataFrame, int]:
    """What holds no row that is hit, the rows of the rest with _hit, and how many are hit."""
    kept, df, n = _files(spark, store, table, lambda rows: filtered(rows, scope, table, where), lambda c: inner(table, c))
    if not n:
        return kept, df, 0
    path, lowering, hit = access(table, where), Lowering(scope.lowered), F.lit(True)
    for column, v in path.values:
        hit = hit & F.coalesce(held_to(F.col(inner(table, column)), table.column(column).type, v), F.lit(False))
    if path.rest is not None:
        hit = F.when(hit, F.coalesce(lowering.truth(path.rest).column, F.lit(False))).otherwise(F.lit(False))
    return kept, df.withColumn("_hit", hit), n
