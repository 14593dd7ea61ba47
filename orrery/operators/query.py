"""A ``get`` as one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import PlanError
from ..functions.lower import SPARK, Lowered, Lowering, float_equal, held_to, negative_zero
from ..plans.access import access, conjuncts
from ..plans.ast import Expr, Get, Ref
from ..store import Table


@dataclass
class Scope:
    """Tables in the order of their joins; columns are named ``table__column`` inside a plan."""

    tables: list[Table]
    padded: set[str]
    times: dict[str, str] = field(default_factory=dict)  # columns that hold the timestamps of shown ones, with their types

    def names(self) -> str:
        return " or ".join(t.name for t in self.tables)

    def find(self, ref: Ref) -> tuple[Table, object]:
        if ref.table is not None:
            table = next((t for t in self.tables if t.name == ref.table), None)
            if table is None:
                raise PlanError(f"no table named '{ref.table}' in this statement")
            if (c := table.column(ref.column)) is None:
                raise PlanError(f"table '{table.name}' has no column '{ref.column}'")
            return table, c
        found = [(t, c) for t in self.tables if (c := t.column(ref.column)) is not None]
        if not found:
            if len(self.tables) == 1:
                raise PlanError(f"table '{self.tables[0].name}' has no column '{ref.column}'")
            raise PlanError(f"no table in this statement has a column '{ref.column}'")
        if len(found) > 1:
            spelled = " or ".join(f"{t.name}.{ref.column}" for t, _ in found)
            raise PlanError(f"column '{ref.column}' is ambiguous here; qualify it ({spelled})")
        return found[0]

    def lowered(self, ref: Ref) -> Lowered:
        table, c = self.find(ref)
        name = inner(table, c.name)
        at = (F.col(name + TIME), self.times[name + TIME]) if name + TIME in self.times else None
        return Lowered(F.col(name), c.type, c.nullable or table.name in self.padded, at=at)


#: End of the names of columns that hold a shown timestamp itself.
TIME = "__at"


def inner(table: Table, column: str) -> str:
    return f"{table.name}__{column}"


def check(scope: Scope, e: Expr | None) -> None:
    """Every column of an expression is known, whether or not a row is ever read."""
    if isinstance(e, Ref):
        scope.find(e)
    else:
        for child in (getattr(e, name, None) for name in ("left", "right", "of")):
            if child is not None:
                check(scope, child)


@dataclass
class Query:
    """A query's rows and the order in which they are shown."""

    df: DataFrame
    names: list[str]
    columns: list[str]  # of df, one for each name
    order: list

    def rows(self) -> DataFrame:
        """Columns by their names, in no order."""
        return self.df.select(*[F.col(c) for c in self.columns]).toDF(*self.names)

    def ordered(self) -> DataFrame:
        df = self.df.orderBy(*self.order) if self.order else self.df
        return df.select(*[F.col(c) for c in self.columns]).toDF(*self.names)


def filtered(df: DataFrame, scope: Scope, table: Table, where: Expr | None) -> DataFrame:
    """``where`` over one table: what its access path holds fast first, then the rest."""
    path = access(table, where)
    lowering = Lowering(scope.lowered)
    for column, v in path.values:
        df = df.where(held_to(F.col(inner(table, column)), table.column(column).type, v))
    for part in [path.rest] if path.rest is not None and _any_raises(lowering, path.rest) else conjuncts(path.rest):
        df = df.where(lowering.truth(part).column)
    return df


def _any_raises(lowering: Lowering, e: Expr) -> bool:
    return lowering.truth(e).raises


def lookup(spark: SparkSession, table: Table, read: Callable[[Table], DataFrame], values: DataFrame | list, column: str | None) -> DataFrame:
    """Rows of ``table`` whose key or ``column`` is among ``values``: one join, of which Catalyst
    broadcasts the values if they are few."""
    if column is not None and table.column(column) is None:
        raise PlanError(f"table '{table.name}' has no column '{column}'")
    by = list(table.keys) if column is None else [table.column(column)]
    kinds = [SPARK[c.type] for c in by]
    df = read(table)
    if isinstance(values, list):
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        first = [r[0] for r in rows if r[0] is not None and r[0] == r[0]]
        if first:  # bounds by which a scan skips row groups
            least, most = (F.lit(bytearray(v) if isinstance(v, bytes) else v).cast(kinds[0]) for v in (min(first), max(first)))
            df = df.where(F.col(by[0].name).between(least, most))
        values = spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], ", ".join(f"v{i} {k}" for i, k in enumerate(kinds)))
    wanted = values.toDF(*[f"v{i}" for i in range(len(by))]).distinct().select(*[F.col(f"v{i}").cast(k).alias(f"v{i}") for i, k in enumerate(kinds)])
    on = F.lit(True)
    for i, c in enumerate(by):
        x, y = F.col(f"t.{c.name}"), F.col(f"w.v{i}")
        on = on & (float_equal(x, y, False) if c.type == "float" else x == y)
    return df.alias("t").join(wanted.alias("w"), on, "left_semi").select(*[F.col(f"t.{c.name}") for c in table.columns])


def key_range(table: Table, read: Callable[[Table], DataFrame], start: tuple | None, end: tuple | None) -> DataFrame:
    """Rows of keys in [start, end), in the order of the key."""

    def below(bound: tuple):
        """Whether a key comes before ``bound``; its first column and where that is bounded."""
        parts, equal = [], F.lit(True)
        for c, v in zip(table.keys, bound, strict=False):
            x, y = F.col(c.name), F.lit(bytearray(v) if isinstance(v, bytes) else v).cast(SPARK[c.type])
            less = (x < y) | ((x == y) & negative_zero(x) & ~negative_zero(y)) if c.type == "float" else x < y
            parts.append(equal & less)
            equal = equal & held_to(x, c.type, v)
        out = F.lit(False)
        for p in parts:
            out = out | p
        first = table.keys[0]
        edge = F.lit(bytearray(bound[0]) if isinstance(bound[0], bytes) else bound[0]).cast(SPARK[first.type])
        return out, F.col(first.name), edge

    df = read(table)
    if start:
        out, x, edge = below(start)
        df = df.where((x >= edge) & ~out)  # the first condition is what the scan uses
    if end:
        out, x, edge = below(end)
        df = df.where((x <= edge) & out)
    order = [o for c in table.keys for o in (F.col(c.name), *([~negative_zero(F.col(c.name))] if c.type == "float" else []))]
    return df.select(*[c.name for c in table.columns]).orderBy(*order)


def build(get: Get, table_of: Callable[[str], Table], read: Callable[[Table], DataFrame]) -> Query:
    base = table_of(get.table)
    scope = Scope([base], set())

    times: dict[str, str] = {}

    def scan(table: Table) -> DataFrame:
        df = read(table)
        hidden = {c: t for c, t in df.dtypes if c.endswith(TIME) and table.column(c) is None}
        times.update({inner(table, c): t for c, t in hidden.items()})
        return df.select(*[F.col(c).alias(inner(table, c)) for c in (*(c.name for c in table.columns), *hidden)])

    if get.joins:
        tables = [base]
        for j in get.joins:
            if any(t.name == j.table for t in tables):
                raise PlanError(f"table '{j.table}' appears twice in this statement; table aliases are not supported yet")
            tables.append(table_of(j.table))
        for i, j in enumerate(get.joins):
            check(Scope(tables[: i + 2], set()), j.on)
        check(Scope(tables, set()), get.where)
        df = scan(base)
        for j, right in zip(get.joins, tables[1:], strict=True):
            scope = Scope([*scope.tables, right], set(scope.padded))
            right_rows = scan(right)
            scope.times = times
            df = df.join(right_rows, Lowering(scope.lowered).truth(j.on).column, "left" if j.left else "inner")
            if j.left:
                scope.padded.add(right.name)
        if get.where is not None:
            df = df.where(Lowering(scope.lowered).truth(get.where).column)
    else:
        check(scope, get.where)
        rows = scan(base)
        scope.times = times
        df = filtered(rows, scope, base, get.where)
    order = []
    if get.order:
        try:
            table, c = scope.find(get.order[0])
        except PlanError:
            if get.joins:
                raise
            raise PlanError(f"cannot order by unknown column '{get.order[0].column}'") from None
        name = inner(table, c.name)
        by = [F.col(name)]
        if c.type == "float":  # -0.0 is below 0.0
            by.append(~negative_zero(F.col(name)))
        order = [x.desc_nulls_last() if get.order[1] else x.asc_nulls_first() for x in by]
    if get.joins or access(base, get.where).kind != "KeyLookup":  # a key has one row at most
        for t in scope.tables:
            for c in t.keys:
                key = F.col(inner(t, c.name))
                order += [key.asc_nulls_first(), *([(~negative_zero(key)).asc_nulls_first()] if c.type == "float" else [])]
    if get.limit is not None:
        df = (df.orderBy(*order) if order and get.limit else df).limit(get.limit)
    if get.columns is None:
        chosen = [(t, c) for t in scope.tables for c in t.columns]
    else:
        chosen = [scope.find(r) for r in get.columns]
    names = [f"{t.name}.{c.name}" if get.joins else c.name for t, c in chosen]
    return Query(df, names, [inner(t, c.name) for t, c in chosen], order)
