"""Which path a read takes, as ``explain`` tells it.

Catalyst chooses the physical plan from the same predicates; this describes what the keys and
indexes of the tables make of them, and finds constants that don't fit a key before any row is
read.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ExecError, PlanError
from ..functions.values import fitting
from ..store import Table
from . import pretty
from .ast import Binary, Del, Expr, Get, Literal, Put, Ref, Set, Statement


def conjuncts(e: Expr | None) -> list[Expr]:
    if isinstance(e, Binary) and e.op == "and":
        return conjuncts(e.left) + conjuncts(e.right)
    return [] if e is None else [e]


def joined(parts: list[Expr]) -> Expr | None:
    out = None
    for p in parts:
        out = p if out is None else Binary("and", out, p)
    return out


def equality(e: Expr, table: str) -> tuple[str, Literal] | None:
    """(column, literal) of ``column = literal``, either way round."""
    if isinstance(e, Binary) and e.op == "=":
        for a, b in ((e.left, e.right), (e.right, e.left)):
            if isinstance(a, Ref) and a.table in (None, table) and isinstance(b, Literal):
                return a.column, b
    return None


@dataclass(frozen=True)
class Access:
    kind: str  # SeqScan KeyLookup IndexScan
    values: tuple[tuple[str, object], ...]  # columns and the values they are held to
    rest: Expr | None

    def lines(self, table: str) -> list[str]:
        if self.kind == "KeyLookup":
            head = f"KeyLookup {table} ({', '.join(f'{c} = {pretty.value(v)}' for c, v in self.values)})"
        elif self.kind == "IndexScan":
            head = f"IndexScan {table} via {self.values[0][0]} = {pretty.value(self.values[0][1])}"
        else:
            head = f"SeqScan {table}"
        return over(f"Filter {_bracketed(self.rest)}", [head]) if self.rest is not None else [head]


def over(head: str, below: list[str]) -> list[str]:
    return [head, *("  " + x for x in below)]


def _bracketed(e: Expr) -> str:
    text = pretty.expression(e)
    return text if text.startswith("(") else f"({text})"


def access(table: Table, where: Expr | None) -> Access:
    parts = conjuncts(where)
    equal = [(i, *e) for i, p in enumerate(parts) if (e := equality(p, table.name))]
    used: dict[str, tuple[int, object]] = {}
    keys = [c.name for c in table.keys]
    for i, name, lit in equal:
        if name in keys and name not in used and lit.value is not None:
            used[name] = i, lit.value
    if keys and len(used) == len(keys):
        values = []
        for c in table.keys:
            try:
                values.append((c.name, fitting(used[c.name][1], c.type, False)))
            except ExecError as e:
                raise PlanError(f"key column '{c.name}': {e}") from None
        gone = {i for i, _ in used.values()}
        return Access("KeyLookup", tuple(values), joined([p for i, p in enumerate(parts) if i not in gone]))
    for i, name, lit in equal:
        c = table.column(name)
        if c is not None and c.index:
            try:
                value = fitting(lit.value, c.type, True)
            except ExecError as e:
                raise PlanError(f"column '{name}': {e}") from None
            return Access("IndexScan", ((name, value),), joined([p for j, p in enumerate(parts) if j != i]))
    return Access("SeqScan", (), where)


def _probe(on: Expr, before: list[Table], right: Table) -> tuple[str, list[str]]:
    """Name of the join's strategy and the line of its right side."""
    found = {}
    for p in conjuncts(on):
        if not (isinstance(p, Binary) and p.op == "=" and isinstance(p.left, Ref) and isinstance(p.right, Ref)):
            continue
        for mine, other in ((p.left, p.right), (p.right, p.left)):
            r = right.column(mine.column) if _belongs(mine, right, before) else None
            owner = next((t for t in before if _belongs(other, t, [x for x in [*before, right] if x is not t])), None)
            left = owner.column(other.column) if owner else None
            if r is None or left is None or not (left.type == r.type or (left.type, r.type) == ("int", "float")):
                continue
            if len(right.keys) == 1 and r.key:
                found.setdefault("key", r.name)
            elif r.index:
                found.setdefault("index", r.name)
    if "key" in found:
        return "IndexNestedLoopJoin", [f"KeyProbe {right.name} ({found['key']})"]
    if "index" in found:
        return "IndexNestedLoopJoin", [f"IndexProbe {right.name} via {found['index']}"]
    return "NestedLoopJoin", [f"SeqScan {right.name}"]


def _belongs(ref: Ref, table: Table, others: list[Table]) -> bool:
    if ref.table is not None:
        return ref.table == table.name and table.column(ref.column) is not None
    return table.column(ref.column) is not None and not any(t.column(ref.column) for t in others)


def explain(s: Statement, table_of) -> list[str]:
    if isinstance(s, Put):
        return [f"Insert {s.table} ({len(s.rows)} rows)"]
    if isinstance(s, (Set, Del)):
        return over(f"{'Update' if isinstance(s, Set) else 'Delete'} {s.table}", access(table_of(s.table), s.where).lines(s.table))
    if not isinstance(s, Get):
        raise PlanError("explain wants get, put, set or del")
    if s.joins:
        tables = [table_of(s.table)]
        lines = [f"SeqScan {s.table}"]
        for j in s.joins:
            right = table_of(j.table)
            name, line = _probe(j.on, tables, right)
            lines = over(f"{name} {'left' if j.left else 'inner'} on {_bracketed(j.on)}", lines + line)
            tables.append(right)
        if s.where is not None:
            lines = over(f"Filter {_bracketed(s.where)}", lines)
    else:
        lines = access(table_of(s.table), s.where).lines(s.table)
    if s.order:
        lines = over(f"Sort {s.order[0]} {'desc' if s.order[1] else 'asc'}", lines)
    return lines if s.limit is None else over(f"Limit {s.limit}", lines)
