"""Trees back to the native language; parsing the text gives the tree again."""

from __future__ import annotations

from .ast import CreateIndex, CreateTable, Del, DropTable, Explain, Expr, Get, Literal, Put, Ref, Set, Simple, Statement, Unary
from .tokens import quoted


def plain_float(f: float) -> str:
    """Shortest digits that read back; always with a point or an exponent."""
    text = repr(f)
    if text in ("nan", "inf", "-inf"):
        return {"nan": "NaN"}.get(text, text)
    return text.replace("e+", "e").replace("e-0", "e-").replace("e0", "e")


def value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return plain_float(v)
    if isinstance(v, str):
        return quoted(v)
    if isinstance(v, (bytes, bytearray)):
        return f'x"{bytes(v).hex()}"'
    return str(v)


def expression(e: Expr) -> str:
    if isinstance(e, Literal):
        return value(e.value)
    if isinstance(e, Ref):
        return str(e)
    if isinstance(e, Unary):
        return f"(-{expression(e.of)})" if e.op == "-" else f"(not {expression(e.of)})"
    return f"({expression(e.left)} {e.op} {expression(e.right)})"


def statement(s: Statement) -> str:
    where = f" where {expression(s.where)}" if isinstance(s, (Get, Set, Del)) and s.where is not None else ""
    if isinstance(s, Get):
        joins = "".join(f"{' left' if j.left else ''} join {j.table} on {expression(j.on)}" for j in s.joins)
        columns = f" {{ {', '.join(map(str, s.columns))} }}" if s.columns else ""
        as_of = "" if s.as_of is None else f" as of {'time ' if s.as_of[0] == 'time' else ''}{s.as_of[1]}"
        order = f" order by {s.order[0]} {'desc' if s.order[1] else 'asc'}" if s.order else ""
        limit = "" if s.limit is None else f" limit {s.limit}"
        return f"get {s.table}{joins}{columns}{as_of}{where}{order}{limit}"
    if isinstance(s, Put):
        rows = ", ".join("{ " + ", ".join(f"{c}: {expression(e)}" for c, e in row) + " }" for row in s.rows)
        return f"put {s.table} {rows}"
    if isinstance(s, Set):
        return f"set {s.table}{where} {{ {', '.join(f'{c} = {expression(e)}' for c, e in s.assign)} }}"
    if isinstance(s, Del):
        return f"del {s.table}{where}"
    if isinstance(s, CreateTable):
        flags = lambda c: "".join(f" @{f}" for f, on in (("key", c.key), ("index", c.index), ("null", c.nullable)) if on)
        columns = ", ".join(f"{c.name}: {c.type}{flags(c)}{f' = {value(c.default.value)}' if c.default else ''}" for c in s.columns)
        return f"table {s.table} {{ {columns} }}"
    if isinstance(s, DropTable):
        return f"drop table {s.table}"
    if isinstance(s, CreateIndex):
        return f"index {s.table}.{s.column}"
    if isinstance(s, Explain):
        return f"explain {statement(s.of)}"
    assert isinstance(s, Simple)
    if s.verb == "gc":
        return f"gc keep {s.number}"
    return " ".join([s.verb, *([s.name] if s.name else []), *([f"at {s.number}"] if s.number is not None else [])])


