"""Values on the driver: constant expressions and what a column takes."""

from __future__ import annotations

import math

from ..errors import ExecError
from ..plans.ast import Expr, Literal, Ref, Unary
from ..plans.tokens import MAX_INT

MIN_INT = -MAX_INT - 1
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")


def type_of(v) -> str:
    if v is None:
        return "null"
    return {bool: "bool", int: "int", float: "float", str: "text", bytes: "bytes"}[type(v)]


def _ranked(f: float) -> tuple:
    """Total order of floats: -0.0 before 0.0, NaN of either sign last, as in Spark."""
    if math.isnan(f):
        return 2, 0.0, 0
    return 0, f, math.copysign(1, f)


def compare(a, b) -> int:
    """Order of two values that aren't null."""
    kinds = type_of(a), type_of(b)
    if "float" in kinds and set(kinds) <= {"int", "float"}:
        a, b = _ranked(float(a)), _ranked(float(b))
    elif kinds[0] != kinds[1]:
        raise ExecError(f"cannot compare a {kinds[0]} to a {kinds[1]}")
    elif kinds[0] == "text":
        a, b = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
    return (a > b) - (a < b)


def arithmetic(op: str, a, b):
    if a is None or b is None:
        return None
    kinds = type_of(a), type_of(b)
    if kinds == ("int", "int"):
        if op in "/%":
            if b == 0:
                raise ExecError("division by zero")
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            found = q if op == "/" else a - q * b
            if a == MIN_INT and b == -1:
                raise ExecError("integer overflow")
        else:
            found = a + b if op == "+" else a - b if op == "-" else a * b
        if not MIN_INT <= found <= MAX_INT:
            raise ExecError("integer overflow")
        return found
    if set(kinds) <= {"int", "float"}:
        a, b = float(a), float(b)
        if op in "/%" and b == 0:
            if op == "%" or a == 0 or math.isnan(a):
                return math.nan
            return math.copysign(math.inf, a) * math.copysign(1, b)
        if op == "%":
            return math.nan if math.isinf(a) else math.fmod(a, b)
        try:
            return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b
        except OverflowError:
            return math.inf
    if kinds == ("text", "text") and op == "+":
        return a + b
    raise ExecError(f"cannot apply {op} to a {kinds[0]} and a {kinds[1]}")


def condition(v) -> bool:
    if v is None:
        return False
    if type(v) is not bool:
        raise ExecError(f"the condition is a {type_of(v)}, not a bool")
    return v


def evaluate(e: Expr, row: dict | None = None):
    """The value of an expression; ``row`` has the columns, none for a constant one."""
    if isinstance(e, Literal):
        return e.value
    if isinstance(e, Ref):
        if row is None or str(e) not in row:
            raise ExecError(f"unknown column '{e}'")
        return row[str(e)]
    if isinstance(e, Unary):
        v = evaluate(e.of, row)
        if v is None:
            return None
        if e.op == "not":
            if type(v) is not bool:
                raise ExecError(f"'not' wants a bool, got a {type_of(v)}")
            return not v
        if type_of(v) not in ("int", "float"):
            raise ExecError(f"cannot negate a {type_of(v)}")
        return arithmetic("-", 0, v) if type(v) is int else -v
    if e.op in ("and", "or"):
        left = condition(evaluate(e.left, row))
        return left if left == (e.op == "or") else condition(evaluate(e.right, row))
    a, b = evaluate(e.left, row), evaluate(e.right, row)
    if e.op not in COMPARISONS:
        return arithmetic(e.op, a, b)
    if a is None or b is None:
        return (a is None and b is None) == (e.op == "=") if e.op in ("=", "!=") else False
    order = compare(a, b)
    return {"=": order == 0, "!=": order != 0, "<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[e.op]


def fitting(v, kind: str, nullable: bool):
    """The value as a column of that type takes it."""
    if v is None:
        if not nullable:
            raise ExecError("null in a column that is not @null")
        return None
    own = type_of(v)
    if own == kind:
        return v
    if (own, kind) == ("int", "float"):
        return float(v)
    raise ExecError(f"a {own} value does not fit into a column of type {kind}")


