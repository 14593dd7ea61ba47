"""Expressions as Spark columns with the engine's two-valued logic.

A comparison with null is false, not unknown, and null equals null.  Where only truth matters
(under where, on, and, or) the plain SQL form is kept, as unknown and false are the same there
and the plain form is pushed into the scan; where the value matters it is made exact.  Types
that don't go together are an error of the rows in which both sides have a value.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column as SparkColumn, functions as F

from ..errors import ExecError
from ..plans.ast import Binary, Expr, Literal, Ref, Unary
from .values import COMPARISONS, MIN_INT, evaluate, type_of

SPARK = {"int": "bigint", "float": "double", "text": "string", "bytes": "binary", "bool": "boolean", "null": "void"}


@dataclass(frozen=True)
class Lowered:
    column: SparkColumn
    type: str
    nullable: bool = True
    raises: bool = False
    at: tuple[SparkColumn, str] | None = None  # of a timestamp shown as text: itself and its type


def _fail(message: str, kind: str) -> SparkColumn:
    return F.raise_error(F.lit(message)).cast(SPARK[kind])


def negative_zero(x: SparkColumn) -> SparkColumn:
    """Whether a float is -0.0, which is below 0.0 here and equal to it in Spark.  Floats above
    zero aren't looked at closely.  (Under an equality with 0.0 Catalyst would put 0.0 for x.)"""
    return (x <= 0.0) & (x.cast("string") == "-0.0")


def float_equal(x: SparkColumn, y: SparkColumn, null_safe: bool) -> SparkColumn:
    """Equality of floats: Spark's, which scans and joins use, and that of a zero's sign."""
    if null_safe:
        return x.eqNullSafe(y) & negative_zero(x).eqNullSafe(negative_zero(y))
    return (x == y) & (negative_zero(x) == negative_zero(y))


def held_to(x: SparkColumn, kind: str, v) -> SparkColumn:
    """Whether a column of type ``kind`` has the value ``v``, null included."""
    if v is None:
        return x.isNull()
    if kind == "float" and v == 0:
        return _is_zero(x, v)
    return x == literal(v).column.cast(SPARK[kind])


def _is_zero(x: SparkColumn, zero: float) -> SparkColumn:
    """Whether a float is that zero, by bounds that are pushed into the scan."""
    return (x >= 0.0) & (x <= 0.0) & (negative_zero(x) if math.copysign(1, zero) < 0 else ~negative_zero(x))


def identity(columns) -> list[SparkColumn]:
    """What tells rows apart by ``columns`` (name, type): floats with the sign of a zero."""
    return [x for c in columns for x in (F.col(c.name), *([negative_zero(F.col(c.name)).alias(f"{c.name} is -0.0")] if c.type == "float" else []))]


#: Shown form of timestamps, and its shortest to longest beginnings that are compared as times.
STAMP, _STAMP_FROM = "yyyy-MM-dd HH:mm:ss.SSSSSS", "0001-01-01 00:00:00.000000"
_STAMP_LIKE = re.compile(r"\d{4}(-\d\d(-\d\d( \d\d(:\d\d(:\d\d(\.\d{6})?)?)?)?)?)?")


def _moment(text) -> str | None:
    """The earliest moment whose shown form begins with ``text``, None if ``text`` isn't such a beginning."""
    if not isinstance(text, str) or not _STAMP_LIKE.fullmatch(text):
        return None
    whole = text + _STAMP_FROM[len(text) :]
    try:
        datetime.fromisoformat(whole)
    except ValueError:
        return None
    return whole


def literal(v) -> Lowered:
    kind = type_of(v)
    column = F.lit(v) if kind == "null" else F.lit(bytearray(v) if kind == "bytes" else v).cast(SPARK[kind])
    return Lowered(column, kind, v is None)


def _folded(e: Expr) -> Expr:
    """A constant expression as the literal that it gives."""
    if isinstance(e, Literal) or not _constant(e):
        return e
    try:
        return Literal(evaluate(e))
    except ExecError:
        return e  # an error of the rows


def _constant(e: Expr) -> bool:
    if isinstance(e, (Literal, Ref)):
        return isinstance(e, Literal)
    return all(_constant(x) for x in ((e.of,) if isinstance(e, Unary) else (e.left, e.right)))


class Lowering:
    """``resolve`` maps a column reference to its lowered column."""

    def __init__(self, resolve: Callable[[Ref], Lowered]):
        self.resolve = resolve

    def value(self, e: Expr) -> Lowered:
        if isinstance(e, Literal):
            return literal(e.value)
        if isinstance(e, Ref):
            return self.resolve(e)
        if isinstance(e, Unary):
            return self._unary(e)
        if e.op in ("and", "or"):
            got = self._logic(e)
            return Lowered(F.coalesce(got.column, F.lit(False)), "bool", False, got.raises)
        if e.op in COMPARISONS:
            got = self._comparison(e)
            exact = got.column if e.op in ("=", "!=") else F.coalesce(got.column, F.lit(False))
            return Lowered(exact, "bool", False, got.raises)
        return self._arithmetic(e.op, self.value(e.left), self.value(e.right))

    def truth(self, e: Expr) -> Lowered:
        """A boolean column that is true exactly where the condition holds; it may be null elsewhere."""
        if not isinstance(e, (Literal, Ref, Unary)):
            if e.op in ("and", "or"):
                return self._logic(e)
            if e.op in COMPARISONS:
                return self._comparison(e, plain=True)
        got = self.value(e)
        if got.type == "bool":
            return got
        if got.type == "null":
            return Lowered(F.lit(False), "bool", False, got.raises)
        return Lowered(F.when(got.column.isNull(), F.lit(False)).otherwise(_fail(f"the condition is a {got.type}, not a bool", "bool")), "bool", False, True)

    def _unary(self, e: Unary) -> Lowered:
        got = self.value(e.of)
        wanted = ("bool",) if e.op == "not" else ("int", "float")
        if got.type in wanted:
            return Lowered(~got.column if e.op == "not" else -got.column, got.type, got.nullable, got.raises or got.type == "int")
        if got.type == "null":
            return got
        message = f"'not' wants a bool, got a {got.type}" if e.op == "not" else f"cannot negate a {got.type}"
        kind = "bool" if e.op == "not" else "int"
        return Lowered(F.when(got.column.isNull(), F.lit(None).cast(SPARK[kind])).otherwise(_fail(message, kind)), kind, True, True)

    def _logic(self, e) -> Lowered:
        a, b = self.truth(e.left), self.truth(e.right)
        if b.raises:  # the right side must not be tried where the left one decides
            left = F.coalesce(a.column, F.lit(False))
            column = F.when(left, b.column).otherwise(F.lit(False)) if e.op == "and" else F.when(left, F.lit(True)).otherwise(b.column)
        else:
            column = a.column & b.column if e.op == "and" else a.column | b.column
        return Lowered(column, "bool", True, a.raises or b.raises)

    def _comparison(self, e, plain: bool = False) -> Lowered:
        e = Binary(e.op, _folded(e.left), _folded(e.right))
        a, b = self.value(e.left), self.value(e.right)
        raises = a.raises or b.raises
        if "null" in (a.type, b.type):
            other = a if b.type == "null" else b
            if e.op in ("=", "!="):
                column = F.lit(True) if other.type == "null" else other.column.isNull()
                return Lowered(column if e.op == "=" else ~column, "bool", False, raises)
            return Lowered(F.lit(False), "bool", False, raises)
        if a.type != b.type and {a.type, b.type} != {"int", "float"}:
            message = f"cannot compare a {a.type} to a {b.type}"
            missing = a.column.isNull() | b.column.isNull()
            both = a.column.isNull() & b.column.isNull()
            when_missing = both if e.op == "=" else ~both if e.op == "!=" else F.lit(False)
            return Lowered(F.when(missing, when_missing).otherwise(_fail(message, "bool")), "bool", False, True)
        x, y = a.column, b.column
        if a.type != b.type:
            x, y = x.cast("double"), y.cast("double")
        if (timed := self._by_time(e, a, b)) is not None:
            return Lowered(timed, "bool", True, raises)
        if "float" in (a.type, b.type) and not self._never_zero(e.left) and not self._never_zero(e.right):
            return Lowered(self._signed(e, x, y, plain and not (a.nullable and b.nullable)), "bool", e.op not in ("=", "!="), raises)
        if e.op == "=":
            return Lowered(x == y if plain and not (a.nullable and b.nullable) else x.eqNullSafe(y), "bool", False, raises)
        if e.op == "!=":
            return Lowered(~x.eqNullSafe(y), "bool", False, raises)
        column = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.op]
        return Lowered(column, "bool", True, raises)

    @staticmethod
    def _by_time(e, a: Lowered, b: Lowered) -> SparkColumn | None:
        """An order of shown timestamps against a constant as one of the timestamps, which is pushed into the scan."""
        op, shown, text = (e.op, a, e.right) if a.at else ({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(e.op), b, e.left)
        if shown.at is None or op not in ("<", "<=", ">", ">=") or not isinstance(text, Literal) or (moment := _moment(text.value)) is None:
            return None
        at, then = shown.at[0], F.lit(moment).cast(shown.at[1])
        if text.value == moment:
            return {"<": at < then, "<=": at <= then, ">": at > then, ">=": at >= then}[op]
        return at < then if op in ("<", "<=") else at >= then  # no shown form is as short

    @staticmethod
    def _signed(e, x: SparkColumn, y: SparkColumn, plain: bool) -> SparkColumn:
        """Floats in their total order: Spark's order, and -0.0 below 0.0.  A first condition
        without signs is what scans and joins use."""
        if e.op in ("=", "!="):
            literals = [z.value for z in (e.left, e.right) if isinstance(z, Literal)]
            if literals:
                other = y if isinstance(e.left, Literal) else x
                equal = _is_zero(other, literals[0])
                equal = equal if plain and e.op == "=" else F.coalesce(equal, F.lit(False))
            else:
                equal = float_equal(x, y, not plain or e.op == "!=")
            return equal if e.op == "=" else ~equal
        below, above, left, right = (x, y, e.left, e.right) if e.op in ("<", "<=") else (y, x, e.right, e.left)
        sign = lambda e: math.copysign(1, e.value) < 0 if isinstance(e, Literal) else None  # noqa: E731  of a literal zero
        lower, upper, strict = sign(left), sign(right), e.op in ("<", ">")
        if strict and (lower is False or upper is True):
            return below < above
        if not strict and (lower is True or upper is False):
            return below <= above
        signs = negative_zero(below) & ~negative_zero(above) if strict else negative_zero(below) | ~negative_zero(above)
        return (below <= above) & ((below < above) | signs)

    @staticmethod
    def _never_zero(e: Expr) -> bool:
        return isinstance(e, Literal) and e.value not in (None, 0)

    def _arithmetic(self, op: str, a: Lowered, b: Lowered) -> Lowered:
        raises, nullable = a.raises or b.raises, a.nullable or b.nullable
        if "null" in (a.type, b.type):
            kind = b.type if a.type == "null" else a.type
            return Lowered(F.lit(None).cast(SPARK[kind]), kind, True, raises)
        x, y = a.column, b.column
        if (a.type, b.type) == ("int", "int"):
            if op in "/%":
                zero = F.when(y == 0, _fail("division by zero", "int"))
                over = zero.when((y == -1) & (x == F.lit(MIN_INT)), _fail("integer overflow", "int"))
                column = over.otherwise(F.call_function("div", x, y) if op == "/" else x % y)
            else:
                column = x + y if op == "+" else x - y if op == "-" else x * y
            return Lowered(column, "int", nullable, True)
        if {a.type, b.type} <= {"int", "float"}:
            x, y = x.cast("double"), y.cast("double")
            if op in "/%":
                nan, infinity = F.lit(float("nan")), F.lit(float("inf"))
                if op == "%":
                    column = F.when(y == 0, nan).otherwise(x % y)
                else:
                    sign = (x > 0) == (y.cast("string") == "0.0")
                    by_zero = F.when((x == 0) | F.isnan(x), nan).when(sign, infinity).otherwise(-infinity)
                    column = F.when((y == 0) & ~F.isnan(y), by_zero).otherwise(x / y)
                column = F.when(x.isNotNull() & y.isNotNull(), column)
            else:
                column = x + y if op == "+" else x - y if op == "-" else x * y
            return Lowered(column, "float", nullable, raises)
        if (a.type, b.type) == ("text", "text") and op == "+":
            return Lowered(F.concat(x, y), "text", nullable, raises)
        message = f"cannot apply {op} to a {a.type} and a {b.type}"
        kind = a.type
        return Lowered(F.when(x.isNotNull() & y.isNotNull(), _fail(message, kind)).otherwise(F.lit(None).cast(SPARK[kind])), kind, True, True)


def fit(got: Lowered, kind: str, nullable: bool, column: str) -> SparkColumn:
    """A lowered value as a column of that type takes it; what doesn't fit is an error of its row."""
    prefix = f"column '{column}': "
    if got.type == kind or (got.type, kind) == ("int", "float"):
        out = got.column.cast(SPARK[kind])
    elif got.type == "null":
        out = F.lit(None).cast(SPARK[kind])
    else:
        out = F.when(got.column.isNotNull(), _fail(f"{prefix}a {got.type} value does not fit into a column of type {kind}", kind)).otherwise(F.lit(None).cast(SPARK[kind]))
    if nullable or not got.nullable and got.type == kind:
        return out
    return F.when(out.isNull(), _fail(f"{prefix}null in a column that is not @null", kind)).otherwise(out)
