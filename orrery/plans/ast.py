"""The syntax tree that both languages share."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

Value = Union[None, bool, int, float, str, bytes]


@dataclass(frozen=True)
class Literal:
    value: Value

    def __eq__(self, other):
        return isinstance(other, Literal) and type(self.value) is type(other.value) and repr(self.value) == repr(other.value)

    def __hash__(self):
        return hash(repr(self.value))


@dataclass(frozen=True)
class Ref:
    column: str
    table: str | None = None

    def __str__(self):
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Unary:
    op: str  # - not
    of: "Expr"


@dataclass(frozen=True)
class Binary:
    op: str  # or and = != < <= > >= + - * / %
    left: "Expr"
    right: "Expr"


Expr = Union[Literal, Ref, Unary, Binary]


@dataclass(frozen=True)
class Column:
    name: str
    type: str  # int float text bytes bool
    nullable: bool = False
    key: bool = False
    index: bool = False
    default: Literal | None = None


@dataclass(frozen=True)
class Join:
    table: str
    on: Expr
    left: bool = False


@dataclass(frozen=True)
class Get:
    table: str
    joins: tuple[Join, ...] = ()
    columns: tuple[Ref, ...] | None = None
    as_of: tuple[str, int] | None = None  # ("commit" | "time", number)
    where: Expr | None = None
    order: tuple[Ref, bool] | None = None  # column, descending
    limit: int | None = None


@dataclass(frozen=True)
class Put:
    table: str
    rows: tuple[tuple[tuple[str, Expr], ...], ...]


@dataclass(frozen=True)
class Set:
    table: str
    assign: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Del:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[Column, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class CreateIndex:
    table: str
    column: str


@dataclass(frozen=True)
class Simple:
    """Statements of a word and at most a name and a number: show tables, branch n at 3, gc keep 2."""

    verb: str
    name: str | None = None
    number: int | None = None


@dataclass(frozen=True)
class Explain:
    of: "Statement"


Statement = Union[Get, Put, Set, Del, CreateTable, DropTable, CreateIndex, Simple, Explain]
