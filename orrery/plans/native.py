"""The native language: one lower-case statement per text."""

from __future__ import annotations

import re

from ..errors import ParseError
from .ast import Binary, Column, CreateIndex, CreateTable, Del, DropTable, Explain, Expr, Get, Join, Literal, Put, Ref, Set, Simple, Statement
from .tokens import Cursor, Token, number, scan

RULES = [
    ("skip", r"[ \t\r\n]+|#[^\n]*"),
    ("bytes", r'x"[^"]*"?'),
    ("word", r"[A-Za-z_][A-Za-z0-9_]*"),
    ("number", r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"),
    ("text", r'"(?:[^"\\]|\\.)*"?'),
    ("sign", r"!=|<=|>=|\+=|-=|\*=|/=|[=<>+\-*/%(){}\[\],.:@]"),
    ("bang", r"!"),
]
ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "t": "\t", "0": "\0"}


def _token(kind: str, text: str, at: int) -> Token | None:
    if kind == "skip":
        return None
    if kind == "bang":
        raise ParseError(at, "expected != here")
    if kind == "number":
        return number(text, at)
    if kind == "bytes":
        if not re.fullmatch(r'x"(?:[0-9a-fA-F]{2})*"', text):
            raise ParseError(at, 'bytes literal wants hex digits, like x"deadbeef"')
        return Token("bytes", bytes.fromhex(text[2:-1]), at)
    if kind == "text":
        body, out, i = text[1:], [], 0
        while i < len(body) and body[i] != '"':
            if body[i] == "\\":
                i += 1
                if i >= len(body):
                    break
                if body[i] not in ESCAPES:
                    raise ParseError(at + 1 + len(body[: i - 1].encode()), "unknown escape in string")
                out.append(ESCAPES[body[i]])
            else:
                out.append(body[i])
            i += 1
        if i >= len(body):
            raise ParseError(at, "string never closes")
        return Token("text", "".join(out), at)
    return Token(kind, text, at)


class _Native(Cursor):
    def ident(self, what: str) -> str:
        if self.now.kind != "word":
            self.fail(f"expected {what}, found {self.now}")
        return self.next().value

    def name(self, what: str) -> str:
        token = self.now
        found = self.ident(what)
        if found in ("not", "and", "or"):
            self.fail(f"'{found}' is an operator and cannot name a table or column", token)
        return found

    def word(self, word: str) -> None:
        if not self.eat_word(word):
            self.fail(f"expected the word '{word}', found {self.now}")

    def count(self, message: str) -> int:
        if self.now.kind != "int":
            self.fail(message)
        return self.next().value

    def one_of(self, what: str, words: tuple[str, ...], message: str) -> str:
        token = self.now
        found = self.ident(what)
        if found not in words:
            self.fail(message.format(found), token)
        return found

    def statement(self) -> Statement:
        token = self.now
        verb = self.ident("a statement (table, get, put, set, del, drop, index, show, branch, switch, merge, log, gc, begin, commit, rollback, explain)")
        if verb in ("table", "put", "get", "set", "del"):
            return getattr(self, verb)()
        if verb in ("log", "begin", "commit", "rollback"):
            return Simple(verb)
        if verb in ("switch", "merge"):
            return Simple(verb, self.ident("a branch name"))
        if verb == "explain":
            return Explain(self.statement())
        if verb == "drop":
            if self.one_of("'table' or 'branch'", ("table", "branch"), "drop works on 'table' or 'branch', not '{}'") == "table":
                return DropTable(self.name("a table name"))
            return Simple("drop branch", self.ident("a branch name"))
        if verb == "index":
            table = self.name("a table name")
            self.sign(".", "'.' as in index users.name")
            return CreateIndex(table, self.name("a column name"))
        if verb == "show":
            return Simple("show " + self.one_of("'tables' or 'branches'", ("tables", "branches"), "show knows 'tables' and 'branches', not '{}'"))
        if verb == "branch":
            name = self.ident("a branch name")
            return Simple("branch", name, self.count("branch ... at wants a commit id (a non-negative integer)") if self.eat_word("at") else None)
        if verb == "gc":
            self.word("keep")
            return Simple("gc", None, self.count("gc keep wants the number of commits to retain per branch"))
        self.fail(f"'{verb}' is not a statement (try table, get, put, set, del, drop, index, show, branch, switch, merge, log, gc, explain)", token)

    def table(self) -> CreateTable:
        table, columns = self.name("a table name"), []
        self.sign("{", "'{' to open the column list")
        while not self.is_sign("}"):
            columns.append(self.column())
            self.eat_sign(",")
        if not columns:
            self.fail("a table needs at least one column")
        self.next()
        return CreateTable(table, tuple(columns))

    def column(self) -> Column:
        name = self.name("a column name")
        self.sign(":", "':' between column name and type")
        kind = self.one_of("a type (int, float, text, bytes, bool)", ("int", "float", "text", "bytes", "bool"), "'{}' is not a type (int, float, text, bytes, bool)")
        flags, default = set(), None
        while True:
            if self.eat_sign("@"):
                flags.add(self.one_of("an attribute (key, index, null)", ("key", "index", "null"), "'@{}' is not an attribute (@key, @index, @null)"))
            elif self.is_sign("="):
                self.next()
                at = self.now
                if (default := self.literal()) is None:
                    self.fail("defaults must be literals, not expressions", at)
            else:
                return Column(name, kind, "null" in flags, "key" in flags, "index" in flags, default)

    def put(self) -> Put:
        table, rows = self.name("a table name"), []
        while not rows or self.eat_sign(","):
            self.sign("{", "'{' to open a row")
            row = []
            while not self.is_sign("}"):
                column = self.name("a column name")
                self.sign(":", "':' between column and value")
                row.append((column, self.expression()))
                self.eat_sign(",")
            if not row:
                self.fail("a row needs at least one column")
            self.next()
            rows.append(tuple(row))
        return Put(table, tuple(rows))

    def get(self) -> Get:
        table, joins, columns, as_of, order, limit = self.name("a table name"), [], None, None, None, None
        while self.is_word("join", "left"):
            left = self.eat_word("left")
            self.word("join")
            other = self.name("a table name to join")
            self.word("on")
            joins.append(Join(other, self.expression(), left))
        if self.eat_sign("{"):
            columns = [self.ref("a column name")]
            while self.eat_sign(","):
                columns.append(self.ref("a column name"))
            self.sign("}", "'}' to close the column list")
        if self.eat_word("as"):
            self.word("of")
            kind = "time" if self.eat_word("time") else "commit"
            as_of = kind, self.count("as of wants a commit id, or 'as of time' a unix millisecond timestamp")
        where = self.expression() if self.eat_word("where") else None
        if self.eat_word("order"):
            self.word("by")
            column = self.ref("a column name")
            order = column, self.eat_word("desc") or self.eat_word("asc") and False
        if self.eat_word("limit"):
            limit = self.count("limit wants a non-negative integer")
        return Get(table, tuple(joins), tuple(columns) if columns else None, as_of, where, order, limit)

    def set(self) -> Set:
        table = self.name("a table name")
        where = self.expression() if self.eat_word("where") else None
        self.sign("{", "'{' to open the assignments")
        assign = []
        while not self.is_sign("}"):
            column = self.name("a column name")
            if not self.is_sign("=", "+=", "-=", "*=", "/="):
                self.fail(f"expected =, +=, -=, *= or /=, found {self.now}")
            op, value = self.next().value, self.expression()
            assign.append((column, value if op == "=" else Binary(op[0], Ref(column), value)))
            self.eat_sign(",")
        if not assign:
            self.fail("set needs at least one assignment")
        self.next()
        return Set(table, tuple(assign), where)

    def del_(self) -> Del:
        table = self.name("a table name")
        return Del(table, self.expression() if self.eat_word("where") else None)


setattr(_Native, "del", _Native.del_)


def parse(source: str) -> Statement:
    cursor = _Native(scan(source, RULES, _token))
    found = cursor.statement()
    if cursor.now.kind != "end":
        cursor.fail(f"statement ended, but there is more: {cursor.now}")
    return found


def parse_expression(source: str) -> Expr:
    cursor = _Native(scan(source, RULES, _token))
    found = cursor.expression()
    if cursor.now.kind != "end":
        cursor.fail(f"statement ended, but there is more: {cursor.now}")
    return found


__all__ = ["Literal", "parse", "parse_expression"]
