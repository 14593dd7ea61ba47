"""Tokens of both languages and the cursor over them, with the expression parser they share."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError
from .ast import Binary, Expr, Literal, Ref, Unary, Value

MAX_INT = (1 << 63) - 1


@dataclass(frozen=True)
class Token:
    kind: str  # word quoted int float text bytes sign end
    value: Value
    at: int

    def __str__(self):
        if self.kind in ("word", "quoted", "sign"):
            return f"'{self.value}'"
        if self.kind in ("int", "float"):
            return f"the number {self.value:g}" if self.kind == "float" else f"the number {self.value}"
        if self.kind == "text":
            return f"the string {quoted(self.value)}"
        return "a bytes literal" if self.kind == "bytes" else "the end of the statement"


def quoted(text: str) -> str:
    """A text between double quotes with its escapes."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\0", "\\0")):
        text = text.replace(a, b)
    return f'"{text}"'


def scan(source: str, rules: list[tuple[str, str]], convert) -> list[Token]:
    """Tokens by the first rule that fits; ``convert(kind, text, at)`` makes a token or None."""
    pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in rules), re.S)
    at, pos, out = 0, 0, []
    while pos < len(source):
        m = pattern.match(source, pos)
        if not m:
            raise ParseError(at, f"unexpected character {source[pos]!r}")
        if (token := convert(m.lastgroup, m[0], at)) is not None:
            out.append(token)
        at, pos = at + len(m[0].encode("utf-8", "surrogatepass")), m.end()
    return [*out, Token("end", None, at)]


def number(text: str, at: int) -> Token:
    if text.isdigit():
        if (n := int(text)) > MAX_INT:
            raise ParseError(at, "integer too large for int")
        return Token("int", n, at)
    if (f := float(text)) in (float("inf"),):
        raise ParseError(at, "float literal is out of range")
    return Token("float", f, at)


#: Operators from loose to tight; the flag says that one may follow another of its level.
LEVELS = (({"or"}, True), ({"and"}, True), (None, False), ({"=", "!=", "<", "<=", ">", ">="}, False), ({"+", "-"}, True), ({"*", "/", "%"}, True))
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
DEEPEST = 128


class Cursor:
    """A place in a statement's tokens."""

    fold = staticmethod(lambda word: word)

    def __init__(self, tokens: list[Token]):
        self.tokens, self.i, self.depth = tokens, 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def next(self) -> Token:
        token = self.now
        self.i = min(self.i + 1, len(self.tokens) - 1)
        return token

    def fail(self, message: str, token: Token | None = None):
        raise ParseError((token or self.now).at, message)

    def is_word(self, *words: str) -> bool:
        return self.now.kind == "word" and self.fold(self.now.value) in words

    def is_sign(self, *signs: str) -> bool:
        return self.now.kind == "sign" and self.now.value in signs

    def eat_word(self, *words: str) -> bool:
        return self.is_word(*words) and bool(self.next())

    def eat_sign(self, sign: str) -> bool:
        return self.is_sign(sign) and bool(self.next())

    def sign(self, sign: str, what: str) -> None:
        if not self.eat_sign(sign):
            self.fail(f"expected {what}, found {self.now}")

    def operator(self) -> str | None:
        """The operator that stands here, in the tree's spelling."""
        if self.is_word("or", "and"):
            return self.fold(self.now.value)
        return self.now.value if self.now.kind == "sign" else None

    def expression(self, level: int = 0) -> Expr:
        if level == 0:
            self.depth += 1
            if self.depth > DEEPEST:
                self.fail("expression nests too deeply")
        if level == len(LEVELS):
            found = self.unary()
        elif level == 2:
            found = self.negation()
        else:
            signs, more = LEVELS[level]
            found = self.expression(level + 1)
            while True:
                if level == 3 and (special := self.special(found)) is not None:
                    found = special
                    break
                if (op := self.operator()) not in signs:
                    break
                self.next()
                found = self.combined(op, found, self.expression(level + 1))
                if not more:
                    break
        if level == 0:
            self.depth -= 1
        return found

    def negation(self) -> Expr:
        if self.is_word("not"):
            self.next()
            self.depth += 1
            if self.depth > DEEPEST:
                self.fail("expression nests too deeply")
            found = Unary("not", self.negation())
            self.depth -= 1
            return found
        return self.expression(3)

    def unary(self) -> Expr:
        if self.eat_sign("-"):
            self.depth += 1
            if self.depth > DEEPEST:
                self.fail("expression nests too deeply")
            found = Unary("-", self.unary())
            self.depth -= 1
            return found
        return self.primary()

    def combined(self, op: str, left: Expr, right: Expr) -> Expr:
        return Binary(op, left, right)

    def special(self, left: Expr) -> Expr | None:
        """A comparison in words, for languages that have some."""
        return None

    def literal(self) -> Literal | None:
        if self.now.kind in ("int", "float", "text", "bytes"):
            return Literal(self.next().value)
        if self.is_word("true", "false", "null"):
            return Literal({"true": True, "false": False, "null": None}[self.fold(self.next().value)])
        return None

    def primary(self) -> Expr:
        if (found := self.literal()) is not None:
            return found
        if self.eat_sign("("):
            found = self.expression()
            self.sign(")", "')' to close the parenthesis")
            return found
        if self.now.kind in ("word", "quoted"):
            return self.ref("a column name")
        self.fail(f"expected a value, column or '(', found {self.now}")

    def name(self, what: str) -> str:
        raise NotImplementedError

    def ref(self, what: str) -> Ref:
        first = self.name(what)
        return Ref(self.name("a column name after '.'"), first) if self.eat_sign(".") else Ref(first)
