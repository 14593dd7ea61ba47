"""The SQL dialect: a strict subset, in which everything left out is refused by name."""

from __future__ import annotations

import re
from dataclasses import replace

from ..errors import ParseError
from .ast import Binary, Column, CreateIndex, CreateTable, Del, DropTable, Explain, Expr, Get, Join, Literal, Put, Ref, Set, Simple, Statement
from .tokens import NAME, Cursor, Token, number, quoted, scan

RULES = [
    ("skip", r"[ \t\r\n\f]+|--[^\n]*"),
    ("comment", r"/\*.*?(?:\*/|\Z)"),
    ("bytes", r"[xX]'[^']*'?"),
    ("word", r"[A-Za-z_][A-Za-z0-9_]*"),
    ("hex", r"0[xX][0-9A-Za-z_]*"),
    ("number", r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"),
    ("text", r"'(?:[^']|'')*'?"),
    ("quoted", r'"(?:[^"]|"")*"?|`(?:[^`]|``)*`?|\[[^\]]*\]?'),
    ("bitwise", r"<<|>>|&|~|\|(?!\|)"),
    ("mark", r"[?:@$]"),
    ("sign", r"==|!=|<>|<=|>=|\|\||[=<>+\-*/%(),.;]"),
    ("bang", r"!"),
]
#: Words that name nothing unless they are quoted.
RESERVED = frozenset(
    "all and as asc begin between by case cast check collate commit constraint create cross default delete desc distinct drop "
    "else end escape except exists explain foreign from full glob group having if in index inner insert intersect into is join "
    "key left like limit match natural not null offset on or order outer primary references regexp release replace right "
    "rollback savepoint select set show table then transaction true union unique update using values when where with".split()
)
#: Column types by spelling.
TYPES = {
    "int": "int integer bigint smallint tinyint mediumint int2 int4 int8",
    "float": "real float numeric decimal double",
    "text": "text varchar nvarchar char nchar clob string character date datetime timestamp",
    "bytes": "blob",
    "bool": "boolean bool",
}
TYPE_OF = {spelling: kind for kind, spellings in TYPES.items() for spelling in spellings.split()}
#: What is refused where, by the word that stands there.
STATEMENTS = {
    "savepoint": "savepoints", "release": "savepoints", "with": "with (common table expressions)",
    "values": "values as a bare statement", "replace": "replace", "alter": "alter table",
}
AFTER_WHERE = {
    "group": "group by and aggregates", "having": "group by and aggregates", "window": "window functions",
    "union": "compound selects", "intersect": "compound selects", "except": "compound selects",
}
IN_PREDICATE = {
    "between": "between (spell it with two comparisons)", "in": "in (...)", "like": "like and pattern matching",
    "glob": "like and pattern matching", "regexp": "like and pattern matching", "match": "like and pattern matching",
}
IN_VALUE = {"case": "case expressions", "cast": "cast", "exists": "exists", "select": "subqueries"}
JOINS = {
    "right": "right and full outer joins", "full": "right and full outer joins",
    "cross": "cross and natural joins (write join ... on ...)", "natural": "cross and natural joins (write join ... on ...)",
}
IN_COLUMN = {"unique": "unique constraints", "check": "check constraints", "collate": "collate", "generated": "generated columns", "as": "generated columns"}
#: Comparisons, which don't follow one another.
COMPARISONS = frozenset(("=", "!=", "<", "<=", ">", ">="))
EXPECTED = "expected a statement (select, insert, update, delete, create, drop, explain), found {}"
QUALIFIED = "database-qualified names are not supported; there is one database per file"


def _token(kind: str, text: str, at: int) -> Token | None:
    if kind == "skip":
        return None
    if kind == "comment":
        if len(text) < 4 or not text.endswith("*/"):
            raise ParseError(at, "comment never closes")
        return None
    if kind == "bitwise":
        raise ParseError(at, "bitwise operators are not supported")
    if kind == "mark":
        raise ParseError(at, "parameter placeholders are not supported; write the value inline")
    if kind == "bang":
        raise ParseError(at, "expected != here")
    if kind == "hex":
        if not re.fullmatch(r"0[xX][0-9a-fA-F]+", text):
            raise ParseError(at, "hex literal wants digits after 0x")
        if (n := int(text, 16)) >= 1 << 64:
            raise ParseError(at, "hex literal too large for int")
        return Token("int", n - (1 << 64) if n >> 63 else n, at)
    if kind == "number":
        return number(text, at)
    if kind == "bytes":
        if not re.fullmatch(r"[xX]'(?:[0-9a-fA-F]{2})*'", text):
            raise ParseError(at, "blob literal wants hex digits, like x'deadbeef'")
        return Token("bytes", bytes.fromhex(text[2:-1]), at)
    if kind == "text":
        if len(text) < 2 or (len(text) - len(text.rstrip("'"))) % 2 == (text.strip("'") == ""):
            raise ParseError(at, "string never closes")
        return Token("text", text[1:-1].replace("''", "'"), at)
    if kind == "quoted":
        close = {"[": "]"}.get(text[0], text[0])
        if len(text) < 2 or text[-1] != close or (close != "]" and text[1:].count(close) % 2 == 0):
            raise ParseError(at, "identifier never closes")
        return Token("quoted", text[1:-1] if close == "]" else text[1:-1].replace(close * 2, close), at)
    if kind == "sign":
        return Token("sign", {"==": "=", "<>": "!="}.get(text, text), at)
    return Token(kind, text, at)


class _Sql(Cursor):
    fold = staticmethod(str.lower)

    def refuse(self, what: str):
        self.fail(f"not supported yet: {what}")

    def refuse_any(self, of: dict[str, str]) -> None:
        if self.now.kind == "word" and (what := of.get(self.now.value.lower())):
            self.refuse(what)

    def word(self, word: str, what: str) -> None:
        if not self.eat_word(word):
            self.fail(f"expected {what}, found {self.now}")

    def name(self, what: str) -> str:
        token = self.now
        if token.kind not in ("word", "quoted"):
            self.fail(f"expected {what}, found {token}")
        if token.kind == "word" and token.value.lower() in RESERVED:
            self.fail(f"'{token.value}' is a reserved word here; quote it (\"{token.value}\") to use it as a name")
        if not NAME.match(token.value):
            self.fail(f"the name {quoted(token.value)} does not fit the catalog; names are letters, digits and underscores, starting with a letter or underscore")
        if token.value in ("not", "and", "or"):
            self.fail(f"'{token.value}' is an operator and cannot name a table or column")
        return self.next().value

    # expressions

    def operator(self) -> str | None:
        return "+" if self.is_sign("||") else super().operator()

    def special(self, left: Expr) -> Expr | None:
        if self.now.kind == "sign" and self.now.value in COMPARISONS:
            at = self.now
            op, right = self.next().value, super().expression(4)
            if Literal(None) in (left, right):
                self.fail("comparing with null never matches in sql; write is null or is not null", at)
            return Binary(op, left, right)
        if self.eat_word("is"):
            op = "!=" if self.eat_word("not") else "="
            return Binary(op, left, super().expression(4))
        if self.is_word("not"):
            after = self.tokens[self.i + 1]
            if after.kind == "word" and (what := IN_PREDICATE.get(after.value.lower())):
                self.refuse(what)
        self.refuse_any(IN_PREDICATE)
        return None

    def unary(self) -> Expr:
        return self.unary() if self.eat_sign("+") else super().unary()

    def primary(self) -> Expr:
        if self.is_sign("(") and self.tokens[self.i + 1].kind == "word" and self.tokens[self.i + 1].value.lower() == "select":
            self.next()
            self.refuse("subqueries")
        self.refuse_any(IN_VALUE)
        found = super().primary()
        if isinstance(found, Ref) and self.is_sign("("):
            self.refuse("functions and aggregates")
        return found

    # statements

    def statement(self) -> Statement:
        if self.now.kind != "word":
            self.fail(EXPECTED.format(self.now))
        head = self.now.value.lower()
        self.refuse_any(STATEMENTS)
        if head in ("pragma", "vacuum", "analyze", "attach", "detach", "reindex"):
            self.fail(f"'{head}' is not supported")
        if head not in ("select", "insert", "update", "delete", "create", "drop", "explain", "show", "begin", "commit", "end", "rollback"):
            self.fail(EXPECTED.format(self.now))
        self.next()
        if head == "explain":
            if self.eat_word("query"):
                self.word("plan", "'plan' after 'explain query'")
            return Explain(self.statement())
        if head == "show":
            self.word("tables", "'tables' after 'show'")
            return Simple("show tables")
        if head in ("begin", "commit", "end", "rollback"):
            if head == "begin":
                self.eat_word("deferred", "immediate", "exclusive")
            self.eat_word("transaction")
            if head == "rollback" and self.is_word("to"):
                self.refuse("savepoints (rollback to)")
            return Simple("commit" if head == "end" else head)
        return getattr(self, head)()

    def table_name(self) -> str:
        if self.is_sign("("):
            self.refuse("subqueries and parentheses in from")
        found = self.name("a table name")
        if self.is_sign("."):
            self.fail(QUALIFIED)
        if self.is_word("as") or self.now.kind == "quoted" or self.now.kind == "word" and self.now.value.lower() not in RESERVED and self.now.value.lower() != "window":
            self.refuse("table aliases")
        return found

    def select(self) -> Get:
        if self.is_word("distinct"):
            self.refuse("select distinct")
        self.eat_word("all")
        columns = None
        if not self.eat_sign("*"):
            columns = []
            while not columns or self.eat_sign(","):
                if self.is_word("case"):
                    self.refuse("case expressions")
                if self.now.kind not in ("word", "quoted"):
                    self.fail("the select list takes plain column names or * for now; expressions are not supported yet")
                columns.append(self.ref("a column name"))
                if self.is_sign("("):
                    self.refuse("functions and aggregates")
                if self.is_word("as") or self.now.kind == "quoted" or self.now.kind == "word" and self.now.value.lower() not in RESERVED:
                    self.refuse("column aliases")
        self.word("from", "'from' (select without from is not supported yet)")
        table, joins = self.table_name(), []
        while True:
            self.refuse_any(JOINS)
            if self.is_sign(","):
                self.fail("implicit comma joins are not supported; write join ... on ...")
            left = False
            if self.eat_word("inner"):
                self.word("join", "'join' after 'inner'")
            elif self.eat_word("left"):
                self.eat_word("outer")
                self.word("join", "'join' after 'left'")
                left = True
            elif not self.eat_word("join"):
                break
            other = self.table_name()
            if self.is_word("using"):
                self.refuse("join ... using (write on ... = ...)")
            self.word("on", "'on' with the join condition")
            joins.append(Join(other, self.expression(), left))
        where = self.expression() if self.eat_word("where") else None
        self.refuse_any(AFTER_WHERE)
        order = limit = None
        if self.eat_word("order"):
            self.word("by", "'by' after 'order'")
            column = self.ref("a column name to order by")
            if self.is_word("collate"):
                self.refuse("collate")
            descending = self.eat_word("desc")
            if not descending:
                self.eat_word("asc")
            if self.is_word("nulls"):
                self.refuse("nulls first / nulls last (nulls sort first ascending, always)")
            if self.is_sign(","):
                self.refuse("more than one order by column")
            order = column, descending
        if self.eat_word("limit"):
            if self.now.kind != "int":
                self.fail("limit takes a plain non-negative integer for now")
            if self.now.value < 0:
                self.fail("limit wants a number >= 0")
            limit = self.next().value
            if self.is_word("offset") or self.is_sign(","):
                self.refuse("offset")
        return Get(table, tuple(joins), tuple(columns) if columns else None, None, where, order, limit)

    def insert(self) -> Put:
        if self.is_word("or"):
            self.refuse("insert or (replace, ignore, ...)")
        self.word("into", "'into' after 'insert'")
        table = self.name("a table name")
        self.refuse_any({"default": "insert ... default values", "select": "insert from select"})
        if not self.eat_sign("("):
            self.fail("insert needs an explicit column list, like insert into t (a, b) values (1, 2); positional inserts are not supported yet")
        columns = [self.name("a column name")]
        while self.eat_sign(","):
            columns.append(self.name("a column name"))
        self.sign(")", "')' after the column list")
        self.refuse_any({"select": "insert from select"})
        self.word("values", "'values'")
        rows = []
        while not rows or self.eat_sign(","):
            at = self.now
            self.sign("(", "'(' to open a row")
            values = [self.expression()]
            while self.eat_sign(","):
                values.append(self.expression())
            self.sign(")", "')' after the row")
            if len(values) != len(columns):
                self.fail(f"row {len(rows) + 1} has {len(values)} values for {len(columns)} named columns", at)
            rows.append(tuple(zip(columns, values, strict=True)))
        self.refuse_any({"on": "on conflict / upsert", "returning": "returning"})
        return Put(table, tuple(rows))

    def update(self) -> Set:
        if self.is_word("or"):
            self.refuse("update or (replace, ignore, ...)")
        table = self.name("a table name")
        self.word("set", "'set' after the table name")
        assign = []
        while not assign or self.eat_sign(","):
            column = self.name("a column name")
            self.sign("=", "'=' in the set list")
            assign.append((column, self.expression()))
        if self.is_word("from"):
            self.refuse("update ... from")
        where = self.expression() if self.eat_word("where") else None
        self.refuse_any({"returning": "returning", "order": "order by / limit on update", "limit": "order by / limit on update"})
        return Set(table, tuple(assign), where)

    def delete(self) -> Del:
        self.word("from", "'from' after 'delete'")
        table = self.name("a table name")
        where = self.expression() if self.eat_word("where") else None
        self.refuse_any({"returning": "returning", "order": "order by / limit on delete", "limit": "order by / limit on delete"})
        return Del(table, where)

    def drop(self) -> DropTable:
        if self.eat_word("table"):
            if self.is_word("if"):
                self.refuse("'if exists'")
            return DropTable(self.name("a table name"))
        if self.is_word("index"):
            self.refuse("drop index (indexes live and die with their table for now)")
        if self.is_word("view", "trigger"):
            self.fail(f"'drop {self.now.value.lower()}' is not supported")
        self.fail(f"expected 'table' after 'drop', found {self.now}")

    def create(self) -> Statement:
        self.refuse_any({"temp": "temporary tables", "temporary": "temporary tables", "unique": "unique indexes"})
        if self.eat_word("table"):
            return self.create_table()
        if self.eat_word("index"):
            return self.create_index()
        if self.is_word("view", "trigger", "virtual"):
            self.fail(f"'create {self.now.value.lower()}' is not supported")
        self.fail(f"expected 'table' or 'index' after 'create', found {self.now}")

    def create_index(self) -> CreateIndex:
        if self.is_word("if"):
            self.refuse("'if not exists'")
        self.name("an index name")
        self.word("on", "'on' after the index name")
        table = self.name("a table name")
        self.sign("(", "'(' to open the index column list")
        column = self.name("a column name")
        self.eat_word("asc")
        self.refuse_any({"desc": "descending indexes", "collate": "collate"})
        if self.is_sign(","):
            self.refuse("multi-column indexes")
        self.sign(")", "')' after the index column")
        self.refuse_any({"where": "partial indexes"})
        return CreateIndex(table, column)

    def create_table(self) -> CreateTable:
        if self.is_word("if"):
            self.refuse("'if not exists'")
        at = self.now
        table = self.name("a table name")
        if self.is_sign("."):
            self.fail(QUALIFIED)
        self.refuse_any({"as": "create table as select"})
        self.sign("(", "'(' to open the column list")
        columns: list[Column] = []
        while True:
            if self.is_word("primary", "unique", "check", "foreign", "constraint"):
                columns = self.table_constraint(columns)
            else:
                columns.append(self.column_def(any(c.key for c in columns)))
            if not self.eat_sign(","):
                break
        self.sign(")", "')' after the column list")
        while True:
            if self.eat_word("without"):
                self.word("rowid", "'rowid' after 'without'")
            elif not (self.eat_word("strict") or self.eat_sign(",")):
                break
        if not any(c.key for c in columns):
            self.fail(f"table '{table}' needs a primary key", at)
        return CreateTable(table, tuple(columns))

    def column_type(self) -> str:
        token = self.now
        if token.kind != "word":
            self.fail(f"expected a column type, found {token}")
        spelling = self.next().value.lower()
        if spelling not in TYPE_OF:
            self.fail(f"unknown column type '{token.value}' (use integer, real, text, blob or boolean)", token)
        self.eat_word({"double": "precision", "character": "varying"}.get(spelling, ""))
        if self.eat_sign("("):
            while True:
                if self.now.kind != "int":
                    self.fail(f"expected a number in the type length, found {self.now}")
                self.next()
                if not self.eat_sign(","):
                    break
            self.sign(")", "')' after the type length")
        return TYPE_OF[spelling]

    def column_def(self, has_key: bool) -> Column:
        column = Column(self.name("a column name"), self.column_type(), nullable=True)
        while True:
            at = self.now
            self.refuse_any(IN_COLUMN)
            if self.eat_word("primary"):
                self.word("key", "'key' after 'primary'")
                if has_key or column.key:
                    self.fail("the table already has a primary key; use one table-level primary key (a, b) for a composite key", at)
                self.eat_word("asc")
                self.refuse_any({"desc": "descending primary keys", "autoincrement": "autoincrement", "on": "on conflict clauses"})
                column = replace(column, key=True, nullable=False)
            elif self.eat_word("not"):
                self.word("null", "'null' after 'not'")
                column = replace(column, nullable=False)
            elif self.eat_word("null"):
                column = replace(column, nullable=not column.key)
            elif self.eat_word("default"):
                column = replace(column, default=self.default())
            elif self.eat_word("references"):
                self.references()
            elif self.eat_word("constraint"):
                self.name("a constraint name")
            else:
                return column

    def default(self) -> Literal:
        at, negative = self.now, False
        while self.is_sign("-", "+"):
            negative ^= self.next().value == "-"
        found = self.literal()
        if found is None or negative and not (isinstance(found.value, (int, float)) and not isinstance(found.value, bool)):
            self.fail("defaults must be plain literals, not expressions", at)
        return Literal(-found.value) if negative else found

    def table_constraint(self, columns: list[Column]) -> list[Column]:
        if self.eat_word("constraint"):
            self.name("a constraint name")
        at = self.now
        self.refuse_any({"unique": "unique constraints", "check": "check constraints"})
        if self.eat_word("primary"):
            self.word("key", "'key' after 'primary'")
            if any(c.key for c in columns):
                self.fail("the table already has a primary key", at)
            self.sign("(", "'(' to open the key column list")
            names = [c.name for c in columns]
            last, keys = -1, set()
            while last < 0 or self.eat_sign(","):
                at = self.now
                name = self.name("a key column name")
                self.eat_word("asc")
                self.refuse_any({"desc": "descending primary keys"})
                if name not in names:
                    self.fail(f"unknown column '{name}' in the primary key", at)
                if names.index(name) <= last:
                    self.fail("composite primary keys must list columns in declaration order (other orders are not supported yet)", at)
                last = names.index(name)
                keys.add(name)
            self.sign(")", "')' after the key column list")
            self.refuse_any({"on": "on conflict clauses"})
            return [replace(c, key=True, nullable=False) if c.name in keys else c for c in columns]
        if self.eat_word("foreign"):
            self.word("key", "'key' after 'foreign'")
            self.sign("(", "'(' to open the foreign key column list")
            self.name("a column name")
            while self.eat_sign(","):
                self.name("a column name")
            self.sign(")", "')' after the foreign key column list")
            self.word("references", "'references'")
            self.references()
            return columns
        self.fail(f"expected a table constraint, found {self.now}")

    def references(self) -> None:
        """What follows 'references' is read and means nothing."""
        self.name("the referenced table name")
        if self.eat_sign("("):
            self.name("a referenced column name")
            while self.eat_sign(","):
                self.name("a referenced column name")
            self.sign(")", "')' after the referenced columns")
        while True:
            if self.eat_word("on"):
                if not self.eat_word("delete", "update"):
                    self.fail("expected 'delete' or 'update' after 'on'")
                if self.eat_word("set"):
                    if not self.eat_word("null", "default"):
                        self.fail("expected 'null' or 'default' after 'set'")
                elif self.eat_word("no"):
                    self.word("action", "'action' after 'no'")
                elif not self.eat_word("cascade", "restrict"):
                    self.fail("expected a foreign key action (cascade, restrict, set null, set default, no action)")
            elif self.eat_word("match"):
                self.name("a match name")
            elif self.is_word("not") and self.tokens[self.i + 1].kind == "word" and self.tokens[self.i + 1].value.lower() == "deferrable":
                self.i += 2
                self.initially()
            elif self.eat_word("deferrable"):
                self.initially()
            else:
                return

    def initially(self) -> None:
        if self.eat_word("initially") and not self.eat_word("deferred", "immediate"):
            self.fail("expected 'deferred' or 'immediate' after 'initially'")




def parse(source: str) -> Statement:
    cursor = _Sql(scan(source, RULES, _token))
    found = cursor.statement()
    while cursor.eat_sign(";"):
        pass
    if cursor.now.kind != "end":
        cursor.fail("one statement per call; found more input after the statement")
    return found
