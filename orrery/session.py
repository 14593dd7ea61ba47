"""Sessions: statements, transactions and what they return."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, is_dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import EngineError, ExecError, PlanError, StorageError
from .functions.lower import identity
from .operators import query, write
from .plans import native, pretty, sql
from .plans.access import explain
from .plans.ast import CreateIndex, CreateTable, Del, DropTable, Explain, Get, Literal, Put, Set, Simple, Statement
from .shared import mounted
from .store import LOST, Store, Table, check_table

NO_TXN, IN_TXN = "no transaction is open", "a transaction is already open; commit or rollback first"
ALONE = "branch and history statements cannot run inside a transaction; commit or rollback first"
#: Settings under which the engine's arithmetic and names hold.
SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC"}
#: Seconds for which a statement outside a transaction is tried again if another writer was faster.
BUSY_S = 5.0
#: Rows and bytes of a batch of rows.
BATCH_ROWS, BATCH_BYTES = 65_536, 16 << 20


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings and the engine's; the caller's stays as it is."""
    out = spark.newSession()
    for k, v in {**spark.conf.getAll, **SETTINGS}.items():
        if spark.conf.isModifiable(k):
            out.conf.set(k, v)
    return out


@dataclass
class Outcome:
    """What a statement returns: nothing, a count, lines, or rows."""

    verb: str = "ok"
    count: int | None = None
    lines: list[str] | None = None
    query: query.Query | None = None

    def rows(self) -> DataFrame:
        assert self.query is not None, "this statement returns no rows"
        return self.query.rows()

    def collect(self) -> list[tuple]:
        with translated():
            return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in self.query.ordered().collect()]

    def batches(self, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[list[tuple]]:
        """Rows in their order, in lists of at most ``rows`` rows and about ``size`` bytes; the
        driver holds one of Spark's partitions at a time."""
        out, bytes_ = [], 0
        with translated():
            for r in self.query.ordered().toLocalIterator():
                out.append(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r))
                bytes_ += sum(len(v.encode()) if isinstance(v, str) else len(v) if isinstance(v, bytearray) else 8 for v in r)
                if len(out) >= rows or bytes_ >= size:
                    yield out
                    out, bytes_ = [], 0
        if out:
            yield out

    def render(self) -> list[str]:
        if self.query is not None:
            return ["|".join(v if isinstance(v, str) else pretty.value(v) for v in r) for r in self.collect()]
        if self.lines is not None:
            return self.lines
        return [self.verb if self.count is None else f"{self.verb} {self.count}"]


#: Spark's error classes and the engine's texts.
TEXTS = {"ARITHMETIC_OVERFLOW": "integer overflow", "BINARY_ARITHMETIC_OVERFLOW": "integer overflow", "DIVIDE_BY_ZERO": "division by zero", "REMAINDER_BY_ZERO": "division by zero"}


@contextmanager
def translated():
    """Errors of rows, found by executors, as the engine's own."""
    try:
        yield
    except PySparkException as e:
        name = e.getCondition() or ""
        if name == "USER_RAISED_EXCEPTION":
            raise ExecError(e.getMessageParameters().get("errorMessage", str(e))) from None
        if name.split(".")[0] in TEXTS:
            raise ExecError(TEXTS[name.split(".")[0]]) from None
        raise


class Session:
    def __init__(self, spark: SparkSession, store: Store, external: dict[str, tuple[Table, DataFrame]] | None = None):
        self.spark, self.store, self.external = own_session(spark), store, {} if external is None else external
        self.pending: dict[str, Table] | None = None
        self.base = 0

    # statements

    def execute(self, text: str) -> Outcome:
        return self.run(native.parse(text))

    def execute_sql(self, text: str) -> Outcome:
        return self.run(sql.parse(text))

    @property
    def in_transaction(self) -> bool:
        return self.pending is not None

    def tables(self) -> dict[str, Table]:
        return self.pending if self.pending is not None else self.store.commit(self.store.head).tables

    def run(self, s: Statement) -> Outcome:
        if not self.in_transaction:
            self.store.reload()
        if isinstance(s, Simple):
            return self._simple(s)
        if isinstance(s, Explain):
            return Outcome(lines=explain(s.of, self._table))
        if isinstance(s, Get):
            return self._get(s)
        return self._commit(lambda tables: self._change(tables, s))

    def _commit(self, change):
        """Apply ``change`` to the tables: to those of the open transaction, or as a commit of its
        own, which is tried again for ``BUSY_S`` if another writer was faster."""
        until = time.monotonic() + BUSY_S
        while True:
            if not self.in_transaction:
                self.store.reload()
            with translated():
                tables, outcome = change(dict(self.tables()))
            if self.in_transaction:
                self.pending = tables
                return outcome
            if tables == self.tables():
                return outcome
            try:
                self.store.publish(self.store.meta["txid"], tables)
                return outcome
            except StorageError as e:
                if LOST not in str(e) or time.monotonic() > until:
                    raise

    def _table(self, name: str, tables: dict[str, Table] | None = None) -> Table:
        found = (self.tables() if tables is None else tables).get(name)
        if found is None and name in self.external:
            found = self.external[name][0]
        if found is None:
            raise PlanError(f"no table named '{name}'")
        return found

    def read(self, table: Table) -> DataFrame:
        if table.external:
            return self.external[table.name][1]
        return write.read(self.spark, self.store, table)

    def _get(self, g: Get) -> Outcome:
        tables = self.tables()
        if g.as_of:
            kind, n = g.as_of
            tables = (self.store.commit(n) if kind == "commit" else self.store.at_time(n)).tables
        return Outcome(query=query.build(g, lambda n: self._table(n, tables), self.read))

    def _change(self, tables: dict[str, Table], s: Statement) -> tuple[dict[str, Table], Outcome]:
        if isinstance(s, CreateTable):
            if s.table in tables:
                raise PlanError(f"table '{s.table}' already exists")
            check_table(s.table, s.columns)
            return tables | {s.table: Table(s.table, s.columns)}, Outcome()
        if s.table not in tables:
            raise PlanError(f"no table named '{s.table}'")
        table = tables[s.table]
        if isinstance(s, DropTable):
            del tables[s.table]
            return tables, Outcome()
        if isinstance(s, CreateIndex):
            c = table.column(s.column)
            if c is None:
                raise PlanError(f"table '{s.table}' has no column '{s.column}'")
            if c.index:
                raise PlanError(f"'{s.table}.{s.column}' is already indexed")
            columns = tuple(replace(x, index=True) if x is c else x for x in table.columns)
            return tables | {s.table: write.indexed(self.spark, self.store, replace(table, columns=columns))}, Outcome()
        verb, apply = {Put: ("put", write.put_rows), Set: ("set", write.set_rows), Del: ("del", write.del_rows)}[type(s)]
        changed, n = apply(self.spark, self.store, table, s)
        return tables | {s.table: changed}, Outcome(verb, n)

    def insert(self, table: str, rows: DataFrame) -> int:
        """Put all rows of a DataFrame as one statement."""
        return self._put(table, lambda old: write.put_frame(self.spark, self.store, old, rows))

    def upsert(self, table: str, rows: DataFrame) -> int:
        """Put all rows of a DataFrame; a row whose key is there takes the place of the old one."""
        return self._put(table, lambda old: write.upsert_frame(self.spark, self.store, old, rows))

    def _put(self, name: str, put) -> int:
        def change(tables: dict[str, Table]):
            tables[name], n = put(self._table(name, tables))
            return tables, n

        return self._commit(change)

    def lookup(self, table: str, values: DataFrame | list, column: str | None = None) -> DataFrame:
        """The rows whose key, or whose ``column``, is one of ``values``, in one plan.

        ``values`` is a DataFrame of one column for each key column, or a list of values, or of
        tuples for a key of several columns.  A value that doesn't occur has no row.
        """
        if not self.in_transaction:
            self.store.reload()
        return query.lookup(self.spark, self._table(table), self.read, values, column)

    def key_range(self, table: str, start: tuple | None = None, end: tuple | None = None) -> DataFrame:
        """Rows from key ``start`` up to, and without, key ``end``, in the order of the key; None
        is no bound, and a tuple may leave out the last columns of a key."""
        if not self.in_transaction:
            self.store.reload()
        return query.key_range(self._table(table), self.read, start, end)

    def _simple(self, s: Simple) -> Outcome:
        if s.verb == "show tables":
            return Outcome(lines=sorted([*self.tables(), *self.external], key=lambda n: n.encode()))
        if s.verb == "begin":
            if self.in_transaction:
                raise ExecError(IN_TXN)
            self.pending, self.base = dict(self.tables()), self.store.meta["txid"]
            return Outcome()
        if s.verb in ("commit", "rollback"):
            if not self.in_transaction:
                raise ExecError(NO_TXN)
            tables, self.pending = self.pending, None
            if s.verb == "commit" and tables != self.store.commit(self.store.head).tables:
                self.store.publish(self.base, tables)
            return Outcome()
        if self.in_transaction:
            raise ExecError(ALONE)
        if s.verb == "branch":
            self.store.create_branch(s.name, s.number)
        elif s.verb == "switch":
            self.store.switch(s.name)
            return Outcome(lines=[f"switched to {s.name}"])
        elif s.verb == "merge":
            return Outcome(lines=[f"merged {s.name}, head is now commit {self.store.merge(s.name)}"])
        elif s.verb == "drop branch":
            self.store.drop_branch(s.name)
        elif s.verb == "show branches":
            refs, current = self.store.meta["refs"], self.store.meta["current"]
            return Outcome(lines=[f"{'*' if n == current else ' '} {n} @{refs[n]['head']}" for n in sorted(refs)])
        elif s.verb == "log":
            return Outcome(lines=[f"commit {c.id} parent {c.parent}" for c in self.store.history()])
        else:
            pruned, freed = self.store.gc(s.number)
            return Outcome(lines=[f"gc pruned {pruned} commits, freed {freed} pages"])
        return Outcome()

    def batch(self, texts: list[str], dialect: str = "native") -> list[Outcome | EngineError]:
        """Statements under one commit; one that fails leaves nothing and doesn't stop the others.

        Nobody is answered before the commit is durable.
        """
        self.run(Simple("begin"))
        out: list[Outcome | EngineError] = []
        try:
            for text in texts:
                try:
                    statement = (native if dialect == "native" else sql).parse(text)
                    if isinstance(statement, Simple) and statement.verb in ("begin", "commit", "rollback"):
                        raise ExecError("transaction statements cannot be part of a batch")
                    out.append(self.run(statement))
                except EngineError as e:
                    out.append(e)
            self._simple(Simple("commit"))
        finally:
            self.pending = None
        return out

    def verify(self) -> list[str]:
        """What is wrong with the stored rows of the current head: repeated keys and nulls where
        none may be; one aggregation for each table."""
        wrong = []
        for name, table in sorted(self.tables().items()):
            fixed = [c.name for c in table.columns if not c.nullable]
            rows = write.read(self.spark, self.store, table, fresh=True)
            nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fixed]).first().asDict()
            wrong += [f"table '{name}': {n} nulls in column '{c}'" for c, n in nulls.items() if n]
            if n := rows.groupBy(*identity(table.keys)).count().where("count > 1").count():
                wrong.append(f"table '{name}': {n} repeated keys")
        return wrong

    def script(self, lines: list[str], dialect: str = "native") -> list[list[str]]:
        """Each statement's lines; an error is a line too and doesn't end the script."""
        out = []
        for line in lines:
            try:
                out.append((self.execute if dialect == "native" else self.execute_sql)(line).render())
            except EngineError as e:
                out.append([f"error: {e}"])
        return out


class Database:
    """The embedded interface."""

    def __init__(self, spark: SparkSession, store: Store):
        self.session = Session(spark, store)
        self.execute, self.execute_sql, self.insert_all = self.session.execute, self.session.execute_sql, self.session.insert
        self.upsert_all, self.lookup, self.key_range = self.session.upsert, self.session.lookup, self.session.key_range
        self.execute_batch, self.verify = self.session.batch, self.session.verify

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> "Database":
        return cls(spark, Store.create(folder))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "Database":
        return cls(spark, Store(folder))

    @classmethod
    def in_memory(cls, spark: SparkSession) -> "Database":
        return cls(spark, Store.create(mounted(spark, "orrery")))

    def query(self, text: str) -> DataFrame:
        return self.execute(text).query.ordered()

    def query_sql(self, text: str) -> DataFrame:
        return self.execute_sql(text).query.ordered()

    def query_as(self, cls: type, text: str) -> list:
        """Rows as objects of a dataclass, matched by qualified name, then by the name after the point."""
        outcome = self.execute(text)
        names = outcome.query.names
        at = {f: names.index(f) if f in names else next(i for i, n in enumerate(names) if n.split(".")[-1] == f) for f in cls.__dataclass_fields__}
        return [cls(**{f: r[i] for f, i in at.items()}) for r in outcome.collect()]

    @contextmanager
    def transaction(self):
        """Commits at the end, rolls back on an exception."""
        self.execute("begin")
        try:
            yield self
        except BaseException:
            if self.session.in_transaction:
                self.execute("rollback")
            raise
        self.execute("commit")

    def insert(self, table: str, row) -> int:
        """Put one row, a dict or an object of a dataclass."""
        values = asdict(row) if is_dataclass(row) else dict(row)
        return self.session.run(Put(table, (tuple((n, Literal(v)) for n, v in values.items()),))).count

    @property
    def in_transaction(self) -> bool:
        return self.session.in_transaction

    def head(self) -> int:
        return self.session.store.head

    def branch(self) -> str:
        return self.session.store.meta["current"]

    def gc(self, keep: int) -> tuple[int, int]:
        if self.session.in_transaction:
            raise ExecError(ALONE)
        return self.session.store.gc(keep)

    def stats(self) -> dict[str, int]:
        return self.session.store.stats()
