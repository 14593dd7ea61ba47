"""Random joins against nested loops over plain rows: by key, by index, and by neither."""

import random

import pytest

from orrery.functions.values import condition, evaluate
from orrery.plans import native
from orrery.session import Database

TABLES = {
    "a": ("table a { id: int @key, n: int @null, s: text @null }", ("id", "n", "s")),
    "by_key": ("table by_key { k: int @key, w: text @null }", ("k", "w")),
    "by_index": ("table by_index { id: int @key, n: int @null @index, w: text @null }", ("id", "n", "w")),
    "plain": ("table plain { id: int @key, n: int @null, w: text @null }", ("id", "n", "w")),
}
COLUMN = {"by_key": "k", "by_index": "n", "plain": "n"}


def filled(spark, rng):
    db, rows = Database.in_memory(spark), {}
    for name, (text, columns) in TABLES.items():
        db.execute(text)
        rows[name] = []
        for i in rng.sample(range(8), rng.randint(0, 7)):
            row = {columns[0]: i}
            for c in columns[1:]:
                row[c] = None if rng.random() < 0.25 else rng.randint(0, 5) if c == "n" else rng.choice("pqr")
            rows[name].append(row)
        if rows[name]:
            literal = lambda v: "null" if v is None else f'"{v}"' if isinstance(v, str) else str(v)
            db.execute(f"put {name} " + ", ".join("{ " + ", ".join(f"{c}: {literal(v)}" for c, v in r.items()) + " }" for r in rows[name]))
        rows[name].sort(key=lambda r, c=columns[0]: r[c])
    return db, rows


def expected(statement, rows):
    """Rows of a parsed ``get`` by nested loops, in the order of the keys."""
    scope = [{f"{statement.table}.{c}": v for c, v in r.items()} for r in rows[statement.table]]
    for j in statement.joins:
        found = []
        for left in scope:
            hits = [right for r in rows[j.table] if condition(evaluate(j.on, left | (right := {f"{j.table}.{c}": v for c, v in r.items()})))]
            found += [left | h for h in hits] or ([left | {f"{j.table}.{c}": None for c in TABLES[j.table][1]}] if j.left else [])
        scope = found
    if statement.where is not None:
        scope = [r for r in scope if condition(evaluate(statement.where, r))]
    return [tuple(r.values()) for r in scope]


@pytest.mark.parametrize("seed", range(4))
def test_joins(spark, seed):
    rng = random.Random(seed)
    db, rows = filled(spark, rng)
    for right in ("by_key", "by_index", "plain"):
        c = COLUMN[right]
        for on in (f"a.n = {right}.{c}", f"{right}.{c} = a.n and a.id > 2", f"a.n = {right}.{c} or a.s = {right}.w", f"a.n < {right}.{c}", f"a.s = {right}.w"):
            kind = rng.choice(["join", "left join"])
            where = rng.choice(["", f" where not {right}.w = a.s", f" where {right}.w = null", " where a.n >= 2", f" where {right}.{c} + a.id > 4"])
            text = f"get a {kind} {right} on {on}{where}"
            assert db.execute(text).collect() == expected(native.parse(text), rows), text
    text = "get a left join by_index on a.n = by_index.n join by_key on by_key.k = by_index.id or by_key.w = a.s"
    assert db.execute(text).collect() == expected(native.parse(text), rows)
