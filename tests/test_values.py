import itertools
import math
import random

import pytest
from pyspark.sql import types as T

from orrery.errors import ExecError
from orrery.functions.lower import Lowered, Lowering
from orrery.functions.values import condition, evaluate
from orrery.plans import native
from orrery.plans.ast import Binary, Literal, Ref, Unary
from orrery.session import SETTINGS, translated

KINDS = {"i": "int", "j": "int", "f": "float", "g": "float", "s": "text", "b": "bool"}
SPARK = {"int": T.LongType(), "float": T.DoubleType(), "text": T.StringType(), "bool": T.BooleanType()}


@pytest.fixture(scope="module")
def table(spark):
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    rng = random.Random(3)
    choices = {"int": [None, 0, 1, -3, 7], "float": [None, 0.0, -0.0, 1.5, -2.25, math.inf, math.nan], "text": [None, "", "a", "b", "é"], "bool": [None, True, False]}
    rows = [tuple(rng.choice(choices[k]) for k in KINDS.values()) for _ in range(120)]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, SPARK[k]) for n, k in KINDS.items()])).coalesce(1), rows


def lowering(spark):
    from pyspark.sql import functions as F

    return Lowering(lambda r: Lowered(F.col(r.column), KINDS[r.column]))


def boolean(rng, depth):
    if depth == 0:
        kind = rng.choice(["int", "float", "text", "num"])
        op = rng.choice(["=", "!=", "<", "<=", ">", ">="])
        if rng.random() < 0.1:
            return Ref("b")
        left, right = (numeric(rng, 2) if kind != "text" else rng.choice([Ref("s"), Literal("a"), Binary("+", Ref("s"), Literal("x"))]) for _ in range(2))
        if rng.random() < 0.1:
            right = Literal(None)
        return Binary(op, left, right)
    if rng.random() < 0.3:
        return Unary("not", boolean(rng, depth - 1))
    return Binary(rng.choice(["and", "or"]), boolean(rng, depth - 1), boolean(rng, depth - 1))


def numeric(rng, depth):
    if depth == 0 or rng.random() < 0.4:
        return rng.choice([Ref("i"), Ref("j"), Ref("f"), Ref("g"), Literal(3), Literal(0.5), Literal(0.0)])
    op = rng.choice(["+", "-", "*", "/", "%"])
    left, right = numeric(rng, depth - 1), numeric(rng, depth - 1)
    if op in "/%" and not any(isinstance(x, Ref) and x.column in "fg" or isinstance(x, Literal) and isinstance(x.value, float) for x in (left, right)):
        op = "+"
    return Binary(op, left, right)


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b)) and True


def test_lowered_expressions_have_the_values_of_plain_ones(spark, table):
    df, rows = table
    rng = random.Random(4)
    lower = lowering(spark)
    trees = [boolean(rng, rng.randint(0, 3)) for _ in range(80)]
    values = df.select(*[lower.value(e).column.alias(f"v{i}") for i, e in enumerate(trees)]).collect()
    truths = df.select(*[lower.truth(e).column.alias(f"t{i}") for i, e in enumerate(trees)]).collect()
    for row, v, t in zip(rows, values, truths, strict=True):
        named = dict(zip(KINDS, row, strict=True))
        for i, e in enumerate(trees):
            want = evaluate(e, named)
            assert v[i] == want, (e, named)
            assert bool(t[i]) == condition(want), (e, named)


def test_numbers(spark, table):
    df, rows = table
    rng = random.Random(5)
    lower = lowering(spark)
    trees = [numeric(rng, 3) for _ in range(60)]
    values = df.select(*[lower.value(e).column.alias(f"v{i}") for i, e in enumerate(trees)]).collect()
    for row, v in zip(rows, values, strict=True):
        named = dict(zip(KINDS, row, strict=True))
        for i, e in enumerate(trees):
            assert same(v[i], evaluate(e, named)), (e, named, v[i])


ERRORS = {
    "9223372036854775807 + 1": "integer overflow",
    "-9223372036854775807 - 2": "integer overflow",
    "-(-9223372036854775807 - 1)": "integer overflow",
    "4611686018427387904 * 2": "integer overflow",
    "(-9223372036854775807 - 1) / -1": "integer overflow",
    "(-9223372036854775807 - 1) % -1": "integer overflow",
    "1 / 0": "division by zero",
    "1 % 0": "division by zero",
    "true + 1": "cannot apply + to a bool and a int",
    '"a" * 2': "cannot apply * to a text and a int",
    '1 < "a"': "cannot compare a int to a text",
    'x"00" = true': "cannot compare a bytes to a bool",
    '-"a"': "cannot negate a text",
    "not 1": "'not' wants a bool, got a int",
    "1 and true": "the condition is a int, not a bool",
}


@pytest.mark.parametrize("text", ERRORS)
def test_errors_in_rows_and_on_the_driver(spark, table, text):
    df, _ = table
    e = native.parse_expression(text)
    with pytest.raises(ExecError, match="^" + ERRORS[text].replace("+", r"\+").replace("*", r"\*") + "$"):
        evaluate(e)
    with pytest.raises(ExecError, match="^" + ERRORS[text].replace("+", r"\+").replace("*", r"\*") + "$"), translated():
        df.select(lowering(spark).value(e).column.alias("v")).collect()


@pytest.mark.parametrize("text, want", [("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("7 / 2.0", 3.5), ("1.0 / 0.0", math.inf), ("-1.0 / 0.0", -math.inf), ("0.0 / 0.0", math.nan), ("1.5 % 0.0", math.nan), ("null + 1", None), ("null = null", True), ("null < 1", False), ("not (null < 1)", True), ("null != 3", True), ('"a" + "b"', "ab"), ("1 = 1.0", True), ("false and 1 / 0 = 1", False), ("true or 1 / 0 = 1", True), ("-0.0 < 0.0", True), ("-0.0 = 0.0", False), ("0.0 / 0.0 = 0.0 / 0.0", True)])
def test_single_values(spark, table, text, want):
    e = native.parse_expression(text)
    assert same(evaluate(e), want)
    got = table[0].limit(1).select(lowering(spark).value(e).column.alias("v")).first().v
    assert same(got, want)


def test_type_errors_need_values(spark, table):
    df, _ = table
    empty = df.where("i is null and i is not null")
    lower = lowering(spark)
    for text in ('i < "a"', "s + 1 = 2", "i"):
        column = lower.truth(native.parse_expression(text)).column
        assert empty.where(column).collect() == []
        assert df.where("i is null and s is null").where(column).collect() == []


def test_comparisons_reach_the_scan(spark, tmp_path):
    from orrery.session import Session
    from orrery.sources.parquet import attach
    from orrery.store import Store

    spark.range(10).selectExpr("id", "id * 2 as v").write.parquet(f"{tmp_path}/t")
    s = Session(spark, Store.create(f"{tmp_path}/db"), {"t": attach(spark, f"{tmp_path}/t", "t", ("id",))})
    df = s.execute("get t { v } where id = 3 and v > 1").rows()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in plan and "GreaterThan(v,1)" in plan
    assert [tuple(r) for r in df.collect()] == [(6,)]
    assert list(itertools.chain(*s.execute("get t { id } where v = 6").collect())) == [3]
