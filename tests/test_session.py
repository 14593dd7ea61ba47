from dataclasses import dataclass

import pytest

from orrery.errors import EngineError, ExecError, StorageError
from orrery.session import Database, Session
from orrery.store import Store


def play(db, text, dialect="native"):
    """Run a script: a line '> statement', then the lines it gives; '...' at an end matches any rest."""
    got, want = [], []
    for line in text.strip("\n").split("\n"):
        if line.startswith("> "):
            want.append((line[2:], []))
            got.append(db.session.script([line[2:]], dialect)[0])
        elif line and not line.startswith("#"):
            want[-1][1].append(line)
    for (statement, lines), found in zip(want, got, strict=True):
        ok = len(lines) == len(found) and all(a == b or b.endswith("...") and a.startswith(b[:-3]) for a, b in zip(found, lines))
        assert ok, f"{statement}: {found}, not {lines}"


def test_tables_and_rows(spark):
    play(Database.in_memory(spark), """
> table city { code: text @key, people: int = 0, area: float @null, note: text @null @index }
ok
> put city { code: "b", people: 5, area: 2, note: "x" }, { code: "a", area: 1.5 }
put 2
> get city
a|0|1.5|null
b|5|2.0|x
> put city { code: "c" }, { code: "a" }
error: duplicate key ("a") in table 'city'
> put city { code: "d" }, { code: "d" }
error: duplicate key ("d") in table 'city'
> put city { people: 1 }
error: column 'code' is missing and has no default
> put city { code: "e", people: "many" }
error: column 'people': a text value does not fit into a column of type int
> put city { code: null }
error: column 'code': null in a column that is not @null
> put city { code: "e", code: "f" }
error: column 'code' appears twice in this row
> put city { code: people }
error: unknown column 'people'
> put city { code: "e", size: 1 }
error: table 'city' has no column 'size'
> get city where note = null
a|0|1.5|null
> get city { people, code, people } where not note = "x"
0|a|0
> get city where people
error: the condition is a int, not a bool
> get city where note < 1
error: cannot compare a text to a int
> get city where code = 1
error: key column 'code': a int value does not fit into a column of type text
> get city where note = 1
error: column 'note': a int value does not fit into a column of type text
> get city order by size
error: cannot order by unknown column 'size'
> get town
error: no table named 'town'
> set city where code = "a" { people = people + 7, area = people }
set 1
> set city { area = null, note = code + "!" }
set 2
> get city order by people desc
a|7|null|a!
b|5|null|b!
> set city { code = "z" }
error: cannot set key column 'code' (comes with row moves in phase 3)
> set city { people = people / 0 }
error: division by zero
> set city { people = null }
error: column 'people': null in a column that is not @null
> set city { people = 1.5 }
error: column 'people': a float value does not fit into a column of type int
> del city where people > 100
del 0
> del city where people = 7
del 1
> show tables
city
> index city.people
ok
> index city.people
error: 'city.people' is already indexed
> explain get city where people = 5 and area > 1.0
Filter (area > 1.0)
  IndexScan city via people = 5
> explain set city where code = "a" { people = 1 }
Update city
  KeyLookup city (code = "a")
> drop table city
ok
> show tables
> table t { a: int }
error: table 't' needs at least one @key column
> table t { a: int @key @null }
error: key column 'a' cannot be @null
> table t { a: int @key, a: text }
error: column 'a' is defined twice in table 't'
> table t { a: int @key, b: int = 1.5 }
error: default for column 'b': a float value does not fit into a column of type int
""")


def test_types_and_order(spark):
    play(Database.in_memory(spark), """
> table sample { no: int @key, weight: float @null, fresh: bool @null, code: bytes @null, label: text @null }
ok
> put sample { no: 1, weight: 1, fresh: true, code: x"00ff", label: "é" }, { no: 2, weight: -0.0 }, { no: 3, weight: 0.0 }, { no: 4, weight: 1e20, code: x"ff", label: "z" }, { no: 5, weight: 2e-7, fresh: false, label: "a" }, { no: 6 }
put 6
> get sample { no, weight } order by weight
6|null
2|-0.0
3|0.0
5|2e-7
1|1.0
4|1e20
> get sample { no } order by weight desc limit 2
4
1
> get sample { no, code } where code >= x"00ff" order by code
1|x"00ff"
4|x"ff"
> get sample { no, label } where label > "a" order by label
4|z
1|é
> get sample { no } where weight = 0.0
3
> get sample { no } where fresh != true
2
3
4
5
6
> get sample { no } where not fresh
5
""")


def test_joins(spark):
    play(Database.in_memory(spark), """
> table person { id: int @key, name: text, town: int @null }
ok
> table town { id: int @key, name: text, country: int @null @index }
ok
> put person { id: 1, name: "ann", town: 10 }, { id: 2, name: "bo", town: 11 }, { id: 3, name: "cy" }
put 3
> put town { id: 10, name: "rome", country: 1 }, { id: 12, name: "oslo" }
put 2
> get person join town on person.town = town.id
1|ann|10|10|rome|1
> get person left join town on person.town = town.id { person.name, town.name }
ann|rome
bo|null
cy|null
> get person left join town on person.town = town.id { person.id } where town.id = null
2
3
> get person join town on person.id * 4 > town.id { person.id, town.id }
3|10
> get person join town on person.town = town.country { person.id, town.id }
3|12
> get person join town on id = 1
error: column 'id' is ambiguous here; qualify it (person.id or town.id)
> get person join town on person.town = town.id { nope }
error: no table in this statement has a column 'nope'
> get person join person on true
error: table 'person' appears twice in this statement; table aliases are not supported yet
> get person join town on person.town = other.id
error: no table named 'other' in this statement
> explain get person join town on person.town = town.id where person.id > 1 order by person.name limit 3
Limit 3
  Sort person.name asc
    Filter (person.id > 1)
      IndexNestedLoopJoin inner on (person.town = town.id)
        SeqScan person
        KeyProbe town (id)
> explain get person left join town on person.town = town.country
IndexNestedLoopJoin left on (person.town = town.country)
  SeqScan person
  IndexProbe town via country
> explain get person join town on person.town < town.id
NestedLoopJoin inner on (person.town < town.id)
  SeqScan person
  SeqScan town
""")


def test_history(spark):
    play(Database.in_memory(spark), """
> table shelf { slot: int @key, boxes: int = 7 }
ok
> put shelf { slot: 41 }
put 1
> branch audit
ok
> switch audit
switched to audit
> put shelf { slot: 42 }
put 1
> switch main
switched to main
> get shelf
41|7
> merge audit
merged audit, head is now commit 5
> get shelf
41|7
42|7
> get shelf as of 2
41|7
> get shelf as of 0
error: no table named 'shelf'
> get shelf as of 99
error: storage error: invalid argument: no such commit id (it may have been garbage collected)
> merge nobody
error: storage error: invalid argument: no branch with this name
> merge main
error: storage error: invalid argument: cannot merge a branch into itself
> branch audit
error: storage error: invalid argument: a branch with this name already exists
> branch _x
error: storage error: invalid argument: branch names are 1 to 64 ascii letters, digits, '_' or '-', starting alphanumeric
> drop branch main
error: storage error: invalid argument: cannot drop the current branch
> put shelf { slot: 43 }
put 1
> switch audit
switched to audit
> put shelf { slot: 44 }
put 1
> switch main
switched to main
> merge audit
error: storage error: invalid argument: branches have diverged; only fast-forward merges are supported for now
> drop branch audit
ok
> show branches
* main @8
> log
commit 8 parent 5
commit 5 parent 2
commit 2 parent 1
commit 1 parent 0
> gc keep 2
gc pruned 2 commits...
> log
commit 8 parent 5
commit 5 parent 2
> get shelf as of 1
error: storage error: invalid argument: no such commit id (it may have been garbage collected)
> get shelf as of time 1
error: storage error: invalid argument: no commit that old is retained on this branch (raise the gc retention)
> gc keep 0
error: storage error: invalid argument: gc must retain at least one commit per branch
> get shelf
41|7
42|7
43|7
""")


def test_transactions(spark):
    play(Database.in_memory(spark), """
> table t { id: int @key }
ok
> commit
error: no transaction is open
> begin
ok
> begin
error: a transaction is already open; commit or rollback first
> put t { id: 1 }
put 1
> put t { id: 2 }, { id: 1 }
error: duplicate key (1) in table 't'
> get t
1
> get t as of 1
> branch b
error: branch and history statements cannot run inside a transaction; commit or rollback first
> commit
ok
> begin
ok
> del t
del 1
> rollback
ok
> get t
1
> log
commit 2 parent 1
commit 1 parent 0
""")


def test_sql_scripts(spark):
    play(Database.in_memory(spark), """
> CREATE TABLE "order" (id INTEGER PRIMARY KEY, [limit] TEXT, n NUMERIC(4, 2) NOT NULL DEFAULT -1.5)
ok
> INSERT INTO "order" (id, [limit]) VALUES (1, 'it''s'), (0x10, NULL)
put 2
> SELECT * FROM "order" WHERE [limit] IS NOT 'x'
1|it's|-1.5
16|null|-1.5
> UPDATE "order" SET n = id WHERE [limit] IS NULL
set 1
> DELETE FROM "order" WHERE n < 0
del 1
> SELECT n FROM "order";
16.0
> EXPLAIN SELECT * FROM "order" WHERE id = 16
KeyLookup order (id = 16)
""", "sql")


def test_writers_race_and_crash(spark, tmp_path):
    db = Database.create(spark, f"{tmp_path}/db")
    db.execute("table t { id: int @key }")
    other = Session(spark, Store(f"{tmp_path}/db"))
    db.execute("begin")
    db.execute("put t { id: 1 }")
    other.execute("put t { id: 2 }")
    with pytest.raises(StorageError, match="another writer committed"):
        db.execute("commit")
    assert Database.open(spark, f"{tmp_path}/db").execute("get t").collect() == [(2,)]


@dataclass
class Row:
    id: int
    name: str


def test_embedded_interface(spark):
    db = Database.in_memory(spark)
    db.execute("table t { id: int @key, name: text }")
    assert db.insert_all("t", spark.createDataFrame([(2, "b"), (1, "a")], "id long, name string")) == 2
    assert db.query_as(Row, "get t") == [Row(1, "a"), Row(2, "b")]
    assert db.insert("t", Row(8, "x")) == 1 and db.insert("t", {"name": 'quo"te', "id": 9}) == 1 and not db.in_transaction
    with pytest.raises(ExecError, match=r"duplicate key \(8\)"):
        db.insert("t", Row(8, "y"))
    assert db.execute("get t where id > 2").collect() == [(8, "x"), (9, 'quo"te')] and db.execute("del t where id > 2").count == 2
    for bad, message in (([(3, "c"), (3, "d")], r"duplicate key \(3\)"), ([(1, "c")], r"duplicate key \(1\)"), ([(4, None)], "null in a column")):
        with pytest.raises(ExecError, match=message):
            db.insert_all("t", spark.createDataFrame(bad, "id long, name string"))
    with pytest.raises(ZeroDivisionError), db.transaction():
        db.execute("del t")
        1 / 0
    assert [r.id for r in db.query("get t").collect()] == [1, 2] and db.branch() == "main"
    with pytest.raises(EngineError):
        db.execute("get nothing")


def test_one_commit_for_a_batch(spark):
    db = Database.in_memory(spark)
    got = db.execute_batch(["table t { id: int @key }", "put t { id: 1 }, { id: 2 }", "put t { id: 2 }", "begin", "nonsense", "del t where id = 1", "get t"])
    assert [str(x) if isinstance(x, EngineError) else x.render() for x in got[:3]] == [["ok"], ["put 2"], "duplicate key (2) in table 't'"]
    assert got[5].render() == ["del 1"] and got[6].collect() == [(2,)]
    assert db.execute("log").lines == ["commit 1 parent 0"] and not db.session.in_transaction


def test_verify(spark):
    db = Database.in_memory(spark)
    db.execute("table t { id: int @key, v: int }")
    db.execute("put t { id: 1, v: 1 }")
    assert db.verify() == []
    table = db.session.tables()["t"]
    spark.createDataFrame([(1, None)], "id long, v long").write.mode("append").parquet(db.session.store.part_path(table.parts[0]))
    assert db.verify() == ["table 't': 1 nulls in column 'v'", "table 't': 1 repeated keys"]


def test_random_writes_against_a_dictionary(spark):
    import random

    rng, model = random.Random(7), {}
    db = Database.in_memory(spark)
    db.execute("table t { id: int @key, tag: text @index, v: int @null }")
    for _ in range(25):
        r = rng.random()
        if r < 0.5:
            rows = [(rng.randrange(20), rng.choice("xyz"), rng.choice([None, 1, 2])) for _ in range(3)]
            text = ", ".join(f'{{ id: {i}, tag: "{t}", v: {"null" if v is None else v} }}' for i, t, v in rows)
            bad = len({i for i, *_ in rows}) < 3 or any(i in model for i, *_ in rows)
            lines = db.session.script([f"put t {text}"])[0]
            assert lines[0].startswith("error: duplicate key") if bad else lines == ["put 3"]
            if not bad:
                model |= {i: (t, v) for i, t, v in rows}
        elif r < 0.75:
            tag = rng.choice("xyz")
            hit = [i for i, (t, _) in model.items() if t == tag]
            assert db.session.script([f'set t where tag = "{tag}" {{ v = v + 1, tag = "{rng.choice("xyz")}" }}'])[0] == [f"set {len(hit)}"]
            now = {r[0]: (r[1], r[2]) for r in db.execute("get t").collect()}
            assert {i: (model[i][1] or 0) + 1 if model[i][1] is not None else None for i in hit} == {i: now[i][1] for i in hit}
            model = now
        else:
            hit = [i for i, (_, v) in model.items() if v is None]
            assert db.session.script(["del t where v = null"])[0] == [f"del {len(hit)}"]
            model = {i: x for i, x in model.items() if i not in hit}
        assert {r[0]: (r[1], r[2]) for r in db.execute("get t").collect()} == model


def test_zeros_of_either_sign_are_two_keys(spark):
    db = Database.in_memory(spark)
    db.execute("table z { k: float @key, v: float @index }")
    play(db, """
> put z { k: 0.0, v: -0.0 }, { k: -0.0, v: 0.0 }, { k: 1.5, v: 0.0 }
put 3
> put z { k: -0.0, v: 1.0 }
error: duplicate key (-0.0) in table 'z'
> get z
-0.0|0.0
0.0|-0.0
1.5|0.0
> get z { k } where k = 0.0
0.0
> get z { k } where v = -0.0
0.0
> get z { k } where v < 0.0
0.0
> get z { k } where v >= 0.0 and k < v
-0.0
> get z { k } order by v
0.0
-0.0
1.5
> set z where k = -0.0 { v = 7.0 }
set 1
> del z where k = 0.0
del 1
> get z
-0.0|7.0
1.5|0.0
""")
    assert db.insert_all("z", spark.createDataFrame([(0.0, 1.0), (2.5, 0.0)], "k double, v double")) == 2 and db.verify() == []
    with pytest.raises(ExecError, match="duplicate key"):
        db.insert_all("z", spark.createDataFrame([(-0.0, 1.0)], "k double, v double"))


def test_conditions_on_floats_and_times_reach_the_scan(spark):
    from orrery.queries import session

    def plan(text):
        df = session(spark, "/root/testdata/sf0.001").execute(text).rows()
        return df._jdf.queryExecution().executedPlan().toString()

    for text, pushed in (
        ("get events where value > 0.0", "GreaterThan(value,0.0)"),
        ("get events where value >= 0.0", "GreaterThanOrEqual(value,0.0)"),
        ("get events where value = 0.0", "LessThanOrEqual(value,0.0)"),
        ('get events where ts < "2024-01-05"', "LessThan(ts,2024-01-05"),
        ('get events where "2024-01-05 10:30" <= ts', "GreaterThanOrEqual(ts,2024-01-05"),
    ):
        assert pushed in plan(text), text
    joined = plan("get events join orders on value = o_totalprice { event_id }")
    assert "Join [" in joined and "struct(" not in joined and "named_struct" not in joined


@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "="])
def test_times_compare_as_the_text_they_are_shown_as(spark, op, tmp_path):
    from orrery.sources.parquet import attach

    moments = ["2024-01-04 23:59:59.999999", "2024-01-05 00:00:00", "2024-01-05 10:30:00", "2024-01-05 10:30:00.000001", "2024-12-31 00:00:00"]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(moments)] + [(9, None)], "id long, m string").selectExpr("id", "cast(m as timestamp) ts")
    rows.write.parquet(f"{tmp_path}/t")
    table = attach(spark, f"{tmp_path}/t", "t", ("id",))
    shown = {r["id"]: r["ts"] for r in table[1].select("id", "ts").collect()}
    s = Session(spark, Store.create(f"{tmp_path}/db"), {"t": table})
    for text in ("2024", "2024-01", "2024-01-05", "2024-01-05 10", "2024-01-05 10:30:00", "2024-01-05 10:30:00.000000", "2024-13", "x", ""):
        import operator

        by = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq}[op]
        want = [i for i, t in sorted(shown.items()) if t is not None and by(t, text)]
        assert [r[0] for r in s.execute(f'get t {{ id }} where ts {op} "{text}"').collect()] == want, text


def test_an_index_skips_what_a_value_is_not_in(spark):
    """Scans for absent values between the least and the greatest read no row."""
    db = Database.in_memory(spark)
    db.execute("table big { id: int @key, name: text @index, pad: text, late: text }")
    rows = spark.range(0, 200_000, 2).selectExpr("id", "concat('n', id) name", "sha2(cast(id as string), 256) pad", "concat('l', id) late")
    assert db.insert_all("big", rows) == 100_000

    def read_rows(text):
        df = db.execute(text).rows()
        assert df.collect() == []
        plan, found = df._jdf.queryExecution().executedPlan(), []

        def walk(p):
            if p.nodeName().startswith("Scan parquet"):
                found.append(p.metrics().apply("numOutputRows").value())
            children = p.children()
            for i in range(children.size()):
                walk(children.apply(i))

        walk(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
        return sum(found)

    assert read_rows("get big where id = 50001") == 0 and read_rows('get big where name = "n50001"') == 0
    assert read_rows('get big where late = "l50001"') > 0
    db.execute("index big.late")
    assert read_rows('get big where late = "l50001"') == 0
    assert db.execute('get big { id } where late = "l50002"').collect() == [(50002,)]
    assert sorted(r.id for r in db.lookup("big", [4, 50001, 199_998, 10**9]).collect()) == [4, 199_998]


def test_writes_touch_only_the_files_that_hold_their_rows(spark):
    """Against a model, on a table of several files; the others stay as they are, gc keeps them."""
    db = Database.in_memory(spark)
    db.execute("table big { id: int @key, v: int, pad: text }")
    rows = spark.range(0, 60_000).repartition(6).selectExpr("id", "id % 100 v", "sha2(cast(id as string), 512) pad")
    db.insert_all("big", rows)
    model = {i: i % 100 for i in range(60_000)}
    files = lambda: {f for p in db.session.tables()["big"].parts for f in db.session.store.part_files(p)}
    before = files()
    assert len(before) == 6 and db.execute("del big where id = 41").count == 1
    after = files()
    assert len(before & after) == 5 and len(after) == 6
    assert db.execute("set big where id = 42 { v = 1000 }").count == 1 and len(before & files()) >= 4
    new = spark.createDataFrame([(43, 7, "x"), (70_000, 8, "y")], "id long, v long, pad string")
    assert db.upsert_all("big", new) == 2 and len(before & files()) >= 3
    assert db.execute("del big where id = 99999").count == 0
    del model[41]
    model |= {42: 1000, 43: 7, 70_000: 8}
    db.execute("gc keep 1")
    got = {r[0]: r[1] for r in db.execute("get big { id, v }").rows().collect()}
    assert got == model and db.verify() == []
    stats = db.stats()
    assert stats["all_files"] == stats["head_files"] == len(files()) and stats["free_files"] == 0
    assert db.execute("set big where v = 3 { v = 4 }").count == 600 and len(db.execute("get big where v = 4").collect()) == 1200
