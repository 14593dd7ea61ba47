import sqlite3

import pytest

from orrery.__main__ import main
from orrery.errors import EngineError
from orrery.operators.blobs import Blobs
from orrery.session import Database
from orrery.sources import sqlite_import as si
from orrery.sources.sqlite_file import shown


@pytest.fixture
def source(tmp_path):
    path = str(tmp_path / "a.sqlite")
    con = sqlite3.connect(path)
    con.executescript("""
        CREATE TABLE kinds (id INTEGER PRIMARY KEY, i INT NOT NULL, r REAL, mixed NUMERIC, loose, late TEXT DEFAULT 'd', g INT AS (id * 2) VIRTUAL);
        CREATE INDEX one ON kinds (i); CREATE INDEX two ON kinds (i, r); CREATE UNIQUE INDEX three ON kinds (late);
        INSERT INTO kinds VALUES (1, 5, 1, 1, 'x', 'a'), (2, 6, 2.5, 1.5, 7, 'b'), (9, 7, NULL, 2, 1e21, NULL);
        CREATE TABLE "two words" ("1st" TEXT, "_1ST" BLOB, "or" INT, PRIMARY KEY ("or", "1st")) WITHOUT ROWID;
        INSERT INTO "two words" VALUES ('a', x'00ff', 1), ('b', 'text', 1);
        CREATE TABLE nokey (a, b); INSERT INTO nokey VALUES (1, NULL), (NULL, 2);
        CREATE TABLE empty (id INT PRIMARY KEY, f FLOAT);
        CREATE VIEW v AS SELECT 1;
    """)
    con.close()
    return path


def test_import(spark, source):
    db = Database.in_memory(spark)
    report = si.import_file(db, source)
    assert "table 'kinds' -> kinds, 3 rows" in report and "  note: view 'v' is not carried over" in report
    assert "  mixed -> mixed: float" in [x.removesuffix(" @null") for x in report]
    assert any("index 'two' is not carried over" in x for x in report) and any("'g' is computed" in x for x in report)
    assert db.execute("show tables").lines == ["empty", "kinds", "nokey", "two_words"]
    assert db.execute("get kinds").collect() == [(1, 5, 1.0, 1.0, "x", "a"), (2, 6, 2.5, 1.5, "7", "b"), (9, 7, None, 2.0, "1000000000000000000000", None)]
    assert db.execute("get two_words { or_, _1st, _1ST_2 }").collect() == [(1, "a", b"\x00\xff"), (1, "b", b"text")]
    assert "  note: a rowid key is added: no key is declared" in report
    assert db.execute("get nokey").collect() == [(1, 1, None), (2, None, 2)]
    assert db.execute("get empty").collect() == []
    assert db.execute("explain get kinds where i = 5").lines == ["IndexScan kinds via i = 5"]


def test_strict_and_dry_run(spark, source):
    db = Database.in_memory(spark)
    with pytest.raises(EngineError, match="column 'mixed' integers are widened to float"):
        si.import_file(db, source, strict=True)
    assert si.import_file(db, source, dry_run=True) and db.execute("show tables").lines == []


@pytest.mark.parametrize("declared, want", [("BIGINT", "integer"), ("CHARINT", "integer"), ("NVARCHAR(9)", "text"), ("CLOB", "text"), ("BLOB", "blob"), (None, "blob"), ("DOUBLE", "real"), ("FLOAT", "real"), ("DECIMAL(1)", "numeric"), ("DATE", "numeric")])
def test_affinity(declared, want):
    assert si.affinity(declared) == want


def test_decisions():
    c = si.Counts
    assert si.decide(c(), "numeric")[0] == "int" and si.decide(c(), "blob")[0] == "bytes"
    assert si.decide(c(ints=1), "text")[0] == "int" and si.decide(c(reals=1, nulls=3), "text")[0] == "float"
    assert si.decide(c(ints=1, reals=1), "real") == ("float", ["integers are widened to float"], [])
    assert si.decide(c(ints=1, reals=1, max_int=(1 << 53) + 1), "real")[2]
    assert si.decide(c(ints=1, texts=1), "text")[0] == "text" and si.decide(c(texts=1, blobs=1), "text")[0] == "bytes"
    assert si.decide(c(ints=1, texts=1), "text", strict=True)[2]
    assert si.names_for(["a b", "A_B", "9x", "not", ""]) == ["a_b", "A_B_2", "_9x", "not_", "_"]
    assert [si.default_of(t, k)[0] and si.default_of(t, k)[0].value for t, k in (("5", "int"), ("5", "float"), ("'it''s'", "text"), ("x'00'", "bytes"), ("NULL", "int"), ("now()", "text"))] == [5, 5.0, "it's", b"\0", None, None]
    assert [shown(x) for x in (1.0, 1e21, 1e-7, -0.5)] == ["1", "1000000000000000000000", "0.0000001", "-0.5"]


def test_blobs(spark, tmp_path):
    blobs = Blobs(spark, str(tmp_path / "b"), chunk=4)
    data = {1: b"abcdabcdxy", 2: b"", 3: b"abcdxy", 4: bytes(range(256))}
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name long")
    blobs.write(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "name long, bytes binary"))
    assert {r.name: bytes(r.bytes) for r in blobs.read_all().collect()} == data
    assert list(blobs.read(1)) == [b"abcd", b"abcd", b"xy"]
    assert blobs.chunks().count() == len({v[i : i + 4] for v in data.values() for i in range(0, max(1, len(v)), 4)})
    state = lambda: {r.state: r.chunks for r in blobs.check().collect()}
    total = blobs.chunks().count()
    assert state() == {"unclaimed": total}
    blobs.retain(names(1, 3))
    assert state() == {"sound": 2, "unclaimed": total - 2}
    blobs.release(names(1))
    assert state() == {"sound": 2, "unclaimed": total - 2}
    blobs.release(names(3))
    assert state() == {"unclaimed": total - 2}
    with pytest.raises(EngineError):
        blobs.release(names(3))
    for bad, message in (([(1, b"x")], "blob 1 exists already"), ([(9, b"x"), (9, b"y")], "blob 9 is written twice"), ([(9, None)], "blob 9 has no bytes"), ([(None, b"x")], "no name")):
        with pytest.raises(EngineError, match=message):
            blobs.write(spark.createDataFrame(bad, "name long, bytes binary"))
    with pytest.raises(EngineError, match="no blob 77"):
        blobs.retain(names(77))
    assert blobs.blobs().count() == 4


def test_releases_that_race(spark, tmp_path):
    one, two = (Blobs(spark, str(tmp_path / "b")) for _ in range(2))
    one.write(spark.createDataFrame([(1, b"abc")], "name long, bytes binary"))
    name = spark.createDataFrame([(1,)], "name long")
    one.retain(name)
    real, calls = one._part, []

    def part(df):
        if not calls:
            calls.append(two.release(name))
        return real(df)

    one._part = part
    with pytest.raises(EngineError, match="more often than it was retained"):
        one.release(name)
    assert two.check().collect() == [] and two.sweep() == 0


def test_text_that_is_not_utf8_and_other_encodings(spark, tmp_path):
    path = str(tmp_path / "bad.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT COLLATE NOCASE, n INT CHECK (n > 0))")
    con.execute("INSERT INTO t VALUES (1, CAST(x'ff41' AS TEXT), 1)")
    con.commit()
    con.close()
    with pytest.raises(Exception, match="a text is not UTF-8"):
        si.import_file(Database.in_memory(spark), path)
    notes = si.import_file(Database.in_memory(spark), path, dry_run=True)
    assert any("1 check constraint is not carried over" in x for x in notes) and any("collation NOCASE is not" in x for x in notes)
    path = str(tmp_path / "wide.sqlite")
    con = sqlite3.connect(path)
    con.execute("PRAGMA encoding = 'UTF-16le'")
    con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT)")
    con.execute("INSERT INTO t VALUES (1, 'zoë 𝄞')")
    con.commit()
    con.close()
    db = Database.in_memory(spark)
    si.import_file(db, path)
    assert db.execute("get t").collect() == [(1, "zoë 𝄞")]
    assert si.names_for(["Or", "NOT", "and"]) == ["Or_", "NOT_", "and_"]


def test_commands(spark, source, tmp_path):
    out = []
    run = lambda *a, **k: main([str(x) for x in a], spark, out=out.append, **k)
    folder = tmp_path / "db"
    assert run("create", folder) == 0 and run("create", folder) == 1
    assert run("run", folder, "table t { id: int @key }") == 0 and run("run", folder, "INSERT INTO t (id) VALUES (1)", "--sql") == 0
    assert run("shell", folder, lines=["# note", "put t { id: 2 }", "get t", "nonsense"]) == 1
    assert run("branch", folder, "b", "--at", 1) == 0 and run("switch", folder, "b") == 0 and run("branches", folder) == 0 and run("log", folder) == 0 and run("tables", folder) == 0
    assert out[-3:] == ["  main @3", "commit 1 parent 0", "t"] and "error: parse error at byte 0: 'nonsense' is not a statement" in "\n".join(out)
    assert run("verify", folder) == 0 and out[-1] == "ok" and run("about", folder) == 0 and run("gc", folder, "--keep", 5) == 0 and out[-1].startswith("gc pruned 0")
    assert run("merge", folder, "main") == 0 and out[-1].startswith("merged main, head is now commit")
    assert run("import", source, tmp_path / "imported") == 0
    assert Database.open(spark, str(tmp_path / "imported")).execute("get nokey { a }").collect() == [(1,), (None,)]
