"""Two writers of one store, interleaved at every step, and writers that die."""

import os
import signal
import subprocess
import sys

import pytest

from orrery import store as stores
from orrery.errors import EngineError, StorageError
from orrery.session import Database, Session
from orrery.store import Store, Table

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def made(tmp_path):
    Store.create(f"{tmp_path}/db").publish(0, {"a": Table("a", ())})
    return f"{tmp_path}/db"


@pytest.mark.parametrize("step", ["_written", "claim", "link", "unlink"])
def test_one_of_two_commits_wins_at_every_step(tmp_path, monkeypatch, step):
    folder = made(tmp_path)
    first, second = Store(folder), Store(folder)
    base, calls, real = first.meta["txid"], [], getattr(os if step in ("link", "unlink") else stores, step)

    def interrupted(*args):
        if not calls:  # the other writer goes all the way just before this step of the first
            calls.append(step)
            calls.append(outcome(lambda: second.publish(base, {"b": Table("b", ())})))
        return real(*args)

    monkeypatch.setattr(os if step in ("link", "unlink") else stores, step, interrupted)
    got = outcome(lambda: first.publish(base, {"c": Table("c", ())}))
    monkeypatch.undo()
    assert sorted(map(str, (got, calls[1]))) == sorted(("2", str(StorageError(stores.LOST))))
    now = Store(folder)
    assert now.head == 2 and set(now.commit(2).tables) == ({"c"} if got == 2 else {"b"})
    assert not list(now.folder.glob("states/*.new"))


def outcome(f):
    try:
        return f()
    except StorageError as e:
        return str(e)


@pytest.mark.parametrize("change", ["branch", "switch", "merge", "drop", "gc"])
def test_a_commit_and_a_branch_change_keep_each_other(tmp_path, monkeypatch, change):
    folder = made(tmp_path)
    one, two = Store(folder), Store(folder)
    one.create_branch("side", None)
    if change == "merge":
        one.switch("side")
        one.publish(one.meta["txid"], {"m": Table("m", ())})
        one.switch("main")
    real, done = os.link, []

    def link(*args):
        if not done:
            done.append(True)
            two.reload()
            done.append(outcome(lambda: two.publish(two.meta["txid"], {"x": Table("x", ())})))
        return real(*args)

    monkeypatch.setattr(os, "link", link)
    acts = {"branch": lambda: one.create_branch("new", None), "switch": lambda: one.switch("side"), "merge": lambda: one.merge("side"), "drop": lambda: one.drop_branch("side"), "gc": lambda: one.gc(1)}
    got = outcome(acts[change])
    monkeypatch.undo()
    now = Store(folder)
    assert set(now.commit(done[1]).tables) == {"x"} and now.meta["refs"]["main"]["head"] == done[1]
    if change == "merge":  # main has moved on, so that the branches have diverged
        assert "diverged" in got
    elif change == "branch":
        assert now.meta["refs"]["new"]["head"] == done[1]
    else:
        assert {"switch": now.meta["current"] == "side", "drop": "side" not in now.meta["refs"], "gc": [c.id for c in now.history()] == [done[1]]}[change]


def test_gc_spares_what_an_open_writer_wrote(spark, tmp_path):
    db = Database.create(spark, f"{tmp_path}/db")
    db.execute("table t { id: int @key }")
    writer = Session(spark, Store(f"{tmp_path}/db"))
    writer.execute("begin")
    writer.execute("put t { id: 1 }")
    db.execute("gc keep 1")
    assert writer.execute("get t").collect() == [(1,)]
    with pytest.raises(StorageError, match="another writer committed"):
        writer.execute("commit")
    db.execute("begin")
    with pytest.raises(EngineError, match="cannot run inside a transaction"):
        db.gc(1)
    db.execute("rollback")
    stats = db.stats()
    assert stats["free_files"] > 0 and stats["head_files"] == 0 and stats["commits"] == 1


def test_a_number_of_a_pruned_commit_stays_taken(tmp_path):
    folder = made(tmp_path)
    late = Store(folder)
    base = late.meta["txid"]
    other = Store(folder)
    for name in "bcd":
        other.publish(other.meta["txid"], {name: Table(name, ())})
    other.gc(1)
    late.reload = lambda: None  # as if the others had been faster after it looked
    with pytest.raises(StorageError, match="another writer"):
        late.publish(base, {"lost": Table("lost", ())})
    assert set(Store(folder).commit(Store(folder).head).tables) == {"d"}


@pytest.mark.parametrize("step, whole", [("_written", False), ("link", False), ("unlink", True)])
def test_killed_writers_leave_all_or_nothing(tmp_path, step, whole):
    folder = made(tmp_path)
    place = "s" if step == "_written" else "os"
    code = f"""
import os, signal
import orrery.store as s
st = s.Store({folder!r})
{place}.{step} = lambda *a: os.kill(os.getpid(), signal.SIGKILL)
st.publish(st.meta["txid"], {{"z": s.Table("z", ())}})
"""
    died = subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=60)
    assert died.returncode == -signal.SIGKILL
    now = Store(folder)
    assert set(now.commit(now.head).tables) == ({"z"} if whole else {"a"})
    now.publish(now.meta["txid"], {"after": Table("after", ())})
    assert set(Store(folder).commit(now.head).tables) == {"after"}
