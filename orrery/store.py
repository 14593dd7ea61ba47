"""A versioned store: immutable Parquet snapshots named by immutable numbered states.

``states/N.json`` is the N-th durable change: the current branch, each branch's head and the
floor of its history and, if the change is a commit, its tables.  A state is written under a
name of its own and then linked to its number, which fails if the number is taken: that one step
is the change.  So of two writers that start from one state exactly one succeeds, a writer that
dies leaves either the whole change or nothing that is read, and the newest state is the store.

A store's folder is mounted on every machine; rows are written to it by ``file:`` URIs, never to
the cluster's default file system.
"""

from __future__ import annotations

import copy
import json
import os
import re
import shutil
import tempfile
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq

from .errors import PlanError, StorageError
from .plans.ast import Column, Literal

NO_COMMIT = "no such commit id (it may have been garbage collected)"
LOST = "another writer committed while this transaction was open"
#: Seconds after which files that no commit names are taken for left behind.
ABANDONED_S = 3600


def _to_json(c: Column) -> dict:
    value = c.default.value if c.default else None
    kind = "bytes" if isinstance(value, bytes) else "value"
    return asdict(c) | {"default": None if c.default is None else {kind: value.hex() if kind == "bytes" else value}}


def _of_json(d: dict) -> Column:
    default = d["default"]
    if default is not None:
        default = Literal(bytes.fromhex(default["bytes"]) if "bytes" in default else default["value"])
    return Column(**{**d, "default": default})


@dataclass(frozen=True)
class Table:
    """A table's columns and the snapshots that hold its rows: folders, or files ``folder/file``."""

    name: str
    columns: tuple[Column, ...]
    parts: tuple[str, ...] = ()
    external: str | None = None

    @property
    def keys(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if c.key)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass
class Commit:
    id: int
    parent: int
    ts_ms: int
    tables: dict[str, Table] = field(default_factory=dict)


def check_table(name: str, columns: tuple[Column, ...]) -> None:
    from .functions.values import fitting
    from .errors import ExecError

    seen = set()
    for c in columns:
        if c.name in seen:
            raise PlanError(f"column '{c.name}' is defined twice in table '{name}'")
        seen.add(c.name)
        if c.key and c.nullable:
            raise PlanError(f"key column '{c.name}' cannot be @null")
        if c.default is not None:
            try:
                fitting(c.default.value, c.type, c.nullable)
            except ExecError as e:
                raise PlanError(f"default for column '{c.name}': {e}") from None
    if not any(c.key for c in columns):
        raise PlanError(f"table '{name}' needs at least one @key column")


def numbers(states: Path) -> list[int]:
    try:
        return [int(f.name[:-5]) for f in os.scandir(states) if f.name[:-5].isdigit() and f.name.endswith(".json")]
    except FileNotFoundError:
        return []


def state_of(states: Path, id: int) -> dict:
    try:
        return json.loads((states / f"{id}.json").read_text())
    except FileNotFoundError:
        return {"commit": None}


def _written(folder: Path, body: dict) -> str:
    """A file of its own name with ``body``, on the disk."""
    fd, name = tempfile.mkstemp(dir=folder, suffix=".new")
    with os.fdopen(fd, "w") as f:
        json.dump(body, f)
        f.flush()
        os.fsync(f.fileno())
    return name


def claim(states: Path, state: dict) -> bool:
    """Create the state's file whole, if nobody has; the one step that commits."""
    name = _written(states, state)
    try:
        os.link(name, states / f"{state['txid']}.json")
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(name)


def _replace(path: Path, body: dict) -> None:
    os.replace(_written(path.parent, body), path)


class Store:
    def __init__(self, folder: str):
        self.folder = Path(folder).absolute()
        #: Of snapshots, which never change: bytes, rows of small ones, and relations of those.
        self.sizes, self.held, self.relations = {}, OrderedDict(), OrderedDict()
        self.reload()

    @classmethod
    def create(cls, folder: str) -> "Store":
        path = Path(folder)
        for name in ("states", "data"):
            (path / name).mkdir(parents=True, exist_ok=True)
        first = {"txid": 0, "current": "main", "refs": {"main": {"head": 0, "floor": 0}}, "commit": None}
        if numbers(path / "states") or not claim(path / "states", first):
            raise StorageError("the database exists already")
        return cls(folder)

    def reload(self) -> None:
        """See the newest state."""
        found = numbers(self.folder / "states")
        if not found:
            raise StorageError(f"no database in {self.folder}")
        state = self._state(max(found))
        self.meta = {k: state[k] for k in ("txid", "current", "refs")}

    def _state(self, id: int) -> dict:
        return state_of(self.folder / "states", id)

    def _advance(self, meta: dict, commit: dict | None = None) -> bool:
        """Make ``meta`` the next state; False if another writer made one first."""
        made = claim(self.folder / "states", meta | {"commit": commit})
        if made:
            self.meta = meta
        return made

    # commits

    @property
    def branch(self) -> dict:
        return self.meta["refs"][self.meta["current"]]

    @property
    def head(self) -> int:
        return self.branch["head"]

    def commit(self, id: int) -> Commit:
        if id == 0:
            return Commit(0, 0, 0)
        d = self._state(id)["commit"]
        if d is None:
            raise StorageError(NO_COMMIT)
        tables = {n: Table(n, tuple(map(_of_json, t["columns"])), tuple(t["parts"])) for n, t in d["tables"].items()}
        return Commit(id, d["parent"], d["ts_ms"], tables)

    def at_time(self, ms: int) -> Commit:
        """The newest commit of the current branch that is no later."""
        for c in self.history():
            if c.ts_ms <= ms:
                return c
        if self.branch["floor"]:
            raise StorageError("no commit that old is retained on this branch (raise the gc retention)")
        return self.commit(0)

    def history(self, name: str | None = None):
        yield from self._from(self.meta["refs"][name or self.meta["current"]])

    def _from(self, ref: dict):
        at = ref["head"]
        while at:
            c = self.commit(at)
            yield c
            if at == ref["floor"]:
                return
            at = c.parent

    def publish(self, base: int, tables: dict[str, Table]) -> int:
        """A new commit on the current branch, if nothing durable happened since ``base``."""
        self.reload()
        meta = copy.deepcopy(self.meta)
        id = base + 1
        commit = {"parent": self.head, "ts_ms": time.time_ns() // 1_000_000, "tables": {n: {"columns": [_to_json(c) for c in t.columns], "parts": list(t.parts)} for n, t in tables.items()}}
        meta["txid"] = meta["refs"][meta["current"]]["head"] = id
        if self.meta["txid"] != base or not self._advance(meta, commit):
            raise StorageError(LOST)
        return id

    def new_part(self) -> tuple[str, str]:
        """A name for rows to be written, and the URI to write them to."""
        name = f"{self.meta['txid']}-{uuid.uuid4().hex}"
        return name, self.part_path(name)

    def part_path(self, name: str) -> str:
        return self.part_folder(name).as_uri()

    def part_folder(self, name: str) -> Path:
        return self.folder / "data" / name

    def part_files(self, name: str) -> list[str]:
        """The files of a snapshot, each as a snapshot."""
        return [name] if "/" in name else sorted(f"{name}/{f.name}" for f in os.scandir(self.part_folder(name)) if f.name.endswith(".parquet"))

    def part_of(self, uri: str) -> str:
        """The snapshot that a file is, by its URI."""
        return str(Path(unquote(urlparse(uri).path)).relative_to(self.folder / "data"))

    def part_bytes(self, name: str) -> int:
        return sum(self.part_folder(f).stat().st_size for f in self.part_files(name))

    def write_part(self, rows: pa.Table) -> str:
        """A statement's own rows as a snapshot of one file, on the disk."""
        name, _ = self.new_part()
        self.part_folder(name).mkdir()
        with open(self.part_folder(name) / "part-0.parquet", "wb") as f:
            pq.write_table(rows, f)
            f.flush()
            os.fsync(f.fileno())
        return name

    # branches

    def _change(self, change: Callable[[dict], object]) -> object:
        """Apply ``change`` to the newest state, again if another writer was faster."""
        while True:
            self.reload()
            meta = copy.deepcopy(self.meta)
            out = change(meta)
            meta["txid"] += 1
            if self._advance(meta):
                return out

    def create_branch(self, name: str, at: int | None) -> None:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}", name):
            raise StorageError("branch names are 1 to 64 ascii letters, digits, '_' or '-', starting alphanumeric")

        def change(meta: dict) -> None:
            if name in meta["refs"]:
                raise StorageError("a branch with this name already exists")
            own = meta["refs"][meta["current"]]
            head = own["head"] if at is None else at
            self.commit(head)
            meta["refs"][name] = {"head": head, "floor": own["floor"] if head else 0}

        self._change(change)

    @staticmethod
    def _known(meta: dict, name: str) -> dict:
        if name not in meta["refs"]:
            raise StorageError("no branch with this name")
        return meta["refs"][name]

    def switch(self, name: str) -> None:
        def change(meta: dict) -> None:
            self._known(meta, name)
            meta["current"] = name

        self._change(change)

    def drop_branch(self, name: str) -> None:
        def change(meta: dict) -> None:
            if name == meta["current"]:
                raise StorageError("cannot drop the current branch")
            self._known(meta, name)
            del meta["refs"][name]

        self._change(change)

    def merge(self, name: str) -> int:
        """Move the current branch forward to ``name``'s head."""
        self.reload()
        if name == self.meta["current"]:
            raise StorageError("cannot merge a branch into itself")
        if self._known(self.meta, name)["head"] == self.head:
            return self.head

        def change(meta: dict) -> int:
            own, other = meta["refs"][meta["current"]], self._known(meta, name)
            if own["head"] and own["head"] not in {c.id for c in self._from(other)}:
                raise StorageError("branches have diverged; only fast-forward merges are supported for now")
            own["head"] = other["head"]
            return own["head"]

        return self._change(change)

    def gc(self, keep: int) -> tuple[int, int]:
        """Keep the newest ``keep`` commits of each branch; commits pruned, once for each branch
        that reached them, and files freed.

        Rows of pruned commits go at once.  Rows that no commit names may be those of a writer
        that hasn't committed yet and go when they are ``ABANDONED_S`` old.
        """
        if keep < 1:
            raise StorageError("gc must retain at least one commit per branch")

        def change(meta: dict) -> tuple[int, set[int], set[int]]:
            before, kept, pruned = set(), set(), 0
            for ref in meta["refs"].values():
                ids = [c.id for c in self._from(ref)]
                before |= set(ids)
                if len(ids) > keep:
                    ref["floor"] = ids[keep - 1]
                    pruned += len(ids) - keep
                kept |= set(ids[:keep])
            return pruned, before - kept, kept

        pruned, gone, kept = self._change(change)
        named = lambda ids: {p for id in ids for t in self.commit(id).tables.values() for p in t.parts}
        live, now, freed = named(kept), time.time(), 0
        dead = named(gone) - live
        states = self.folder / "states"
        for id in numbers(states):
            if id in kept or id >= self.meta["txid"]:
                continue
            path = states / f"{id}.json"
            if self._state(id)["commit"] is None and now - path.stat().st_mtime > ABANDONED_S:
                path.unlink(missing_ok=True)
            elif id in gone:  # the number stays taken for writers that saw an older state
                _replace(path, {"commit": None})
        in_use, were = {p.split("/")[0] for p in live}, {p.split("/")[0] for p in dead}
        for path in (self.folder / "data").iterdir():
            if path.name not in in_use and (path.name in were or now - path.stat().st_mtime > ABANDONED_S):
                freed += sum(len(files) for _, _, files in os.walk(path))
                shutil.rmtree(path, ignore_errors=True)
            elif path.name in were and path.name not in live:  # some of its files are in use
                for name in set(self.part_files(path.name)) - live:
                    self.part_folder(name).unlink(missing_ok=True)
                    freed += 1
        return pruned, freed

    def stats(self) -> dict[str, int]:
        """Numbers and bytes of files: of all rows, of those that the current head names, and
        of those that no retained commit names."""
        sizes = {f: self.part_folder(f).stat().st_size for p in (self.folder / "data").iterdir() for f in self.part_files(p.name)}
        commits = {c.id: c for ref in self.meta["refs"].values() for c in self._from(ref)}
        files = lambda cs: {f for p in {p for c in cs for t in c.tables.values() for p in t.parts} for f in self.part_files(p)}
        head, live = files([self.commit(self.head)]), files(commits.values())
        out = {"commits": len(commits), "branches": len(self.meta["refs"])}
        for name, chosen in (("all", set(sizes)), ("head", head), ("free", set(sizes) - live)):
            out |= {f"{name}_files": len(chosen), f"{name}_bytes": sum(sizes[f] for f in chosen)}
        return out
