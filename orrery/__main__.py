"""python -m orrery create|import|run|shell|tables|branches|branch|switch|merge|log|gc|verify|stats|about|serve|token FOLDER ...

and python -m orrery connect HOST:PORT"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .errors import EngineError
from .plans import pretty
from .server import Client, Server
from .session import Database
from .tokens import Tokens


def spark_session() -> SparkSession:
    spark = SparkSession.builder.appName("orrery").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str] | None = None, spark: SparkSession | None = None, lines=None, out=print) -> int:
    parser = argparse.ArgumentParser(prog="orrery", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, extra in {"create": (), "run": ("statement",), "shell": (), "tables": (), "branches": (), "branch": ("name",), "switch": ("name",), "merge": ("name",), "log": (), "gc": (), "verify": (), "stats": (), "about": ()}.items():
        p = verbs.add_parser(verb)
        p.add_argument("folder")
        for name in extra:
            p.add_argument(name)
        p.add_argument("--sql", action="store_true")
        if verb == "gc":
            p.add_argument("--keep", type=int, default=1)
        if verb == "branch":
            p.add_argument("--at", type=int)
    p = verbs.add_parser("serve")
    p.add_argument("folder")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=7400)
    p = verbs.add_parser("token")
    p.add_argument("folder")
    p.add_argument("action", choices=("add", "revoke", "list"))
    p.add_argument("name", nargs="?", default="")
    p = verbs.add_parser("connect")
    p.add_argument("address")
    p.add_argument("--token", default=os.environ.get("ORRERY_TOKEN", ""))
    p.add_argument("--sql", action="store_true")
    p = verbs.add_parser("import")
    p.add_argument("source")
    p.add_argument("folder")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    a = parser.parse_args(args)
    try:
        if a.verb == "token":
            return _token(a, out)
        if a.verb == "connect":
            return _connect(a, lines, out)
        spark = spark or spark_session()
        if a.verb == "serve":
            with Server(spark, a.folder, a.host, a.port) as server:
                out(f"serving {a.folder} at {server.server_address[0]}:{server.server_address[1]}")
                server.serve_forever()
        if a.verb == "create":
            Database.create(spark, a.folder)
            return 0
        if a.verb == "import":
            from .sources.sqlite_import import import_file

            db = Database.in_memory(spark) if a.dry_run else Database.create(spark, a.folder)
            for line in import_file(db, a.source, a.strict, a.dry_run):
                out(line)
            return 0
        db = Database.open(spark, a.folder)
        if a.verb == "verify":
            for line in (wrong := db.verify()) or ["ok"]:
                out(line)
            return int(bool(wrong))
        if a.verb in ("stats", "about"):
            told = {"branch": db.branch(), "head": db.head()} if a.verb == "about" else {}
            for k, v in {**told, **db.stats()}.items():
                out(f"{k} {v}")
            return 0
        if a.verb == "shell":
            failed = 0
            for line in sys.stdin if lines is None else lines:
                if not (line := line.strip()) or line.startswith("#"):
                    continue
                for text in (found := db.session.script([line], "sql" if a.sql else "native")[0]):
                    out(text)
                failed += bool(found and found[0].startswith("error: "))
            return int(failed > 0)
        statement = {
            "tables": "show tables",
            "branches": "show branches",
            "log": "log",
            "gc": f"gc keep {getattr(a, 'keep', 1)}",
            "branch": f"branch {getattr(a, 'name', '')}" + (f" at {a.at}" if getattr(a, "at", None) is not None else ""),
        }.get(a.verb, f"{a.verb} {getattr(a, 'name', '')}")
        run = db.execute_sql if a.sql else db.execute
        for text in run(a.statement if a.verb == "run" else statement).render():
            out(text)
        return 0
    except EngineError as e:
        out(f"error: {e}")
        return 1


def _token(a, out) -> int:
    tokens = Tokens(a.folder)
    if a.action == "add":
        out(tokens.add(a.name))
    elif a.action == "revoke":
        tokens.revoke(a.name)
    else:
        for name in tokens.names():
            out(name)
    return 0


def _connect(a, lines, out) -> int:
    """A shell over a connection."""
    host, _, port = a.address.rpartition(":")
    client, failed = Client(host, int(port), a.token), 0
    for line in sys.stdin if lines is None else lines:
        if not (line := line.strip()) or line.startswith("#"):
            continue
        try:
            for r in client.execute(line, "sql" if a.sql else "native"):
                out(r if isinstance(r, str) else "|".join(v if isinstance(v, str) else pretty.value(v) for v in r))
        except EngineError as e:
            failed += 1
            out(f"error: {e}")
    client.close()
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
