"""The caller's columns, whatever their names: dots, names that differ in case, names of helpers.

Inside an operator a table's columns have plain names by their places, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def place(docs: DataFrame, name: str) -> int:
    """Where column ``name`` is: the one of exactly that name, or else the only one but for case."""
    if name in docs.columns:
        return docs.columns.index(name)
    alike = [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"{len(alike)} columns are named {name}, of {docs.columns}")
    return alike[0]


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by their places."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def column(docs: DataFrame, name: str) -> str:
    """The name in :func:`plain` of column ``name``."""
    return f"c{place(docs, name)}"


def pick(docs: DataFrame, **kinds: str) -> DataFrame:
    """Columns of ``docs`` by name, cast to these types."""
    return plain(docs).select(*[F.col(column(docs, name)).cast(kind).alias(name) for name, kind in kinds.items()])


def packed(docs: DataFrame, **kinds: str) -> DataFrame:
    """:func:`pick` with the caller's whole row beside it, as struct ``row``."""
    df = plain(docs)
    return df.select(F.struct(*df.columns).alias("row"), *[F.col(column(docs, name)).cast(kind).alias(name) for name, kind in kinds.items()])


def unpacked(df: DataFrame, docs: DataFrame, replaced: dict | None = None, added: dict | None = None) -> DataFrame:
    """The columns of ``docs`` from struct ``row`` of ``df``: those at the places of ``replaced``
    are the given columns instead, and those named as one of ``added`` make room for it."""
    replaced, added = replaced or {}, added or {}
    at = [i for i, c in enumerate(docs.columns) if c not in added]
    values = [replaced.get(i, F.col(f"row.c{i}")).alias(f"c{i}") for i in at] + [c.alias(f"a{i}") for i, c in enumerate(added.values())]
    return df.select(*values).toDF(*[docs.columns[i] for i in at], *added)
