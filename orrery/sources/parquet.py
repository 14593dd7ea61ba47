"""Parquet folders as read-only tables of the five types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.lower import STAMP
from ..operators.query import TIME
from ..plans.ast import Column
from ..store import Table

#: Keys of the driver's tables; lineitem and embeddings have none that is declared.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",),
    "benchmark": ("item_id",), "conversations": ("conv_id", "turn"), "embeddings": ("vec_id",),
}
#: Columns with a secondary index.
INDEXED = {"customer": ("c_nationkey", "c_mktsegment"), "orders": ("o_custkey",), "nation": ("n_regionkey",), "events": ("event_type",), "documents": ("lang",), "labels": ("quality",)}


def _typed(field: T.StructField) -> tuple[str, object] | None:
    """The engine's type of a Parquet column and how it is read; None if there is none."""
    c = F.col(field.name)
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int", c.cast("bigint")
    if isinstance(field.dataType, T.FloatType):
        return "float", c.cast("double")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return "text", F.date_format(c, STAMP)
    if isinstance(field.dataType, T.DateType):
        return "text", c.cast("string")
    kind = {"bigint": "int", "double": "float", "string": "text", "binary": "bytes", "boolean": "bool"}.get(field.dataType.simpleString())
    return (kind, c) if kind else None


def attach(spark: SparkSession, path: str, name: str, keys: tuple[str, ...] = (), indexed: tuple[str, ...] = ()) -> tuple[Table, DataFrame]:
    """A Parquet file or folder as table ``name``; columns of other types are left out.

    Filters on plain columns and the choice of columns reach the Parquet reader.  Timestamps are
    shown as text; beside each is the timestamp itself, which comparisons with constants use.
    """
    df = spark.read.parquet(path)
    typed = [(f.name, t) for f in df.schema.fields if (t := _typed(f)) is not None]
    times = [F.col(f.name).alias(f.name + TIME) for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    columns = tuple(Column(n, kind, nullable=n not in keys, key=n in keys, index=n in indexed) for n, (kind, _) in typed)
    return Table(name, columns, external=path), df.select(*[c.alias(n) for n, (_, c) in typed], *times)


class Lazy(dict):
    """Tables of a folder, attached when they are first named."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __contains__(self, name) -> bool:
        return name in KEYS

    def __iter__(self):
        return iter(KEYS)

    def __missing__(self, name: str):
        self[name] = attach(self.spark, f"{self.folder}/{name}.parquet", name, KEYS[name], INDEXED.get(name, ()))
        return self[name]
