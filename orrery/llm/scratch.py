"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``; every later read can be
repeated on another executor.  A folder of its own is made only where that setting is absent.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder named by the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


class Scratch:
    """Named tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.saved = spark, set()
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table.  Snappy keeps no memory outside the heap between files."""
        df.write.mode("overwrite").option("compression", "snappy").parquet(self.path(name))
        self.saved.add(name)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing returned to the caller still reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.saved.discard(name)

    def keep(self, *names: str) -> None:
        """Delete all tables but these, which the caller still reads."""
        self.drop(*(self.saved - set(names)))
