"""Folders that all machines of a cluster reach."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from .errors import StorageError


def mounted(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; one of this machine only where that is unset.

    Stores and blobs keep small files beside the rows, so the folder must be mounted.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        return tempfile.mkdtemp(prefix=f"{name}-")
    at = urlparse(base)
    if at.scheme not in ("", "file"):
        raise StorageError(f"{base} is no mounted folder; create the database in one")
    path = Path(at.path) / f"{name}-{uuid.uuid4().hex}"
    path.mkdir(parents=True)
    return str(path)
