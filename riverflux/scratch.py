"""Cutting lineage in iterative operators with tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def table_path(spark: SparkSession) -> str:
    """A new place for a table in the folder that spark.checkpoint.dir names. Only a local session may do without
    one: on a cluster a folder of the driver's machine is not the executors'."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = _own["path"] = _own.get("path") or tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


def note(path: str) -> None:
    """Count a table among those of the innermost temporary_tables()."""
    if _scopes:
        _scopes[-1].append(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all tables that were written inside to cut lineages. What a query inside returns has to be
    written out there: it may read these tables."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, where its lineage ends."""
    path = table_path(df.sparkSession)
    note(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
