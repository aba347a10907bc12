"""Sessions: one place for the settings that results depend on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "riverflux", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and, where none is named, a checkpoint folder (local runs)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-checkpoint-"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
