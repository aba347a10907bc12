"""Streams of readings: idempotent upserts with summaries of days, hourly means with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riverflux.operators.storage import upsert

KEYS = ["station_id", "measured_at"]


def read_levels(spark: SparkSession, path: str, schema: str, files: int = 64) -> DataFrame:
    """Files that land in a folder, so many in a batch at most, which bounds what a station gets at once; watermarks
    need timestamps with a zone, so the UTC time is cast."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("measured_at", F.col("measured_at").cast("timestamp"))


def _at(spark: SparkSession, path: str):
    """A path and the file system that it is in, which may be any that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def upsert_stream(
    rows: DataFrame, target: str, checkpoint: str, order: str | None = None, update: tuple[str, ...] = ("level_cm",), day: Callable[[Column], Column] = F.to_date, summary: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Merge each batch into the table at target, which has a folder for each day of readings.

    A batch reads and writes only the days it touches. They are staged beside the checkpoint before they replace
    the table's; a batch that is run again replaces them from there, so a restart neither loses nor repeats
    rows. order: the column that tells which of a batch's readings for one key is the last; without one it is the largest.
    summary: of the touched days' rows (with day), kept in the same way at target + "-days"."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{checkpoint}-staged/batch={batch_id}"
        if not _exists(spark, f"{staged}/_SUCCESS"):
            new = batch.withColumn("day", day(F.col("measured_at")))
            days = [r.day for r in new.select("day").distinct().collect()]  # the days of one batch
            extra = [order] if order and order not in update else []
            old = spark.read.parquet(target).where(F.col("day").isin(days)) if _exists(spark, target) else new.drop(*extra).limit(0)
            upsert(old, new, KEYS, list(update), order or F.lit(0)).write.mode("overwrite").parquet(staged)
        whole = spark.read.parquet(staged)
        _replace_days(whole.repartition("day").sortWithinPartitions(*KEYS), target)
        if summary is not None:
            _replace_days(summary(whole), f"{target}-days")
        if batch_id:
            fs, p = _at(spark, f"{checkpoint}-staged/batch={batch_id - 1}")
            fs.delete(p, True)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _replace_days(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def hourly_means(levels: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Tumbling hourly means; readings that come later than delay are left out."""
    windows = levels.withWatermark("measured_at", delay).groupBy("station_id", F.window("measured_at", "1 hour"))
    return windows.agg(F.avg("level_cm").alias("level_cm"), F.count("*").alias("n")).select("station_id", F.col("window.start").alias("hour"), "level_cm", "n")
