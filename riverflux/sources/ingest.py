"""Taking in what has landed: pages and archives into the tables of readings, each source by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverflux.operators.storage import run_sources
from riverflux.sources import gauge_pages as P
from riverflux.sources import landed
from riverflux.streaming.levels import upsert_stream

#: Source → kind of its files, parser of the landed rows, table, and the column that later readings of one time replace.
SOURCES: dict[str, tuple[str, Callable[[DataFrame], DataFrame], str, str]] = {
    "saxony": ("pages", lambda rows: P.parse_saxony(landed.as_pages(rows)), "water_levels", "level_cm"),
    "czech": ("pages", lambda rows: P.parse_czech(landed.as_pages(rows)), "water_levels", "level_cm"),
    "rain": ("archives", lambda rows: P.parse_rain_lines(landed.as_rain_lines(rows)), "precipitation", "rainfall_mm"),
}


def take_in(spark: SparkSession, landing: str, tables: str, state: str) -> list[tuple[str, int, str | None]]:
    """(source, rows, error) for each source: the files that have landed at landing/source since the last time are merged into
    the tables in the folder tables, which have a folder for each day. Files that can't be read are left out here and listed by
    landed.failures(); a source that fails as a whole does not keep the others from being taken in, and goes on where it was the next time."""

    def job(source: str) -> Callable[[], int]:
        kind, parse, table, value = SOURCES[source]

        def run() -> int:
            rows = landed.read_landed(spark, f"{landing}/{source}", kind, stream=True)
            query = upsert_stream(parse(rows), f"{tables}/{table}", f"{state}/{source}", None, (value,))
            query.awaitTermination()
            return sum(p["numInputRows"] for p in query.recentProgress)

        return run

    return run_sources({source: job(source) for source in SOURCES})


def readings_of(spark: SparkSession, tables: str, table: str) -> DataFrame:
    """A table as it was taken in, without the day that its folders go by."""
    rows = spark.read.parquet(f"{tables}/{table}")
    return rows.drop("day").withColumn("measured_at", F.col("measured_at").cast("timestamp_ntz"))
