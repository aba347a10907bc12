"""What a dashboard shows, read from the readings and from the predictions table; results are kept for a while."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverflux.scratch import table_path

#: Seconds for which a result is kept.
KEPT = 300


class TableCache:
    """Results as tables by key, made again when they are older than ttl seconds. A table that is read when its
    successor is made stays where it is, so a running query never loses its input."""

    def __init__(self, ttl: float = KEPT, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = ttl, clock
        self.made: dict[tuple, tuple[float, str]] = {}

    def get(self, spark: SparkSession, key: tuple, make: Callable[[str], None]) -> DataFrame:
        """The table of key; make(path) writes it."""
        key = (spark.sparkContext.applicationId, *key)
        at, path = self.made.get(key, (float("-inf"), ""))
        if self.clock() - at >= self.ttl:
            path = table_path(spark)
            make(path)
            self.made[key] = (self.clock(), path)
        return spark.read.parquet(path)


def latest_prediction(predictions: DataFrame, day: Column, station: int = 1) -> DataFrame:
    """The day's prediction of a station that was made last; no row if there is none."""
    rows = predictions.where((F.col("for_date") == day) & (F.col("station_id") == station))
    return rows.orderBy(F.desc("predicted_at"), F.desc("prediction_id")).limit(1)


def forecast_series(predictions: DataFrame, day: Column, days: int = 7, station: int = 1) -> DataFrame:
    """The predictions from so many days before the day on."""
    rows = predictions.where((F.col("station_id") == station) & (F.col("for_date") >= F.date_sub(day, days)))
    return rows.select("for_date", "risk_level", "p_normal", "p_erhoht", "p_gefahr", "level_6h_cm", "level_12h_cm", "level_24h_cm", "high_confidence", "is_anomaly").orderBy("for_date")


def forecast_points(predictions: DataFrame, station: int = 1) -> DataFrame:
    """time, level_cm: each forecast at the time that it is for."""
    points = predictions.where(F.col("station_id") == station).selectExpr("for_date", "stack(3, 6, level_6h_cm, 12, level_12h_cm, 24, level_24h_cm) as (h, v)")
    return points.selectExpr("cast(for_date as timestamp_ntz) + make_dt_interval(0, h) as time", "v as level_cm")


def kpi_row(latest: DataFrame, prediction: DataFrame) -> DataFrame:
    """The last level with its change beside the prediction's risk, forecast and confidence, which are null without one.
    latest: one row of latest_cm and delta_cm; prediction: of latest_prediction()."""
    return latest.join(prediction.select("risk_level", "level_24h_cm", "high_confidence"), F.lit(True), "left")  # one row each at most
