"""Daily profiles kept up to date by streams: a batch of readings touches the summaries of its days only.

A day's summary holds what profiles need of it: extremes, sums, and the first and last reading of each station. The change across
midnight is the difference of the one's last and the other's first, so a late reading changes its own day's
summary and, through it, the profile of the next day, without reading that day again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riverflux.functions.risk import BERLIN, local_day
from riverflux.operators.readings import flood_days
from riverflux.streaming.levels import upsert_stream


def level_days(rows: DataFrame) -> DataFrame:
    """The summary of each day (column day) and station; a window holds one day of a station."""
    w = Window.partitionBy("station_id", "day").orderBy("measured_at")
    steps = rows.withColumn("rate", F.abs(F.col("level_cm") - F.lag("level_cm").over(w)))
    ends = [f("level_cm", "measured_at").alias(c) for f, c in ((F.min_by, "first_cm"), (F.max_by, "last_cm"))]
    return steps.groupBy("station_id", "day").agg(F.max("level_cm").alias("max_cm"), F.sum("level_cm").alias("sum_cm"), F.count("level_cm").alias("n"), F.max("rate").alias("rate"), *ends)


def rain_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day").agg(F.sum("rainfall_mm").alias("total_precip_mm"))


def keep_levels(levels: DataFrame, target: str, checkpoint: str, order: str | None = None, tz: str = BERLIN) -> StreamingQuery:
    """Readings at target, their days' summaries at target + "-days"."""
    return upsert_stream(levels, target, checkpoint, order, ("level_cm",), lambda t: local_day(t.cast("timestamp_ntz"), tz), level_days)


def keep_rain(rain: DataFrame, target: str, checkpoint: str, order: str | None = None, tz: str = BERLIN) -> StreamingQuery:
    return upsert_stream(rain, target, checkpoint, order, ("rainfall_mm",), lambda t: local_day(t.cast("timestamp_ntz"), tz), rain_days)


def profiles_of_days(levels: DataFrame, rain: DataFrame, events: DataFrame, station: int = 1, upstream: int = 3) -> DataFrame:
    """daily_profiles() from the summaries of days: a row for each day and station is all that is read."""
    before = F.lag("last_cm").over(Window.partitionBy("station_id").orderBy("day"))  # days, not readings
    rows = levels.where(F.col("station_id").isin(station, upstream)).withColumn("across", F.abs(F.col("first_cm") - before))
    pick = lambda s, c: F.max(F.when(F.col("station_id") == s, c))
    both = rows.groupBy("day").agg(
        pick(station, F.col("max_cm")).alias("max_level_cm"), pick(station, F.col("sum_cm") / F.col("n")).alias("avg_level_cm"), pick(station, F.greatest("rate", "across")).alias("rate"),
        pick(upstream, F.col("max_cm")).alias("up"), F.max(F.when(F.col("station_id") == station, True)).alias("is_main"),
    )
    zero = F.lit(0.0)
    out = both.where("is_main").join(rain, "day", "left").join(flood_days(events), "day", "left")
    return out.select("day", "max_level_cm", "avg_level_cm", F.coalesce("rate", zero).alias("max_rate_cm_h"), F.coalesce("total_precip_mm", zero).alias("total_precip_mm"), F.coalesce("up", zero).alias("upstream_max_cm"), F.col("category").alias("label"))
