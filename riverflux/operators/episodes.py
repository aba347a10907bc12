"""Flood episodes: runs of readings at or above a stage, on tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverflux.functions.risk import STAGES, local_day
from riverflux.operators.ordering import numbered


def runs(rows: DataFrame, keys: list[str], start: str, end: str, gap: Column) -> DataFrame:
    """rows with run: how many pauses longer than gap lie before each within its keys."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    pause = F.when(F.col(start) - F.lag(end).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("new_", pause).withColumn("run", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new_")


def episodes(levels: DataFrame, stage: float = STAGES["stage_1"], gap_minutes: int = 360) -> DataFrame:
    """station_id, start_at, end_at, peak_level_cm, peak_at (the first of equal ones), n_readings of each run of readings of
    stage or more without a pause of over gap_minutes.

    Runs are found within a month, and then those of a station are joined where the pause between them is short: a
    task holds a month's readings or a station's runs, never its whole history."""
    gap = F.expr(f"INTERVAL {int(gap_minutes)} MINUTES")
    high = levels.where(F.col("level_cm") >= stage).select("station_id", "measured_at", "level_cm", F.trunc("measured_at", "month").alias("month"))
    peak = F.min(F.struct((-F.col("level_cm")).alias("low"), F.col("measured_at").alias("at")))
    parts = runs(high, ["station_id", "month"], "measured_at", "measured_at", gap).groupBy("station_id", "month", "run")
    parts = parts.agg(F.min("measured_at").alias("start_at"), F.max("measured_at").alias("end_at"), peak.alias("peak"), F.count("*").alias("n")).drop("run")
    whole = runs(parts, ["station_id"], "start_at", "end_at", gap).groupBy("station_id", "run")
    out = whole.agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.min("peak").alias("peak"), F.sum("n").alias("n_readings"))
    return out.select("station_id", "start_at", "end_at", (-F.col("peak.low")).alias("peak_level_cm"), F.col("peak.at").alias("peak_at"), "n_readings")


def episode_stream(levels: DataFrame, stage: float = STAGES["stage_1"], gap_minutes: int = 360, delay: str = "2 hours") -> DataFrame:
    """The same of a stream of readings (measured_at with a zone), each when it is over: sessions, whose state is one row
    for each open episode. Readings that come later than delay are left out."""
    high = levels.where(F.col("level_cm") >= stage).withWatermark("measured_at", delay)
    # a session ends gap after its last reading; a reading at that very time still belongs to it in episodes()
    session = F.session_window("measured_at", f"{gap_minutes * 60_000_000 + 1} microseconds")
    peak = F.min(F.struct((-F.col("level_cm")).alias("low"), F.col("measured_at").alias("at"))).alias("peak")
    out = high.groupBy("station_id", session).agg(F.min("measured_at").alias("start_at"), F.max("measured_at").alias("end_at"), peak, F.count("*").alias("n_readings"))
    return out.select("station_id", "start_at", "end_at", (-F.col("peak.low")).alias("peak_level_cm"), F.col("peak.at").alias("peak_at"), "n_readings")


def category(peak: Column) -> Column:
    return F.when(peak >= STAGES["stage_3"], "kritisch").otherwise("erhoht")


def flood_events(found: DataFrame, levels: DataFrame, gap_minutes: int = 360) -> DataFrame:
    """Episodes as rows of the flood_events table, numbered by their start; one that may still go on at the station's last reading
    has no end. Days are local."""
    last = levels.groupBy("station_id").agg(F.max("measured_at").alias("last_at"))
    open_ = F.col("end_at") + F.expr(f"INTERVAL {int(gap_minutes)} MINUTES") >= F.col("last_at")
    rows = found.join(last, "station_id").select("station_id", "start_at", local_day(F.col("start_at")).alias("start_date"), F.when(~open_, local_day(F.col("end_at"))).alias("end_date"), "peak_level_cm", category(F.col("peak_level_cm")).alias("category"))
    named = numbered(rows, ["start_at", "station_id"], "event_id").withColumn("event_id", F.col("event_id").cast("int"))
    return named.select("event_id", "station_id", "start_date", "end_date", "peak_level_cm", "category", F.format_string("%.0f cm", "peak_level_cm").alias("description"))
