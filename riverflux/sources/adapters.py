"""The general test tables seen as gauge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverflux.schemas import flood_events

SHORT_EVENTS = [("2024-01-05", "2024-01-07", 471.0, "kritisch"), ("2024-01-12", None, 218.0, "erhoht"), ("2024-01-20", "2024-01-22", 289.0, " Erhöht "), ("2024-01-06", "2024-01-06", 403.0, "gefahr")]
LONG_EVENTS = [
    ("1995-03-01", "1995-03-20", 420.0, "kritisch"), ("1996-07-10", "1996-07-25", 380.0, "gefahr"), ("1997-11-01", "1997-11-15", 410.0, "kritisch"),
    ("1995-08-01", "1995-08-31", 250.0, "erhoht"), ("1998-01-10", "1998-01-31", 240.0, "Erhöht"), ("1999-05-01", "1999-05-20", 260.0, "erhoht"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def water_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """January 2024, from events."""
    station = (1 + F.col("user_id") % 4).cast("int")
    return table(spark, sf_dir, "events").select(station.alias("station_id"), F.col("ts").alias("measured_at"), F.col("value").alias("level_cm"), F.col("event_type").alias("source"))


def precipitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    station = (1 + F.col("user_id") % 4).cast("int")
    return table(spark, sf_dir, "events").where("event_type = 'view'").select(station.alias("station_id"), F.col("ts").alias("measured_at"), (F.col("value") / 10).alias("rainfall_mm"))


def water_levels_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1995 to 2001, from orders; one row per station and time."""
    at = F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int))")
    rows = table(spark, sf_dir, "orders").select((1 + F.col("o_custkey") % 4).cast("int").alias("station_id"), at.alias("measured_at"), "o_totalprice")
    return rows.groupBy("station_id", "measured_at").agg((F.max("o_totalprice") / 1000).alias("level_cm")).withColumn("source", F.lit("orders"))


def precipitation_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines as hourly rain: the quantity of an hour's last line above 46 makes it wet."""
    at = F.expr("l_shipdate + make_dt_interval(0, cast(l_orderkey % 24 as int))")
    rows = table(spark, sf_dir, "lineitem").select((1 + F.col("l_suppkey") % 4).cast("int").alias("station_id"), at.alias("measured_at"), F.col("l_quantity").cast("double").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    wet = F.greatest(F.max_by("q", F.struct("line", "q")) - 46, F.lit(0.0)) * 1.5
    return rows.groupBy("station_id", "measured_at").agg(wet.alias("rainfall_mm"))


def short_events(spark: SparkSession) -> DataFrame:
    return flood_events(spark, SHORT_EVENTS)


def long_events(spark: SparkSession) -> DataFrame:
    return flood_events(spark, LONG_EVENTS)
