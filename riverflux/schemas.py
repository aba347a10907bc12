"""Table schemas and the reference rows that come with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STATIONS = "station_id int, name string, country string, river string, latitude double, longitude double, km_to_goerlitz double"
WATER_LEVELS = "station_id int, measured_at timestamp_ntz, level_cm double, source string"
PRECIPITATION = "station_id int, measured_at timestamp_ntz, rainfall_mm double"
FLOOD_EVENTS = "event_id int, start_date date, end_date date, peak_level_cm double, category string, description string"
PREDICTIONS = (
    "prediction_id int, station_id int, for_date date, predicted_at timestamp_ntz, risk_level string, p_normal double, p_erhoht double, p_gefahr double, "
    "level_6h_cm double, level_12h_cm double, level_24h_cm double, travel_hours double, is_anomaly boolean, dbscan_cluster int, high_confidence boolean"
)

# The gauge stations.
STATION_ROWS = [
    (1, "Goerlitz", "DE", "Neisse", 51.1528, 14.9872, 0.0),
    (2, "Zittau", "DE", "Neisse", 50.8965, 14.8076, 35.0),
    (3, "Hradek nad Nisou", "CZ", "Nisa", 50.8600, 14.8400, 40.0),
    (4, "Liberec", "CZ", "Nisa", 50.7671, 15.0562, 80.0),
]

# Historical floods (start, end, peak in cm, category).
FLOOD_ROWS = [
    ("2024-09-13", "2024-09-18", 471.0, "kritisch"),
    ("2013-06-04", "2013-06-10", 637.0, "kritisch"),
    ("2013-01-19", "2013-01-23", 234.0, "erhoht"),
    ("2010-08-07", "2010-08-13", 547.0, "kritisch"),
    ("2010-05-16", "2010-05-21", 403.0, "kritisch"),
    ("2006-04-04", "2006-04-08", 347.0, "kritisch"),
    ("2006-03-28", "2006-03-30", 218.0, "erhoht"),
    ("2005-08-25", "2005-08-28", 289.0, "erhoht"),
    ("2002-08-12", "2002-08-17", 621.0, "kritisch"),
    ("1981-07-25", "1981-07-28", 598.0, "kritisch"),
]


def stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATION_ROWS, STATIONS)


def flood_events(spark: SparkSession, rows=FLOOD_ROWS) -> DataFrame:
    """Event intervals; start and end as ISO dates, the end may be None."""
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "event_id int, s string, e string, peak_level_cm double, category string")
    return df.selectExpr("event_id", "cast(s as date) as start_date", "cast(e as date) as end_date", "peak_level_cm", "category", "cast(null as string) as description")
