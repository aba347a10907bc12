"""Scalar rules: time zones, labels, bins. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BERLIN, PRAGUE = "Europe/Berlin", "Europe/Prague"
RISKS = ("NORMAL", "ERHOHT", "GEFAHR")
RAIN_BINS = ("NONE", "LIGHT", "HEAVY")
UPSTREAM_BINS = ("LOW", "MEDIUM", "HIGH")
SEASONS = ("SPRING", "SUMMER", "AUTUMN", "WINTER")
SOILS = ("DRY", "MOIST", "SATURATED")
FEATURES = ("max_level_cm", "avg_level_cm", "max_rate_cm_h", "total_precip_mm", "upstream_max_cm")
#: Display names and colours of the risks.
BADGES = {"NORMAL": ("Normal", "#2ecc71"), "ERHOHT": ("Erhöht", "#f39c12"), "GEFAHR": ("Gefahr", "#e74c3c")}
# Alarm stages in cm.
STAGES = {"stage_1": 200.0, "stage_3": 350.0}


def local_time(utc: Column, tz: str = BERLIN) -> Column:
    """Wall-clock time of a UTC timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def local_day(utc: Column, tz: str = BERLIN) -> Column:
    return local_time(utc, tz).cast("date")


def utc_of_local(local: Column, tz: str) -> Column:
    """UTC of a wall-clock time without zone; in the autumn hour that comes twice the first, in the spring
    hour that is missing an hour later."""
    return F.to_utc_timestamp(local.cast("timestamp"), tz).cast("timestamp_ntz")


def parse_label(category: Column) -> Column:
    c = F.lower(F.trim(category))
    return F.when(c.isin("erhoht", "erhöht"), "ERHOHT").when(c.isin("kritisch", "gefahr"), "GEFAHR").otherwise("NORMAL")


def ordinal(name: Column, of: tuple[str, ...]) -> Column:
    return (F.array_position(F.array(*map(F.lit, of)), name) - 1).cast("int")


def season(day: Column) -> Column:
    m = F.month(day)
    return F.when(m.between(3, 5), "SPRING").when(m.between(6, 8), "SUMMER").when(m.between(9, 11), "AUTUMN").otherwise("WINTER")


def rain_bin(mm: Column) -> Column:
    return F.when(mm < 1.0, "NONE").when(mm < 10.0, "LIGHT").otherwise("HEAVY")


def upstream_bin(cm: Column) -> Column:
    return F.when(cm < 100, "LOW").when(cm < 300, "MEDIUM").otherwise("HIGH")


def soil_moisture(day: Column, mm: Column) -> Column:
    """Wet springs and winters saturate the soil, rainless summers and autumns dry it."""
    s = season(day)
    wet = ((s == "SPRING") & (mm > 5)) | ((s == "WINTER") & (mm > 3))
    return F.when(wet, "SATURATED").when((mm < 1) & s.isin("SUMMER", "AUTUMN"), "DRY").otherwise("MOIST")


def partition_label(utc: Column) -> Column:
    """The range partition of a reading: one for 2000 to 2023, one for each of 2024 to 2026, else default."""
    y = F.year(utc)
    return F.when(y.between(2000, 2023), "hist").when(y.between(2024, 2026), y.cast("string")).otherwise("default")


def describe_arrival(hours: Column, now_hour: Column) -> Column:
    rounded = F.round(hours).cast("int")
    return F.concat(F.lit("~"), rounded.cast("string"), F.lit(" Stunden (Ankunft gegen "), F.lpad(((now_hour + rounded) % 24).cast("string"), 2, "0"), F.lit(":00 Uhr)"))


def seasonal_wave(day: Column) -> tuple[Column, Column]:
    angle = F.lit(2 * 3.141592653589793) * F.dayofyear(day) / 365
    return F.sin(angle), F.cos(angle)
