"""Joining points in time with the intervals that hold them, as an equi-join.

An interval is put into buckets of a width that fits its length, so it has at most a handful of them, be it an hour or a
century; a point is put into its one bucket of each width that any interval has. A point and an interval meet in one bucket or
not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverflux.scratch import written

#: Seconds of the narrowest bucket, and how many times wider each next one is. The widest holds some 50 000 years.
NARROWEST, TIMES, LEVELS = 900, 8, 12


def seconds(at: Column) -> Column:
    """Seconds since 1970 of a date or a timestamp with or without zone (as UTC), rounded down."""
    return F.floor(F.unix_micros(at.cast("timestamp_ntz").cast("timestamp")) / 1_000_000)


def width(level: Column) -> Column:
    return (F.lit(NARROWEST) * F.pow(F.lit(TIMES), level)).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The columns of both for each point with start <= at <= end and equal keys (columns of both, kept once).

    Null times, and intervals that end before they start, join with nothing. Columns of one name in both have to be
    renamed before, but for keys. The session's time zone has to be UTC for columns with a zone."""
    length = seconds(F.col(end)) - seconds(F.col(start))
    fits = F.ceil(F.log(F.greatest(length / F.lit(float(NARROWEST)), F.lit(1.0))) / F.log(F.lit(float(TIMES))) - 1e-9)
    level = F.least(F.greatest(fits - 1, F.lit(0)), F.lit(LEVELS - 1)).cast("int")  # TIMES + 2 buckets at most
    spread = intervals.where(F.col(start) <= F.col(end)).withColumn("level_", level)
    buckets = F.sequence(F.floor(seconds(F.col(start)) / width(F.col("level_"))), F.floor(seconds(F.col(end)) / width(F.col("level_"))))
    spread = written(spread.withColumn("bucket_", F.explode(buckets)))
    used = [r["level_"] for r in spread.select("level_").distinct().collect()]  # LEVELS at most
    if not used:
        used = [0]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level_"), F.floor(seconds(F.col(at)) / (NARROWEST * TIMES**k)).alias("bucket_")) for k in used])).alias("b_")
    placed = points.where(F.col(at).isNotNull()).select("*", each).select(*points.columns, "b_.*")
    met = placed.join(spread, [*keys, "level_", "bucket_"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    return met.drop("level_", "bucket_")
