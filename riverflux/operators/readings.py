"""Operators over gauge readings: windows that scale in time, daily profiles, hourly series."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from riverflux.functions.risk import BERLIN, local_day, parse_label
from riverflux.operators.ordering import numbered


#: Bytes, as Spark estimates them, up to which a whole table may be ordered in one task per station.
WHOLE = 256 << 20


def with_context(df: DataFrame, keys: list[str], order: str, span: Column, n: int) -> DataFrame:
    """df with span and carried: each span of a key also gets the n rows before it, marked as carried.

    A window over (keys, span) then sees all that a frame of n rows back needs, and no task holds
    more than one span: a window over the keys alone would put a station's whole history in one.
    """
    rows = df.withColumn("span", span)
    last = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "span").orderBy(F.desc(order)))).where(F.col("__r") <= n)
    tails = last.groupBy(*keys, "span").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (order, *keys)]))).alias("tail"))
    # one row for each span: n spans back hold at least n rows
    before = F.flatten(F.collect_list("tail").over(Window.partitionBy(*keys).orderBy("span").rowsBetween(-n, -1)))
    carried = tails.select(*keys, "span", before.alias("b")).where(F.size("b") > 0).select(*keys, "span", F.explode(F.slice("b", F.greatest(F.size("b") - n + 1, F.lit(1)), n)).alias("x"))
    carried = carried.select(*[F.col(c) if c in keys else F.col("x")[c].alias(c) for c in df.columns], "span", F.lit(True).alias("carried"))
    return rows.withColumn("carried", F.lit(False)).unionByName(carried)


def in_order(readings: DataFrame, n: int) -> tuple[DataFrame, WindowSpec]:
    """The readings and a window in which each row sees the n rows of its station before it.

    A small table is ordered by station, with one shuffle. A larger one is cut into months with the rows before them
    as context, marked as carried, so that no task holds a station's whole history."""
    size = int(readings._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size <= WHOLE:
        return readings.withColumn("carried", F.lit(False)), Window.partitionBy("station_id").orderBy("measured_at")
    return with_context(readings, ["station_id"], "measured_at", F.trunc("measured_at", "month"), n), Window.partitionBy("station_id", "span").orderBy("measured_at")


def level_analysis(levels: DataFrame) -> DataFrame:
    """Each reading with the mean of the last 7 readings of its station and the signed change."""
    rows, w = in_order(levels.select("station_id", "measured_at", "level_cm"), 6)
    out = rows.withColumns({"avg_7h": F.avg("level_cm").over(w.rowsBetween(-6, 0)), "rate_cm_h": F.col("level_cm") - F.lag("level_cm").over(w)})
    return out.where("not carried").select("station_id", "measured_at", "level_cm", "avg_7h", "rate_cm_h")


def in_time(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of [start, end), UTC."""
    return rows.where((F.col("measured_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("measured_at") < F.lit(end).cast("timestamp_ntz")))


def absolute_rates(levels: DataFrame, start: str, end: str, stations: list[int] | None = None, tz: str = BERLIN) -> DataFrame:
    """Readings of [start, end) with their local day and absolute change; the first in range has none."""
    rows = in_time(levels, start, end)
    if stations:
        rows = rows.where(F.col("station_id").isin(stations))
    rows, w = in_order(rows.select("station_id", "measured_at", "level_cm"), 1)
    out = rows.withColumns({"day": local_day(F.col("measured_at"), tz), "rate_cm_h": F.abs(F.col("level_cm") - F.lag("level_cm").over(w))})
    return out.where("not carried").select("day", "station_id", "measured_at", "level_cm", "rate_cm_h")


def daily_levels(rates: DataFrame) -> DataFrame:
    return rates.groupBy("day", "station_id").agg(F.max("level_cm").alias("max_level_cm"), F.avg("level_cm").alias("avg_level_cm"), F.max("rate_cm_h").alias("max_rate_cm_h"))


def daily_rain(rain: DataFrame, start: str, end: str, tz: str = BERLIN, stations: list[int] | None = None) -> DataFrame:
    """Rain by local day; all stations together unless some are named."""
    rows = in_time(rain, start, end)
    if stations:
        rows = rows.where(F.col("station_id").isin(stations))
    return rows.groupBy(local_day(F.col("measured_at"), tz).alias("day")).agg(F.sum("rainfall_mm").alias("total_precip_mm"))


def flood_days(events: DataFrame) -> DataFrame:
    """day, peak_level_cm, category: a row for each day of each event; one that ends before it starts has none."""
    last = F.coalesce("end_date", "start_date")
    return events.where(last >= F.col("start_date")).select(F.explode(F.sequence("start_date", last)).alias("day"), "peak_level_cm", "category")


def daily_profiles(levels: DataFrame, rain: DataFrame, events: DataFrame, start: str, end: str, station: int = 1, upstream: int = 3, tz: str = BERLIN, dedupe: bool = False) -> DataFrame:
    """One row of five features per local day of a station, with the category of the flood on that day.

    Days in several floods come once for each (dedupe keeps the one with the highest peak). Intervals are
    spread over their days, so the range join is an equi-join; an event that ends before it starts has none.
    """
    level = absolute_rates(levels, start, end, [station, upstream], tz).select("day", "station_id", "level_cm", "rate_cm_h")
    wet = in_time(rain, start, end).select(local_day(F.col("measured_at"), tz).alias("day"), "rainfall_mm")
    # both gauges and the rain in one aggregate: a single shuffle by day, and no join of their days
    of = lambda s, c: F.when(F.col("station_id") == s, F.col(c))
    both = level.unionByName(wet, allowMissingColumns=True).groupBy("day").agg(
        F.max(of(station, "level_cm")).alias("max_level_cm"), F.avg(of(station, "level_cm")).alias("avg_level_cm"), F.max(of(station, "rate_cm_h")).alias("max_rate_cm_h"),
        F.max(of(upstream, "level_cm")).alias("up"), F.sum("rainfall_mm").alias("total_precip_mm"), F.max(of(station, "day")).isNotNull().alias("is_main"),
    )
    zero = F.lit(0.0)
    out = both.where("is_main").join(flood_days(events), "day", "left")
    if dedupe:
        out = out.groupBy("day", "max_level_cm", "avg_level_cm", "max_rate_cm_h", "total_precip_mm", "up").agg(F.max_by("category", "peak_level_cm").alias("category"))
    return out.select("day", "max_level_cm", "avg_level_cm", F.coalesce("max_rate_cm_h", zero).alias("max_rate_cm_h"), F.coalesce("total_precip_mm", zero).alias("total_precip_mm"), F.coalesce("up", zero).alias("upstream_max_cm"), F.col("category").alias("label"))


def labelled(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("label", parse_label(F.col("label")))


def profile_for_date(levels: DataFrame, rain: DataFrame, events: DataFrame, day: str, station: int = 1, upstream: int = 3, tz: str = BERLIN) -> DataFrame:
    """The profile of one day, without a label; its readings only, so the day's first has no rate."""
    end = f"{day} 00:00:00"
    after = date.fromisoformat(day) + timedelta(1)
    return daily_profiles(levels, rain, events, end, f"{after} 00:00:00", station, upstream, tz).withColumn("label", F.lit(None).cast("string")).orderBy("day").limit(1)


def required_profile(*args, **kwargs) -> DataFrame:
    """profile_for_date, or an error where the day has no readings."""
    out = profile_for_date(*args, **kwargs)
    if out.isEmpty():
        raise ValueError("no readings on that day")
    return out


def hourly(levels: DataFrame) -> DataFrame:
    return levels.groupBy("station_id", F.date_trunc("hour", "measured_at").cast("timestamp_ntz").alias("hour")).agg(F.avg("level_cm").alias("level_cm"))


def aligned(levels: DataFrame, upstream: int = 3, downstream: int = 1) -> DataFrame:
    """i, up, down: hours that both stations have, numbered 0, 1, ... in order."""
    pick = lambda s: F.max(F.when(F.col("station_id") == s, F.col("level_cm")))
    rows = hourly(levels.where(F.col("station_id").isin(upstream, downstream))).groupBy("hour").agg(pick(upstream).alias("up"), pick(downstream).alias("down")).dropna()
    return numbered(rows, ["hour"], "i", 0)


def hour_features(levels: DataFrame, rain: DataFrame, station: int = 1, upstream: int = 3) -> DataFrame:
    """Level, its change, upstream level and rain of the last 24 hours at each hour; joined on the time, so gaps drop out."""
    h = hourly(levels)
    main = h.where(F.col("station_id") == station).select("hour", "level_cm")
    before = main.select((F.col("hour") + F.expr("INTERVAL 1 HOURS")).alias("hour"), F.col("level_cm").alias("before"))
    up = h.where(F.col("station_id") == upstream).select("hour", F.col("level_cm").alias("upstream_cm"))
    wet = rain.groupBy(F.date_trunc("hour", "measured_at").cast("timestamp_ntz").alias("h")).agg(F.sum("rainfall_mm").alias("mm"))
    # each hour's rain counts for itself and the 23 hours after it
    day_rain = wet.select(F.explode(F.sequence(F.col("h"), F.col("h") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("hour"), "mm").groupBy("hour").agg(F.sum("mm").alias("precip_mm"))
    out = main.join(before, "hour").join(up, "hour").join(day_rain, "hour", "left")
    return out.select("hour", "level_cm", (F.col("level_cm") - F.col("before")).alias("rate_cm_h"), "upstream_cm", F.coalesce("precip_mm", F.lit(0.0)).alias("precip_mm"))


def regression_samples(levels: DataFrame, rain: DataFrame, station: int = 1, upstream: int = 3) -> DataFrame:
    """The features of hour t and the levels 6, 12 and 24 hours later."""
    main = hourly(levels).where(F.col("station_id") == station)
    out = hour_features(levels, rain, station, upstream)
    for hours in (6, 12, 24):
        out = out.join(main.select((F.col("hour") - F.expr(f"INTERVAL {hours} HOURS")).alias("hour"), F.col("level_cm").alias(f"target_{hours}h")), "hour")
    return out
