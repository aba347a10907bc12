"""Gauge pages (HTML) and rain archives (ZIP of semicolon text) as readings."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverflux.functions.risk import BERLIN, PRAGUE, utc_of_local

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TIME = "dd.MM.yyyy HH:mm"
# The cells that the gauge pages hold their readings in.
SAXONY_ROW = r'(?s)<td headers="z">.*?</span>(\d{2}\.\d{2}\.\d{4} \d{2}:\d{2})\s*</td>\s*<td headers="ws">(\d+)</td>'
CZECH_ROW = r"(?i)<td[^>]*>\s*(\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2})\s*</td>\s*<td[^>]*>\s*(\d+)\s*</td>"
CZECH_SPANS = r"""(?i)class=["']time["'][^>]*>\s*(\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2})[^<]*</span>[\s\S]{0,200}?class=["']value["'][^>]*>\s*(\d+)\s*</span>"""
# Names and marks of the rain product.
RAIN_ENTRY, MISSING_BELOW = "produkt_rr_stunde_", -998


def matches(html: Column, pattern: str, tz: str) -> Column:
    """array of (measured_at, level_cm) of the rows that parse; other rows are dropped."""
    times, values = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    rows = F.zip_with(times, values, lambda t, v: F.struct(utc_of_local(F.try_to_timestamp(t, F.lit(TIME)), tz).alias("measured_at"), v.try_cast("double").alias("level_cm")))
    return F.filter(rows, lambda r: r["measured_at"].isNotNull() & r["level_cm"].isNotNull())


def readings(pages: DataFrame, rows: Column, source: str) -> DataFrame:
    out = pages.select("station_id", F.explode(rows).alias("r"))
    return out.select("station_id", "r.measured_at", "r.level_cm", F.lit(source).alias("source"))


def parse_saxony(pages: DataFrame) -> DataFrame:
    """pages: station_id, html. Readings in UTC."""
    return readings(pages, matches(F.col("html"), SAXONY_ROW, BERLIN), "HWND")


def parse_czech(pages: DataFrame) -> DataFrame:
    """As parse_saxony; a page without a single good table row is read by its spans. In order of time."""
    table = matches(F.col("html"), CZECH_ROW, PRAGUE)
    rows = F.when(F.size(table) > 0, table).otherwise(matches(F.col("html"), CZECH_SPANS, PRAGUE))
    return readings(pages, F.array_sort(rows), "CHMI")


def parse_rain_lines(lines: DataFrame) -> DataFrame:
    """lines: station_id, line. Hourly rain; headers, short and malformed lines and missing values drop out."""
    f = F.transform(F.split("line", ";"), lambda x: F.trim(x))
    at = utc_of_local(F.try_to_timestamp(F.get(f, 1), F.lit("yyyyMMddHH")), BERLIN)
    out = lines.where(F.size(f) >= 4).select("station_id", at.alias("measured_at"), F.get(f, 3).try_cast("double").alias("rainfall_mm"))
    return out.where((F.col("rainfall_mm") >= MISSING_BELOW) & F.col("measured_at").isNotNull())


def unzip_rain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of each archive's last product entry, without its header."""
    for batch in batches:
        for station, content in zip(batch["station_id"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = [n for n in z.namelist() if n.startswith(RAIN_ENTRY)]
                text = z.read(names[-1]).decode("latin-1") if names else ""
            rows = text.splitlines()[1:]
            yield pd.DataFrame({"station_id": [station] * len(rows), "line": rows})


def parse_rain_archives(archives: DataFrame) -> DataFrame:
    """archives: station_id, content (as read by the binaryFile source)."""
    return parse_rain_lines(archives.mapInPandas(unzip_rain, "station_id int, line string"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """station_id, html of landed pages: files whose names begin with the station's number, each a page."""
    return spark.read.option("wholetext", True).text(path).select(F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).try_cast("int").alias("station_id"), F.col("value").alias("html"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """station_id, content of landed rain archives, named as archive_name() says."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "stundenwerte_RR_*_akt.zip").load(path)
    return files.select(F.regexp_extract("path", r"stundenwerte_RR_(\d{5})_akt\.zip$", 1).try_cast("int").alias("station_id"), "content")


def archive_name(station: Column) -> Column:
    return F.format_string("stundenwerte_RR_%05d_akt.zip", station)


def find_station(listing: DataFrame, name: str) -> DataFrame:
    """station_id of the first archive in a directory listing (column html) whose line names the station; -1 if none."""
    lines = listing.select(F.explode(F.split("html", "\n")).alias("line")).where(F.lower("line").contains(name.lower()))
    return lines.select(F.regexp_extract("line", r"stundenwerte_RR_(\d{5})_akt\.zip", 1).try_cast("int").alias("station_id")).agg(F.coalesce(F.min("station_id"), F.lit(-1)).alias("station_id"))
