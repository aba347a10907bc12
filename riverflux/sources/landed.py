"""Landed gauge pages and rain archives as a Spark data source, read at once or as a stream.

    spark.dataSource.register(LandedFiles)
    spark.read.format("gauge_files").option("path", folder).option("kind", "archives").option("station", "1684").load()

Each file is a row (pages: text is the page) or several (archives: a line of the product each). A file that can't be read is a
row with an error and no text, so one broken file doesn't end a job.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "station_id int, path string, text string, error string"
#: How the names of files begin with, or hold, the station's number; which files are of the kind.
KINDS = {"pages": re.compile(r"^(\d+).*\.html?$"), "archives": re.compile(r"^stundenwerte_RR_(\d{5})_akt\.zip$")}
# Fixed value: how the name of the rain product in an archive begins.
RAIN_ENTRY = "produkt_rr_stunde_"
#: Bytes of files in a partition, and files of a stream's batch.
PARTITION_BYTES = 32 << 20


@dataclass(frozen=True)
class Landed:
    station: int
    path: str
    size: int
    changed: int  # nanoseconds


@dataclass
class Files(InputPartition):
    files: list[Landed]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, kind: str, station: int | None) -> list[Landed]:
    """The files of the kind in a folder, in the order in which they were last changed. Names only are read, on the driver."""
    store, folder = opened(path)
    found = []
    for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        m = KINDS[kind].match(f.base_name) if f.is_file else None
        if m and station in (None, int(m[1])):
            found.append(Landed(int(m[1]), f.path, f.size or 0, f.mtime_ns or 0))
    return sorted(found, key=lambda f: (f.changed, f.path))


def dealt(files: list[Landed]) -> list[Files]:
    """Partitions of one station's files each, PARTITION_BYTES of them or one file."""
    out: list[Files] = []
    for f in sorted(files, key=lambda f: (f.station, f.path)):
        if out and out[-1].files[0].station == f.station and sum(x.size for x in out[-1].files) + f.size <= PARTITION_BYTES:
            out[-1].files.append(f)
        else:
            out.append(Files([f]))
    return out


def rows_of(files: list[Landed], path: str, kind: str) -> Iterator[tuple]:
    store, _ = opened(path)
    for f in files:
        try:
            with store.open_input_stream(f.path) as stream:
                content = stream.read()
            texts = [content.decode("utf-8", "replace")] if kind == "pages" else lines_of(content)
        except (OSError, zipfile.BadZipFile, EOFError, ValueError, NotImplementedError) as e:
            yield (f.station, f.path, None, f"{type(e).__name__}: {e}"[:500])
            continue
        for text in texts:
            yield (f.station, f.path, text, None)


def lines_of(archive: bytes) -> list[str]:
    """The lines of an archive's last product entry, without its header."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        names = [n for n in z.namelist() if n.startswith(RAIN_ENTRY)]
        return z.read(names[-1]).decode("latin-1").splitlines()[1:] if names else []


class LandedFiles(DataSource):
    """Options: path (a folder), kind (pages or archives; pages by default), station (a number; all by default)."""

    @classmethod
    def name(cls) -> str:
        return "gauge_files"

    def schema(self) -> str:
        return SCHEMA

    def asked(self) -> tuple[str, str, int | None]:
        kind, path, station = self.options.get("kind", "pages"), self.options.get("path"), self.options.get("station")
        if kind not in KINDS or not path:
            raise ValueError("gauge_files needs a path and a kind, which is one of " + ", ".join(KINDS))
        return path, kind, None if station is None else int(station)

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(*self.asked())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(*self.asked())


class BatchReader(DataSourceReader):
    def __init__(self, path: str, kind: str, station: int | None):
        self.path, self.kind, self.station = path, kind, station

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path, self.kind, self.station)) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(partition.files, self.path, self.kind)


class StreamReader(DataSourceStreamReader):
    """An offset is the change time and path of the last file read; a file that is landed again comes again. Files have to
    be put in place whole (moved, not written there)."""

    def __init__(self, path: str, kind: str, station: int | None):
        self.path, self.kind, self.station = path, kind, station

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.path, self.kind, self.station)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = ((o["changed"], o["path"]) for o in (start, end))
        return dealt([f for f in listed(self.path, self.kind, self.station) if after < (f.changed, f.path) <= upto])

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(partition.files, self.path, self.kind)

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are done."""


def read_landed(spark: SparkSession, path: str, kind: str = "pages", station: int | None = None, stream: bool = False) -> DataFrame:
    spark.dataSource.register(LandedFiles)
    reader = (spark.readStream if stream else spark.read).format("gauge_files").option("path", path).option("kind", kind)
    return (reader if station is None else reader.option("station", str(station))).load()


def as_pages(landed: DataFrame) -> DataFrame:
    """station_id, html for the page parsers."""
    return landed.where(F.col("error").isNull()).select("station_id", F.col("text").alias("html"))


def as_rain_lines(landed: DataFrame) -> DataFrame:
    """station_id, line for the parser of rain lines."""
    return landed.where(F.col("error").isNull()).select("station_id", F.col("text").alias("line"))


def failures(landed: DataFrame) -> DataFrame:
    return landed.where(F.col("error").isNotNull()).select("station_id", "path", "error")
