import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from riverflux.operators import storage
from riverflux.operators.intervals import interval_join
from riverflux.sources import gauge_pages as P
from riverflux.sources import landed

CELL = "<tr><td>{} 06:00</td><td>{}</td></tr>"


def archive(path, lines):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("produkt_rr_stunde_1.txt", "HEAD\n" + "\n".join(lines))


def test_landed_files_are_read_by_station_and_broken_ones_reported(spark, tmp_path):
    for station, day in ((3, "15.04.2025"), (3, "16.04.2025"), (4, "15.04.2025")):
        (tmp_path / f"{station}_{day}.html").write_text(CELL.format(day, 140 + station))
    (tmp_path / "notes.txt").write_text("no page")
    pages = landed.read_landed(spark, str(tmp_path))
    assert sorted((r.station_id, r.level_cm) for r in P.parse_czech(landed.as_pages(pages)).collect()) == [(3, 143.0), (3, 143.0), (4, 144.0)]
    assert pages.rdd.getNumPartitions() == 2  # a partition for each station
    one = landed.read_landed(spark, f"file://{tmp_path}", station=4)
    assert [r.level_cm for r in P.parse_czech(landed.as_pages(one)).collect()] == [144.0]

    archive(tmp_path / "stundenwerte_RR_01684_akt.zip", ["1684;2025040100;10;0.5;0;0;eor"])
    (tmp_path / "stundenwerte_RR_00007_akt.zip").write_bytes(b"not an archive")
    rain = landed.read_landed(spark, str(tmp_path), "archives")
    assert [(r.station_id, r.rainfall_mm) for r in P.parse_rain_lines(landed.as_rain_lines(rain)).collect()] == [(1684, 0.5)]
    assert [(r.station_id, r.error.split(":")[0]) for r in landed.failures(rain).collect()] == [(7, "BadZipFile")]
    assert landed.read_landed(spark, str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(Exception, match="gauge_files needs"):
        landed.read_landed(spark, str(tmp_path), "letters").count()


def test_landed_files_come_as_a_stream_once_each(spark, tmp_path):
    folder, target, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    folder.mkdir()
    for run in range(3):  # each run goes on where the last one ended
        for day in (1, 2):
            (folder / f"3_{run}{day}.html").write_text(CELL.format(f"{10 + run * 2 + day}.04.2025", 100 + run))
        rows = P.parse_czech(landed.as_pages(landed.read_landed(spark, str(folder), stream=True)))
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(target).count() == 2 * (run + 1)


def test_interval_join_matches_a_loop(spark):
    rng = random.Random(4)
    at = lambda: f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00"
    points = [(i, rng.randint(0, 1), at()) for i in range(400)] + [(900, 0, None), (901, 1, "1999-01-01 00:00:00")]
    spans = [(j, rng.randint(0, 1), *sorted([at(), at()])) for j in range(30)] + [(50, 0, points[0][2], points[0][2]), (51, 1, "2020-01-02 00:00:00", "2020-01-01 00:00:00"), (52, 1, None, at()), (53, 0, "1900-01-01 00:00:00", "2100-01-01 00:00:00")]
    p = spark.createDataFrame(points, "i int, k int, t string").withColumn("at", F.col("t").cast("timestamp_ntz")).drop("t")
    v = spark.createDataFrame(spans, "j int, k int, s string, e string").selectExpr("j", "k", "cast(s as timestamp_ntz) s", "cast(e as timestamp_ntz) e")
    got = {(r.i, r.j) for r in interval_join(p, v, "at", "s", "e", ("k",)).collect()}
    want = {(i, j) for i, k, t in points for j, m, s, e in spans if k == m and None not in (t, s, e) and s <= t <= e}
    assert got == want and interval_join(p, v, "at", "s", "e", ("k",)).count() == len(want)
    assert interval_join(p, v.limit(0), "at", "s", "e", ("k",)).count() == 0


def test_long_intervals_have_few_buckets(spark):
    from riverflux.operators import intervals

    rows = []
    keep = intervals.written
    intervals.written = lambda df: rows.append(df.groupBy("j").count().agg(F.max("count")).first()[0]) or keep(df)
    try:
        v = spark.createDataFrame([(n, "1900-01-01 00:00:00", n) for n in (1, 60, 3600, 86400, 10**7, 10**9, 4 * 10**9)], "j long, s string, n long").selectExpr("j", "cast(s as timestamp_ntz) s", "cast(s as timestamp_ntz) + make_dt_interval(0, 0, 0, n) e")
        interval_join(spark.range(1).selectExpr("timestamp_ntz'2000-01-01 00:00:00' at"), v, "at", "s", "e")
    finally:
        intervals.written = keep
    assert rows[0] <= intervals.TIMES + 2


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(1, 4), f"2024-01-{rng.randint(1, 28):02d}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "station_id int, day string, v double")
    names = [f"bucketed_{os.getpid()}_{n}" for n in "ab"]
    a = storage.write_bucketed(df, names[0], ["station_id", "day"], 4)
    b = storage.write_bucketed(df.groupBy("station_id", "day").agg(F.max("v").alias("top")), names[1], ["station_id", "day"], 4)
    try:
        joined = a.join(b.hint("merge"), ["station_id", "day"]).groupBy("station_id", "day").agg(F.max("top").alias("top"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == len({r[:2] for r in rows})
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_screened_rows_are_apart_and_counted(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0), (2, None), (None, 900.0), (3, 950.0)], "station_id int, level_cm double")
    counts = storage.screen(df, {"no_station": F.col("station_id").isNull(), "no_level": F.col("level_cm").isNull(), "high": F.col("level_cm") > 800}, str(tmp_path / "s"))
    assert counts == {"accepted": 1, "rows": 4, "no_station": 1, "no_level": 1, "high": 2}
    apart = spark.read.parquet(str(tmp_path / "s")).where("not accepted")
    assert sorted(r.violated for r in apart.collect()) == [["high"], ["no_level"], ["no_station", "high"]]


def test_landed_files_are_taken_in_by_source(spark, tmp_path):
    from riverflux.sources import ingest

    land, tables, state = tmp_path / "in", str(tmp_path / "tables"), str(tmp_path / "state")
    for source in ingest.SOURCES:
        (land / source).mkdir(parents=True)
    saxony = '<td headers="z"><span>x</span>{}</td> <td headers="ws">{}</td>'
    (land / "saxony" / "1_a.html").write_text(saxony.format("12.01.2026 09:30", 141))
    (land / "czech" / "3_a.html").write_text(CELL.format("12.01.2026", 90))
    archive(land / "rain" / "stundenwerte_RR_01684_akt.zip", ["1684;2026011209;10;0.5;0;0;eor"])
    (land / "rain" / "stundenwerte_RR_00002_akt.zip").write_bytes(b"x")
    first = ingest.take_in(spark, str(land), tables, state)
    assert [(n, e) for n, _, e in first] == [("saxony", None), ("czech", None), ("rain", None)]
    levels = lambda: sorted((r.station_id, str(r.measured_at), r.level_cm, r.source) for r in ingest.readings_of(spark, tables, "water_levels").collect())
    assert levels() == [(1, "2026-01-12 08:30:00", 141.0, "HWND"), (3, "2026-01-12 05:00:00", 90.0, "CHMI")]
    assert [(r.station_id, r.rainfall_mm) for r in ingest.readings_of(spark, tables, "precipitation").collect()] == [(1684, 0.5)]
    (land / "saxony" / "1_b.html").write_text(saxony.format("12.01.2026 09:30", 150) + saxony.format("13.01.2026 09:30", 151))  # a correction and a new reading
    again = ingest.take_in(spark, str(land), tables, state)
    assert [e for _, _, e in again] == [None] * 3
    assert levels() == [(1, "2026-01-12 08:30:00", 150.0, "HWND"), (1, "2026-01-13 08:30:00", 151.0, "HWND"), (3, "2026-01-12 05:00:00", 90.0, "CHMI")]
