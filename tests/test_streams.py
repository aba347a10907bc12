import random

import pytest
from pyspark.sql import functions as F

from riverflux.operators import readings
from riverflux.schemas import flood_events
from riverflux.streaming import levels as L
from riverflux.streaming import profiles, rates

LEVELS = "station_id int, measured_at timestamp_ntz, level_cm double, source string"


def table(spark, rows):
    return spark.createDataFrame(rows, "station_id int, t string, level_cm double, source string").select("station_id", F.col("t").cast("timestamp_ntz").alias("measured_at"), "level_cm", "source")


def land(spark, rows, folder):
    table(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def history(rng, days=6):
    """Readings of two stations, a few of them on the hour, with gaps of up to a day."""
    return [(s, f"2024-03-{d:02d} {h:02d}:{m:02d}:00", float(rng.randint(50, 300)), "a") for s in (1, 3) for d in range(1, days + 1) if (s, d) != (3, 3) for h in sorted(rng.sample(range(24), 7)) for m in (0, 20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_late_and_repeated_readings_give_the_rates_of_the_table(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = history(rng)
    late = sorted(rows, key=lambda r: (r[1][8:10], rng.random()))  # shuffled within days, which a delay of two days covers
    batches = [late[i : i + 17] for i in range(0, len(late), 17)]
    for i, b in enumerate(batches[1:], 1):
        b += rng.sample(batches[i - 1], 4)  # some come again
    folder, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    for i, b in enumerate(batches):
        land(spark, b, folder)
        if i in (2, len(batches) - 1):  # several batches in a run, and a restart
            rates.rates_table(L.read_levels(spark, folder, LEVELS, 1), target, checkpoint, "2 days").awaitTermination()
    got = {(r.station_id, str(r.measured_at)): (r.level_cm, r.rate_cm_h) for r in spark.read.parquet(target).collect()}
    want = {(r.station_id, str(r.measured_at)): (r.level_cm, r.rate_cm_h) for r in readings.level_analysis(table(spark, rows)).collect()}
    assert got == want


def test_the_state_of_rates_is_as_long_as_the_delay(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    for d in range(1, 13):
        land(spark, [(1, f"2024-03-{d:02d} {h:02d}:00:00", float(d * h), "a") for h in range(24)], folder)
    q = rates.rates(L.read_levels(spark, folder, LEVELS, 1), "1 day").writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = spark.read.format("statestore").option("stateVarName", "levels").load(checkpoint)
    assert 20 < kept.count() < 24 * 4


def test_profiles_kept_by_streams_equal_those_of_all_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = history(rng, 9)
    rain = [(2, t, float(rng.randint(0, 9)), "a") for _, t, _, _ in rng.sample(rows, 60)]
    rain = [(s, t, v, x) for (s, t), (v, x) in {(s, t): (v, x) for s, t, v, x in rain}.items()]
    wrong = [(s, t, v + 500, x) for s, t, v, x in rng.sample(rows, 12)]  # corrected by a later batch
    order = rows[:]
    rng.shuffle(order)
    batches = [wrong] + [order[i : i + 40] for i in range(0, len(order), 40)]
    at = {n: [str(tmp_path / f"{n}-{x}") for x in ("in", "t", "c")] for n in ("levels", "rain")}
    wet = lambda f: L.read_levels(spark, f, "station_id int, measured_at timestamp_ntz, rainfall_mm double", 1)
    for i, b in enumerate(batches):
        land(spark, b, at["levels"][0])
        table(spark, rain[i::len(batches)]).withColumnRenamed("level_cm", "rainfall_mm").drop("source").coalesce(1).write.mode("append").parquet(at["rain"][0])
        if i in (0, 3, len(batches) - 1):
            profiles.keep_levels(L.read_levels(spark, at["levels"][0], LEVELS, 1), *at["levels"][1:]).awaitTermination()
            profiles.keep_rain(wet(at["rain"][0]), *at["rain"][1:]).awaitTermination()
    events = flood_events(spark, [("2024-03-02", "2024-03-04", 300.0, "kritisch"), ("2024-03-04", None, 200.0, "erhoht")])
    days = [spark.read.parquet(f"{at[n][1]}-days") for n in ("levels", "rain")]
    got = profiles.profiles_of_days(*days, events)
    wet_rows = table(spark, rain).withColumnRenamed("level_cm", "rainfall_mm")
    want = readings.daily_profiles(table(spark, rows), wet_rows, events, "2024-01-01 00:00:00", "2025-01-01 00:00:00")
    text = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert text(got) == text(want) and got.count() == 10
