import pytest
from helpers import canonical, duck_rows

from riverflux.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    assert canonical(QUERIES[name](spark, sf).toPandas()) == canonical(duck_rows(SQL[name], sf))


@pytest.mark.parametrize("name", ["upsert_water_levels", "upsert_precipitation"])
def test_upserts_keep_all_readings_of_one_time(spark, tmp_path, name):
    """Several readings of one station and time, some of them alike, and readings where late ones will be."""
    times = [f"2024-{d}" for d in ("01-10 00:00:00", "01-29 00:00:00", "01-30 05:00:00", "03-10 16:00:00", "03-11 21:00:00")]
    rows = [(4 * k, t, kind, value) for t in times for k in range(2) for kind, value in (("view", 1.5), ("view", 1.5), ("view", 8.0), ("click", 8.0), ("view", None), ("click", float("inf")))]
    rows += [(4, None, "view", 3.0), (4, None, "view", 3.0), (5, times[1], None, 3.0)]
    spark.createDataFrame(rows, "user_id long, at string, event_type string, value double").selectExpr("user_id", "cast(at as timestamp_ntz) ts", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    assert canonical(QUERIES[name](spark, str(tmp_path)).toPandas()) == canonical(duck_rows(SQL[name], str(tmp_path)))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
