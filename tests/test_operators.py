import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riverflux.functions import risk as R
from riverflux.operators import bayes, clusters, readings, series, storage
from riverflux.sources import gauge_pages as P

LEVELS = "station_id int, measured_at timestamp_ntz, level_cm double, source string"


def levels(spark, rows):
    return spark.createDataFrame(rows, "station_id int, t string, level_cm double, source string").select("station_id", F.col("t").cast("timestamp_ntz").alias("measured_at"), "level_cm", "source")


def profile_rows(spark, rows):
    return spark.createDataFrame(rows, "d string, max_level_cm double, avg_level_cm double, max_rate_cm_h double, total_precip_mm double, upstream_max_cm double, label string").withColumn("day", F.to_date("d")).drop("d")


def test_moving_average_is_over_rows_and_crosses_days(spark):
    rows = [(1, f"2024-01-0{1 + i // 3} {i % 3 * 8:02d}:00:00", float(i + 1), "a") for i in range(8)]
    out = readings.level_analysis(levels(spark, rows)).orderBy("measured_at").collect()
    assert [r.avg_7h for r in out] == [1, 1.5, 2, 2.5, 3, 3.5, 4, 5]
    assert [r.rate_cm_h for r in out] == [None] + [1.0] * 7


def test_context_spans_reach_over_sparse_days(spark):
    rng = random.Random(1)
    rows = [(s, f"2024-01-{d:02d} {h:02d}:00:00", float(rng.randint(0, 99)), "a") for s in (1, 2) for d in range(1, 25) for h in sorted(rng.sample(range(24), rng.choice([1, 1, 2, 9])))]
    out = readings.level_analysis(levels(spark, rows)).toPandas().sort_values(["station_id", "measured_at"])
    want = out.groupby("station_id")["level_cm"].transform(lambda x: x.rolling(7, min_periods=1).mean())
    assert np.allclose(out["avg_7h"], want)
    assert len(out) == len(rows)


def test_rate_follows_the_filter(spark):
    rows = [(1, "2024-01-01 22:00:00", 10.0, "a"), (1, "2024-01-02 01:00:00", 30.0, "a"), (1, "2024-01-02 02:00:00", 25.0, "a")]
    out = readings.absolute_rates(levels(spark, rows), "2024-01-02 00:00:00", "2024-01-03 00:00:00").orderBy("measured_at").collect()
    assert [r.rate_cm_h for r in out] == [None, 5.0]


def test_upsert_keeps_first_source_and_last_level(spark):
    old = levels(spark, [(1, "2024-01-01 10:00:00", 100.0, "A")])
    new = levels(spark, [(1, "2024-01-01 10:00:00", 110.0, "B"), (1, "2024-01-01 10:00:00", 120.0, "C"), (2, "2024-01-01 10:00:00", 7.0, "D"), (2, "2024-01-01 10:00:00", 8.0, "E")]).coalesce(1)
    out = {r.station_id: (r.level_cm, r.source) for r in storage.upsert(old, new, ["station_id", "measured_at"], ["level_cm"], "source").collect()}
    assert out == {1: (120.0, "A"), 2: (8.0, "D")}


def test_partitioned_table_prunes(spark, tmp_path):
    rows = levels(spark, [(1, "1999-01-01 00:00:00", 1.0, "a"), (1, "2010-01-01 00:00:00", 2.0, "a"), (1, "2025-01-01 00:00:00", 3.0, "a"), (1, "2031-01-01 00:00:00", 4.0, "a")])
    storage.write_partitioned(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {(r.part, r.n) for r in back.groupBy("part").agg(F.count("*").alias("n")).collect()} == {("default", 2), ("hist", 1), ("2025", 1)}
    assert "PartitionFilters: [isnotnull(part" in back.where("part = 'hist'")._jdf.queryExecution().toString()


def test_vote_ties_and_anomalies(spark):
    rows = spark.createDataFrame([("NORMAL", "GEFAHR", "GEFAHR", False), ("NORMAL", "GEFAHR", "GEFAHR", True), ("GEFAHR", "GEFAHR", "GEFAHR", False)], "b string, n string, k string, a boolean")
    risk, sure = series.ensemble(F.col("b"), F.col("n"), F.col("k"), F.col("a"))
    assert [tuple(r) for r in rows.select(risk, sure).collect()] == [("NORMAL", False), ("ERHOHT", False), ("GEFAHR", True)]


def test_naive_bayes_of_rare_and_missing_risks(spark):
    rows = [("2024-01-01", 1.0, 1.0, 1.0, 1.0, 1.0, "NORMAL"), ("2024-01-02", 3.0, 2.0, 1.0, 1.0, 1.0, "NORMAL"), ("2024-01-03", 9.0, 2.0, 1.0, 1.0, 1.0, "ERHOHT")]
    p = {r.label: r for r in bayes.nb_fit(profile_rows(spark, rows)).collect()}
    assert p["NORMAL"].var_max_level_cm == 2.0 and p["ERHOHT"].var_max_level_cm == 1.0
    assert (p["GEFAHR"].mean_max_level_cm, p["GEFAHR"].var_max_level_cm) == (0.0, 1.0) and p["GEFAHR"].prior == pytest.approx(1 / 6)


def test_fold_sizes(spark):
    rows = profile_rows(spark, [(f"2024-01-{i + 1:02d}", 1.0, 1.0, 1.0, 1.0, 1.0, "NORMAL") for i in range(23)])
    assert sorted(r["count"] for r in bayes.folds(rows).groupBy("fold").count().collect()) == [4, 4, 5, 5, 5]


def test_precision_of_a_risk_that_is_never_predicted(spark):
    c = spark.createDataFrame([("NORMAL", "NORMAL", 3), ("ERHOHT", "NORMAL", 1), ("NORMAL", "ERHOHT", 0), ("ERHOHT", "ERHOHT", 0)], "actual string, predicted string, n long")
    out = {r.label: (r.precision, r.recall) for r in bayes.precision_recall(c).collect()}
    assert out == {"NORMAL": (0.75, 1.0), "ERHOHT": (0.0, 0.0)}


def brute_dbscan(z, eps, least):
    near = [[j for j in range(len(z)) if np.linalg.norm(z[i] - z[j]) <= eps] for i in range(len(z))]
    label, c = [None] * len(z), 0
    for i in range(len(z)):
        if label[i] is not None or len(near[i]) < least:
            continue
        label[i], todo = c, list(near[i])
        while todo:
            j = todo.pop(0)
            if label[j] is None:
                label[j] = c
                if len(near[j]) >= least:
                    todo += near[j]
        c += 1
    return [-1 if x is None else x for x in label]


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(m, 0.6, (40, 5)) for m in (0, 3, 6)] + [rng.uniform(-4, 10, (20, 5))])[rng.permutation(140)]
    rows = [(f"{2000 + i // 12}-{i % 12 + 1:02d}-01", *map(float, p), "NORMAL") for i, p in enumerate(points)]
    out = [r.cluster for r in clusters.dbscan(profile_rows(spark, rows), ["day"], 0.5, 6).orderBy("day").collect()]
    z = (points - points.mean(0)) / points.std(0)
    assert out == brute_dbscan(z, 0.5, 6) and max(out) >= 1


@pytest.mark.parametrize("leaf", [1, 8, 1 << 14])
def test_dbscan_counts_whatever_is_cut(spark, monkeypatch, leaf):
    """Small leaves cut boxes down to single points; repeated rows weigh what they are."""
    from riverflux.operators import spatial

    monkeypatch.setattr(spatial, "LEAF", leaf)
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(m, 0.4, (25, 5)) for m in (0, 3)] + [rng.uniform(-2, 5, (15, 5))])
    points = np.concatenate([points, points[:20], np.repeat(points[3:4], 30, 0)])[rng.permutation(115)]
    rows = [(f"{1990 + i // 12}-{i % 12 + 1:02d}-01", *map(float, p), "NORMAL") for i, p in enumerate(points)]
    out = clusters.dbscan(profile_rows(spark, rows), ["day"], 0.6, 5).orderBy("day").collect()
    z = (points - points.mean(0)) / points.std(0)
    near = [(np.linalg.norm(z - p, axis=1) <= 0.6).sum() for p in z]
    assert [r.n_near for r in out] == near and [r.cluster for r in out] == brute_dbscan(z, 0.6, 5)


def test_dense_days_are_counted_and_not_compared(spark, monkeypatch):
    """100 000 equal days are one point, and as many that differ a little are boxes within the radius."""
    from riverflux.operators import spatial

    seen = []
    whole = spatial.compared
    monkeypatch.setattr(spatial, "compared", lambda *a: seen.append(a[2].leaf.count()) or whole(*a))
    same = spark.range(100_000).select(F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") % 40_000).cast("int")).alias("day"), *[F.lit(float(k)).alias(c) for k, c in enumerate(R.FEATURES)])
    close = spark.range(100_000).select(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 40_000).cast("int")).alias("day"), *[(100.0 + k + (F.xxhash64("id", F.lit(k)) % 1000) * 1e-6).alias(c) for k, c in enumerate(R.FEATURES)])
    out = clusters.dbscan(same.unionByName(close), ["day"], 1.0, 10).groupBy("cluster", "n_near").count().collect()
    assert sorted(map(tuple, out)) == [(0, 100_000, 100_000), (1, 100_000, 100_000)]
    assert seen and sum(seen) == 0


def test_dbscan_without_clusters_and_with_gaps(spark):
    rows = profile_rows(spark, [("2024-01-01", 1.0, 1.0, 1.0, 1.0, 1.0, "NORMAL"), ("2024-01-02", None, 2.0, 1.0, 1.0, 1.0, "NORMAL")])
    assert [(r.cluster, r.n_near) for r in clusters.dbscan(rows, ["day"]).orderBy("day").collect()] == [(-1, 1), (-1, 0)]
    assert clusters.dbscan(rows.limit(0), ["day"]).count() == 0


def test_new_rows_get_the_commonest_cluster_near_them(spark):
    fitted = profile_rows(spark, [(f"2024-01-{i + 1:02d}", float(i // 5 * 9), 0.0, 0.0, 0.0, 0.0, "NORMAL") for i in range(10)])
    params = {c: (0.0, 1.0) for c in R.FEATURES}
    labelled = fitted.withColumn("cluster", F.when(F.col("max_level_cm") > 0, 1).otherwise(0))
    new = profile_rows(spark, [("2024-02-01", 0.5, 0.0, 0.0, 0.0, 0.0, None), ("2024-02-02", 8.5, 0.0, 0.0, 0.0, 0.0, None), ("2024-02-03", 4.0, 0.0, 0.0, 0.0, 0.0, None)])
    out = {str(r.day)[-2:]: r.dbscan_cluster for r in clusters.dbscan_predict(new, labelled, params, "day").collect()}
    assert out == {"01": 0, "02": 1, "03": -1}


def test_kmeans_reaches_a_fixed_point(spark):
    rng = np.random.default_rng(5)
    rows = [(f"{1900 + i}-01-01", *map(float, rng.normal(m, 1, 5)), "NORMAL") for i, m in enumerate([0] * 20 + [50] * 20 + [100] * 20)]
    df = profile_rows(spark, rows)
    model = clusters.kmeans_fit(df, ["day"])
    out = clusters.kmeans_predict(df, model).orderBy("day").collect()
    assert [r.km_risk for r in out] == ["NORMAL"] * 20 + ["ERHOHT"] * 20 + ["GEFAHR"] * 20


def test_travel_time_of_a_delayed_wave(spark):
    up = [100 + (300 if i in (10, 33, 81, 119, 160) else 0) + i % 3 for i in range(200)]  # no second lag fits
    down = [up[i - 6] if i >= 6 else 100 for i in range(200)]
    rows = spark.createDataFrame([(i, float(u), float(d)) for i, (u, d) in enumerate(zip(up, down))], "i long, up double, down double")
    fit = series.travel_fit(rows).first()
    assert fit.lag == 6 and fit.n_pairs >= 2 and fit.slope * 400 + fit.intercept == pytest.approx(6)
    with pytest.raises(ValueError):
        series.travel_fit(rows.limit(20))


def test_regression_survives_a_singular_matrix(spark):
    rows = spark.createDataFrame([(f"2024-01-01 {h:02d}:00:00", float(h), 1.0, float(h), 0.0, 2.0 * h, 2.0 * h, -5.0) for h in range(20)], "t string, level_cm double, rate_cm_h double, upstream_cm double, precip_mm double, target_6h double, target_12h double, target_24h double")
    rows = rows.withColumn("hour", F.col("t").cast("timestamp_ntz"))
    out = series.regression_predict(rows, series.regression_fit(rows)).orderBy("hour").collect()
    assert out[10].level_6h_cm == pytest.approx(20, abs=1e-6) and out[10].level_24h_cm == 0.0


def test_labels_and_clock_changes(spark):
    rows = spark.createDataFrame([(" Erhöht ",), ("KRITISCH",), (None,), ("x",)], "c string")
    assert [r[0] for r in rows.select(R.parse_label(F.col("c"))).collect()] == ["ERHOHT", "GEFAHR", "NORMAL", "NORMAL"]
    t = spark.createDataFrame([("2025-03-30 02:30:00",), ("2025-10-26 02:30:00",)], "t string").select(R.utc_of_local(F.col("t").cast("timestamp_ntz"), R.BERLIN).cast("string"))
    assert [r[0] for r in t.collect()] == ["2025-03-30 01:30:00", "2025-10-26 00:30:00"]


def test_rain_archive(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("produkt_rr_stunde_1.txt", "HEAD\n1;2025040100;1;9.9;eor\n")
        z.writestr("produkt_rr_stunde_2.txt", "HEAD\n1684;2025040100;10;0.1;eor\n1684;2025040101;10;-999;eor\n")
    df = spark.createDataFrame([(4, bytearray(buffer.getvalue()))], "station_id int, content binary")
    assert [(r.station_id, r.rainfall_mm) for r in P.parse_rain_archives(df).collect()] == [(4, 0.1)]


def test_window_inside_an_aggregate_is_an_error(spark):
    with pytest.raises(AnalysisException):
        spark.sql("SELECT max(abs(v - lag(v) OVER (ORDER BY t))) FROM VALUES (1, 100), (2, 110) AS x(t, v)").collect()
    assert spark.sql("SELECT max(r) AS m FROM (SELECT abs(v - lag(v) OVER (ORDER BY t)) AS r FROM VALUES (1, 100), (2, 110) AS x(t, v))").first().m == 10


def test_script_goes_on_after_an_error(spark):
    done = storage.run_script(spark, "-- a comment; with a semicolon\nSELECT 'a;b';\nSELECT nope FROM nowhere;\nSELECT 1;")
    assert [e is None for _, e in done] == [True, False, True]


def test_parameters_of_a_script_are_bound(spark):
    spark.range(5).createOrReplaceTempView("five")
    done = storage.run_script(spark, "SELECT id FROM five WHERE id = :id; SELECT id FROM five WHERE cast(id AS string) = :what; SELECT :nothing", {"id": 3, "what": "1'; DROP VIEW five; --"})
    assert [e is None for _, e in done] == [True, True, False] and spark.table("five").count() == 5


def test_streams(spark, tmp_path):
    from riverflux.streaming import levels as L

    folder, target = str(tmp_path / "in"), str(tmp_path / "t")
    for i, rows in enumerate([[(1, "2024-01-01 10:00:00", 100.0, "A"), (1, "2024-01-05 10:00:00", 7.0, "A")], [(1, "2024-01-01 10:00:00", 110.0, "B"), (1, "2024-01-01 11:00:00", 130.0, "B")]]):
        levels(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        L.upsert_stream(L.read_levels(spark, folder, LEVELS), target, str(tmp_path / "c")).awaitTermination()
    out = spark.read.parquet(target).orderBy("measured_at").collect()
    assert [(r.level_cm, r.source) for r in out] == [(110.0, "A"), (130.0, "B"), (7.0, "A")]
    q = L.hourly_means(L.read_levels(spark, folder, LEVELS)).writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("means").collect()) == [1, 1, 2]


def test_large_tables_are_ordered_in_months_with_context(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(s, f"2023-{m:02d}-{d:02d} {h:02d}:00:00", float(rng.randint(0, 99)), "a") for s in (1, 2) for m in (1, 2, 5, 12) for d, h in {(rng.randint(1, 28), rng.randint(0, 23)) for _ in range(rng.choice([2, 9]))}]
    df = levels(spark, rows)
    one = [readings.level_analysis(df), readings.absolute_rates(df, "2023-01-03 00:00:00", "2024-01-01 00:00:00")]
    whole = [sorted(map(tuple, x.collect()), key=str) for x in one]
    monkeypatch.setattr(readings, "WHOLE", 0)
    cut = [readings.level_analysis(df), readings.absolute_rates(df, "2023-01-03 00:00:00", "2024-01-01 00:00:00")]
    assert [sorted(map(tuple, x.collect()), key=str) for x in cut] == whole


def test_landed_pages_and_archives_are_read(spark, tmp_path):
    page = '<tr><TD class="a">15.04.2025 07:00</TD><td>145</td></tr><tr><td>15.04.2025 06:00</td><td> 143 </td></tr><tr><td>15.04.2025  05:00</td><td>140</td></tr>'
    (tmp_path / "3_now.html").write_text(page)
    assert [(r.station_id, r.level_cm) for r in P.parse_czech(P.read_pages(spark, str(tmp_path))).collect()] == [(3, 143.0), (3, 145.0)]
    with zipfile.ZipFile(tmp_path / "stundenwerte_RR_01684_akt.zip", "w") as z:
        z.writestr("produkt_rr_stunde_x.txt", "STATIONS_ID;MESS_DATUM;QN;RR\n1684;2025040100;10;0.5;0;0;eor\n")
    assert [(r.station_id, r.rainfall_mm) for r in P.parse_rain_archives(P.read_archives(spark, str(tmp_path))).collect()] == [(1684, 0.5)]


def test_a_failing_source_leaves_the_others(spark):
    report = storage.run_sources({"bad": lambda: spark.read.parquet("/nowhere/at/all").count(), "good": lambda: spark.range(3).count()})
    assert [(n, k, e is None) for n, k, e in report] == [("bad", 0, False), ("good", 3, True)]
    assert "Range" in storage.plan_text(spark.range(3))


def test_episodes_cross_months_and_match_sessions(spark, tmp_path):
    from riverflux.operators import episodes as E
    from riverflux.streaming import levels as L

    rng = random.Random(6)
    start, rows = np.datetime64("2024-01-31T22:30:00"), []
    for s in (1, 2):
        at = start
        for k in range(300):
            at = at + np.timedelta64(20 if k < 9 else rng.choice([10, 20, 60, 61, 200]), "m")
            rows.append((s, str(at).replace("T", " "), float(rng.choice([100, 250, 360, 360.5][k < 9 :])), "a"))
    df = levels(spark, rows)
    got = {(r.station_id, str(r.start_at)): (str(r.end_at), r.peak_level_cm, str(r.peak_at), r.n_readings) for r in E.episodes(df, 200.0, 60).collect()}
    want, last = {}, {}
    for s, t, v, _ in rows:
        if v >= 200:
            if s in last and np.datetime64(t) - np.datetime64(last[s][1]) <= np.timedelta64(60, "m"):
                run = want[s, last[s][0]]
                run.append((t, v))
                last[s] = (last[s][0], t)
            else:
                want[s, t] = [(t, v)]
                last[s] = (t, t)
    assert got == {k: (run[-1][0], max(v for _, v in run), min((-v, t) for t, v in run)[1], len(run)) for k, run in want.items()}
    assert any(k[1] < "2024-02-01" <= v[0] for k, v in got.items())

    folder = str(tmp_path / "in")
    for i in range(3):
        df.where(F.date_format("measured_at", "dd").cast("int") % 3 == i).coalesce(1).write.mode("append").parquet(folder)
    q = E.episode_stream(L.read_levels(spark, folder, LEVELS, 1), 200.0, 60, "30 days").writeStream.format("memory").queryName("episodes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.station_id, str(r.start_at)): (str(r.end_at), r.peak_level_cm, str(r.peak_at), r.n_readings) for r in spark.table("episodes").collect()} == got


def test_cached_results_are_made_again_when_old(spark):
    from riverflux.plans.dashboard import TableCache

    now, made = [0.0], []
    cache = TableCache(300, lambda: now[0])
    make = lambda path: made.append(path) or spark.range(len(made)).write.parquet(path)
    assert [cache.get(spark, ("a",), make).count() for _ in range(2)] == [1, 1]
    now[0] = 299.0
    assert cache.get(spark, ("a",), make).count() == 1 and cache.get(spark, ("b",), make).count() == 2
    now[0] = 300.0
    assert cache.get(spark, ("a",), make).count() == 3


def test_predictions_are_numbered_on(spark, tmp_path):
    from riverflux.plans import dashboard as D

    row = lambda day, at, risk: spark.createDataFrame([(1, day, at, risk, 1.0, True)], "station_id int, d string, t string, risk_level string, level_24h_cm double, high_confidence boolean").selectExpr("station_id", "cast(d as date) as for_date", "cast(t as timestamp_ntz) as predicted_at", "risk_level", "level_24h_cm", "high_confidence")
    path = str(tmp_path / "p")
    storage.write_predictions(row("2024-01-01", "2024-01-01 06:00:00", "NORMAL").unionByName(row("2024-01-02", "2024-01-02 06:00:00", "NORMAL")), path)
    storage.write_predictions(row("2024-01-02", "2024-01-02 09:00:00", "GEFAHR"), path)
    table = spark.read.parquet(path)
    assert sorted(r.prediction_id for r in table.collect()) == [1, 2, 3]
    day = F.lit("2024-01-02").cast("date")
    assert D.latest_prediction(table, day).first().risk_level == "GEFAHR"
    last = spark.createDataFrame([(5.0, 1.0)], "latest_cm double, delta_cm double")
    assert D.kpi_row(last, D.latest_prediction(table, day)).first().risk_level == "GEFAHR"
    assert D.kpi_row(last, D.latest_prediction(table, F.lit("2030-01-01").cast("date"))).first().asDict() == {"latest_cm": 5.0, "delta_cm": 1.0, "risk_level": None, "level_24h_cm": None, "high_confidence": None}


def test_partly_trained_models_assess(spark):
    from riverflux.operators import assess, reports

    rng = np.random.default_rng(2)
    rows = [(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", *map(float, rng.normal(m, 5, 5)), label) for i, (m, label) in enumerate([(20, "NORMAL"), (60, "ERHOHT"), (99, "GEFAHR")] * 20)]
    df = profile_rows(spark, rows)
    with pytest.raises(ValueError):
        assess.assess(df, assess.Models())
    models = assess.train_models(df)
    out = assess.assess(df, models)
    first = out.orderBy("day").first()
    assert first.travel_hours == -1 and first.forecast is None and first.risk_level == "NORMAL"
    now = spark.createDataFrame([("2024-01-01", "2024-01-01 12:00:00", 20.0, 1.0, 30.0, 0.0)], "d string, t string, level_cm double, rate_cm_h double, upstream_cm double, precip_mm double").selectExpr("cast(d as date) as day", "cast(t as timestamp_ntz) as hour", "level_cm", "rate_cm_h", "upstream_cm", "precip_mm")
    models.travel, models.regression = (0.0, 7.0), {h: [float(h), 1.0, 0.0, 0.0, 0.0, 0.0, 0.0] for h in (6, 12, 24)}
    both = assess.assess(df, models, now).orderBy("day").collect()
    assert both[0].forecast.asDict() == {"level_6h_cm": 26.0, "level_12h_cm": 32.0, "level_24h_cm": 44.0} and both[1].forecast is None
    lines = [r.lines for r in reports.assessment_report(assess.assess(df, models, now)).orderBy("day").collect()]
    assert lines[0][0].startswith("risk: NORMAL") and "arrival in 7.0 hours" in lines[0] and "levels: 26 cm in 6 h, 32 cm in 12 h, 44 cm in 24 h" in lines[0] and len(lines[1]) < len(lines[0])


def test_a_day_without_readings_is_an_error(spark):
    df = levels(spark, [(1, "2024-01-02 10:00:00", 1.0, "a")])
    rain = df.select("station_id", "measured_at", F.lit(0.0).alias("rainfall_mm"))
    from riverflux.schemas import flood_events

    assert readings.required_profile(df, rain, flood_events(spark), "2024-01-02").count() == 1
    with pytest.raises(ValueError):
        readings.required_profile(df, rain, flood_events(spark), "2024-01-03")
