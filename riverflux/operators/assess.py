"""Training all profile models and assessing days with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverflux.operators import bayes, clusters, series
from riverflux.scratch import written


@dataclass
class Models:
    """Models that are trained; the profile models (the first five) come together, the others each by itself."""

    kmeans: dict | None = None
    naive_bayes: DataFrame | None = None
    bayes_net: tuple[DataFrame, DataFrame] | None = None
    dbscan: DataFrame | None = None
    z: dict | None = None
    travel: tuple[float, float] | None = None
    regression: dict[int, list[float]] | None = None


def train_models(profiles: DataFrame, hours: DataFrame | None = None, samples: DataFrame | None = None) -> Models:
    """profiles: labelled; optional: hours, the aligned hourly series for the travel time, and samples, for the levels' regression."""
    travel = None
    if hours is not None:
        t = series.travel_fit(hours).first()
        travel = (t.slope, t.intercept)
    regression = None if samples is None else series.regression_fit(samples)
    soil, risk = bayes.bn_fit(profiles)
    return Models(clusters.kmeans_fit(profiles, ["day", "label"]), written(bayes.nb_fit(profiles)), (written(soil), written(risk)), written(clusters.dbscan(profiles, ["day", "label"]).drop("z", "id", "n_near")), clusters.z_params(profiles), travel, regression)


def assess(profiles: DataFrame, models: Models, now: DataFrame | None = None) -> DataFrame:
    """One row per day: all models' results, the vote, confidence, travel time (-1 if that model isn't trained) and
    forecast: level_6h_cm, level_12h_cm, level_24h_cm, null without a trained regression or features of the day.

    now: day and the regression's features at the hour that forecasts start from. Without profile models it is an error."""
    if None in (models.kmeans, models.naive_bayes, models.bayes_net, models.dbscan, models.z):
        raise ValueError("the profile models have to be trained first")
    days = profiles.dropDuplicates(["day"])
    nb = bayes.nb_score(days, models.naive_bayes, ["day"])
    bn = bayes.bn_infer(days, *models.bayes_net, ["day"])
    km = clusters.kmeans_predict(days, models.kmeans)
    db = clusters.dbscan_predict(days, models.dbscan, models.z, "day")
    out = km.join(nb, "day").join(bn, "day").join(db, "day").withColumn("is_anomaly", F.col("dbscan_cluster") == -1)
    risk, sure = series.ensemble(F.col("bn_risk"), F.col("nb_risk"), F.col("km_risk"), F.col("is_anomaly"))
    hours = series.travel_hours(F.col("upstream_max_cm"), *models.travel) if models.travel else F.lit(-1.0)
    arrival = F.format_string("arrival in %.1f hours", hours) if models.travel else F.lit("travel time model not trained")
    levels = [f"level_{h}h_cm" for h in series.HORIZONS]
    if models.regression and now is not None:
        found = series.regression_predict(now, models.regression).select(F.col("day").alias("at"), F.struct(*levels).alias("forecast"))
        out = out.join(found, F.col("day") == F.col("at"), "left").drop("at")
    else:
        out = out.withColumn("forecast", F.lit(None).cast("struct<" + ", ".join(f"{c}: double" for c in levels) + ">"))
    return out.withColumn("travel_text", arrival).withColumns({"risk_level": risk, "high_confidence": sure, "travel_hours": hours, "anomaly_text": F.when(F.col("is_anomaly"), clusters.describe_anomaly(models.z))})


def as_predictions(assessed: DataFrame, forecasts: DataFrame, station: int = 1) -> DataFrame:
    """Rows of the predictions table; forecasts as series.daily_forecasts gives them, null for days without one."""
    rows = assessed.join(forecasts, F.col("day") == F.col("for_date"), "left")
    return rows.select(
        F.lit(station).alias("station_id"), F.col("day").alias("for_date"), F.col("day").cast("timestamp_ntz").alias("predicted_at"), "risk_level", "p_normal", "p_erhoht", "p_gefahr",
        "level_6h_cm", "level_12h_cm", "level_24h_cm", "travel_hours", "is_anomaly", "dbscan_cluster", "high_confidence",
    )


def model_comparison(assessed: DataFrame) -> DataFrame:
    """day, model, p_normal, p_erhoht, p_gefahr: each model's own probabilities (a cluster's risk has 1)."""
    one = lambda risk: F.when(F.col("km_risk") == risk, 1.0).otherwise(0.0)
    models = {"naive_bayes": ["p_normal", "p_erhoht", "p_gefahr"], "bayes_net": ["bn_normal", "bn_erhoht", "bn_gefahr"]}
    rows = [F.struct(F.lit(m).alias("model"), *[F.col(c).alias(n) for c, n in zip(cols, models["naive_bayes"])]) for m, cols in models.items()]
    rows.append(F.struct(F.lit("kmeans").alias("model"), one("NORMAL").alias("p_normal"), one("ERHOHT").alias("p_erhoht"), one("GEFAHR").alias("p_gefahr")))
    return assessed.select("day", F.explode(F.array(*rows)).alias("x")).select("day", "x.*")
