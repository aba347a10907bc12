"""Reports as tables of text lines (line_no, line), for models and assessments; each is as small as the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverflux.functions.risk import RISKS
from riverflux.operators.ordering import numbered


def as_lines(rows: DataFrame, order: list[str], line: Column) -> DataFrame:
    return numbered(rows.select(*order, line.alias("line")), order, "line_no").select("line_no", "line")


def cpt_report(cpt: DataFrame, given: list[str], of: str, values: tuple[str, ...]) -> DataFrame:
    """A line for each combination of what is given: the share of each value."""
    shares = [F.concat(F.lit(f"{v}="), F.format_string("%.3f", F.max(F.when(F.col(of) == v, F.col("p"))))) for v in values]
    rows = cpt.groupBy(*given).agg(F.concat_ws(" ", *shares).alias("shares"))
    return as_lines(rows, given, F.concat(F.lit(f"P({of} | "), F.concat_ws(", ", *given), F.lit("): "), F.col("shares")))


def confusion_report(confusion: DataFrame) -> DataFrame:
    """A line for each actual risk with the counts of the predicted ones, its recall, and the overall accuracy last."""
    n = lambda r: F.sum(F.when(F.col("predicted") == r, F.col("n")).otherwise(0))
    hit = F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0))
    cells = F.concat_ws(" ", *[F.concat(F.lit(f"{r}="), n(r).cast("string")) for r in RISKS])
    share = lambda x: F.format_string("%.1f", 100 * F.coalesce(F.try_divide(x, F.sum("n")), F.lit(0.0)))
    rows = confusion.groupBy("actual").agg(F.concat(cells, F.lit(" recall="), share(hit), F.lit("%")).alias("text"))
    place = F.array_position(F.array(*map(F.lit, RISKS)), F.col("actual")).cast("long")
    rows = rows.select(place.alias("place"), F.concat(F.col("actual"), F.lit(": "), F.col("text")).alias("line"))
    total = confusion.agg(F.lit(len(RISKS) + 1).cast("long").alias("place"), F.concat(F.lit("accuracy="), share(hit), F.lit("% of "), F.sum("n").cast("string")).alias("line"))
    return rows.unionByName(total).select(F.col("place").alias("line_no"), "line")


def assessment_report(assessed: DataFrame) -> DataFrame:
    """day, lines: what each model says of a day, the vote first; forecasts and anomalies only where there are any."""
    percent = lambda c: F.format_string("%.0f%%", F.col(c) * 100)
    forecast = F.format_string("levels: %.0f cm in 6 h, %.0f cm in 12 h, %.0f cm in 24 h", "forecast.level_6h_cm", "forecast.level_12h_cm", "forecast.level_24h_cm")
    lines = [
        F.concat(F.lit("risk: "), F.col("risk_level"), F.when(F.col("high_confidence"), ", all models agree").otherwise(", models differ")),
        F.concat(F.lit("naive_bayes: "), F.col("nb_risk"), F.lit(" P(GEFAHR)="), percent("p_gefahr"), F.lit(" P(ERHOHT)="), percent("p_erhoht")),
        F.concat(F.lit("bayes_net: "), F.col("bn_risk"), F.lit(" P(GEFAHR)="), percent("bn_gefahr"), F.lit(" P(ERHOHT)="), percent("bn_erhoht")),
        F.concat(F.lit("kmeans: "), F.col("km_risk")),
        F.when(F.col("is_anomaly"), "dbscan: anomaly").otherwise(F.concat(F.lit("dbscan: cluster "), F.col("dbscan_cluster").cast("string"))),
        F.col("travel_text"),
        F.when(F.col("forecast").isNotNull(), forecast),
        F.when(F.col("is_anomaly"), F.col("anomaly_text")),
    ]
    return assessed.select("day", F.array_compact(F.array(*lines)).alias("lines"))
