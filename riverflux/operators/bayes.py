"""Gaussian naive Bayes, its cross-validation, and a small discrete Bayesian network, as joins and sums."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverflux.functions.risk import FEATURES, RAIN_BINS, RISKS, SEASONS, SOILS, UPSTREAM_BINS, rain_bin, season, soil_moisture, upstream_bin
from riverflux.operators.ordering import dealt
from riverflux.scratch import written

LEAST_VARIANCE = 1e-9
ALPHA = 1.0


def domain(spark, **columns: tuple[str, ...]) -> DataFrame:
    """All combinations of small value lists."""
    frames = [spark.createDataFrame([(v,) for v in values], f"{name} string") for name, values in columns.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)  # the lists are constants


def nb_fit(profiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per risk (and value of by): prior, and mean and sample variance of each feature.

    A risk with one row has variance 1; one without rows has mean 0, variance 1 and prior 1/(N + 3). by has few values (the
    folds): what is fitted is a row for each of them and risk, from one aggregate."""
    by = by or []
    moments = [(f"{p}_{c}", f, d) for c in FEATURES for p, f, d in (("mean", F.avg, 0.0), ("var", F.var_samp, 1.0))]
    found = profiles.groupBy(*by, "label").agg(F.count("*").alias("n"), *[f(name.split("_", 1)[1]).alias(name) for name, f, _ in moments]).collect()
    total: dict[tuple, int] = {}
    for r in found:
        total[tuple(r[b] for b in by)] = total.get(tuple(r[b] for b in by), 0) + r["n"]
    known = {(*(r[b] for b in by), r["label"]): r for r in found}
    rows = []
    for group, n in sorted(total.items()):
        for risk in RISKS:
            r = known.get((*group, risk))
            rows.append((*group, risk, r["n"] / n if r else 1 / (n + 3), *[d if r is None or r[name] is None else r[name] for name, _, d in moments]))
    kinds = [f"{b} {dict(profiles.dtypes)[b]}" for b in by] + ["label string", "prior double"] + [f"{name} double" for name, _, _ in moments]
    return profiles.sparkSession.createDataFrame(rows, ", ".join(kinds))


def log_density(x: Column, mean: Column, var: Column) -> Column:
    v = F.greatest(var, F.lit(LEAST_VARIANCE))
    return -0.5 * F.log(2 * F.lit(3.141592653589793) * v) - (x - mean) * (x - mean) / (2 * v)


def nb_score(rows: DataFrame, params: DataFrame, id_cols: list[str], on: list[str] | None = None) -> DataFrame:
    """id_cols with p_normal, p_erhoht, p_gefahr and nb_risk, for each of rows. params: three rows (for each value of on), which
    go to all tasks as one, so that rows are not shuffled."""
    values = F.struct(*[c for c in params.columns if c not in ("label", *(on or []))])
    wide = F.broadcast(params.groupBy(*(on or [])).agg(*[F.max(F.when(F.col("label") == r, values)).alias(f"of_{r}") for r in RISKS]))
    joined = rows.join(wide, on) if on else rows.crossJoin(wide)
    joint = lambda r: F.log(F.col(f"of_{r}.prior")) + sum((log_density(F.col(c), F.col(f"of_{r}.mean_{c}"), F.col(f"of_{r}.var_{c}")) for c in FEATURES), F.lit(0.0))
    scored = joined.select(*id_cols, *[joint(r).alias(r) for r in RISKS])
    top = F.greatest(*RISKS)
    total = sum((F.exp(F.col(r) - top) for r in RISKS), F.lit(0.0))
    risk = F.when(F.col("NORMAL") == top, "NORMAL").when(F.col("ERHOHT") == top, "ERHOHT").otherwise("GEFAHR")
    return scored.select(*id_cols, *[(F.exp(F.col(r) - top) / total).alias(f"p_{r.lower()}") for r in RISKS], risk.alias("nb_risk"))


def folds(profiles: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Each profile's fold, 1 to k, in an order shuffled by a hash."""
    order = F.md5(F.concat_ws(":", F.col("day").cast("string"), F.lit(str(seed))))
    return dealt(profiles, [order, "day"], k, "fold")


def held_out(profiles: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """day, label, fold, nb_risk: each profile scored by the model of the other folds, all trained in one aggregation."""
    rows = written(folds(profiles, k, seed))
    train = rows.withColumn("out", F.explode(F.array_remove(F.sequence(F.lit(1), F.lit(k)), F.col("fold")))).drop("fold").withColumnRenamed("out", "fold")
    return nb_score(rows, nb_fit(train, ["fold"]), ["day", "label", "fold"], ["fold"])


def cross_validate(profiles: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """3 x 3 confusion counts of naive Bayes."""
    counts = held_out(profiles, k, seed).groupBy(F.col("label").alias("actual"), F.col("nb_risk").alias("predicted")).agg(F.count("*").alias("n"))
    return domain(profiles.sparkSession, actual=RISKS, predicted=RISKS).join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def fold_accuracy(profiles: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """fold, n, accuracy of each fold, and of all as fold 0."""
    right = F.avg((F.col("label") == F.col("nb_risk")).cast("double")).alias("accuracy")
    return held_out(profiles, k, seed).rollup("fold").agg(F.count("*").alias("n"), right).withColumn("fold", F.coalesce("fold", F.lit(0)))


def precision_recall(confusion: DataFrame) -> DataFrame:
    """Per risk, 0 where nothing was predicted or nothing was there."""
    rows = confusion.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(True).alias("is_actual"), "actual", "predicted", "n"), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_actual"), "actual", "predicted", "n"))).alias("x")).select("x.*")
    hit = F.sum(F.when(F.col("is_actual") & (F.col("actual") == F.col("predicted")), F.col("n")).otherwise(0))
    ratio = lambda side: F.coalesce(F.try_divide(hit, F.sum(F.when(side, F.col("n")).otherwise(0))), F.lit(0.0))
    return rows.groupBy("label").agg(ratio(~F.col("is_actual")).alias("precision"), ratio(F.col("is_actual")).alias("recall"))


def binned(profiles: DataFrame) -> DataFrame:
    mm = F.col("total_precip_mm")
    return profiles.withColumns({"rain": rain_bin(mm), "season": season(F.col("day")), "upstream": upstream_bin(F.col("upstream_max_cm")), "soil": soil_moisture(F.col("day"), mm)})


def cpt(counts: dict[tuple[str, ...], int], given: tuple[tuple[str, ...], ...], values: tuple[str, ...]) -> list[tuple]:
    """(given..., value, P(value | given)) with Laplace smoothing, for all combinations."""
    out = []
    for g in product(*given):
        n = [counts.get((*g, v), 0) for v in values]
        out += [(*g, v, (k + ALPHA) / (sum(n) + ALPHA * len(values))) for v, k in zip(values, n)]
    return out


def bn_fit(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P(soil | rain, season) and P(risk | upstream, soil) from labelled profiles: one aggregate to at most 324 counts, which
    are all that both tables need."""
    rows = binned(profiles.where(F.col("label").isin(*RISKS)))
    soils, risks = Counter(), Counter()
    for r in rows.groupBy("rain", "season", "upstream", "soil", "label").agg(F.count("*").alias("n")).collect():
        soils[r.rain, r.season, r.soil] += r.n
        risks[r.upstream, r.soil, r.label] += r.n
    spark = profiles.sparkSession
    soil = spark.createDataFrame(cpt(soils, (RAIN_BINS, SEASONS), SOILS), "rain string, season string, soil string, p double")
    return soil, spark.createDataFrame(cpt(risks, (UPSTREAM_BINS, SOILS), RISKS), "upstream string, soil string, risk string, p double")


def bn_infer(profiles: DataFrame, soil_cpt: DataFrame, risk_cpt: DataFrame, id_cols: list[str]) -> DataFrame:
    """id_cols with bn_normal, bn_erhoht, bn_gefahr and bn_risk: the soil is summed out."""
    table = soil_cpt.withColumnRenamed("p", "p_soil").join(risk_cpt, "soil").groupBy("rain", "season", "upstream", "risk").agg(F.sum(F.col("p_soil") * F.col("p")).alias("p"))
    wide = table.groupBy("rain", "season", "upstream").agg(*[F.sum(F.when(F.col("risk") == r, F.col("p"))).alias(r) for r in RISKS])
    rows = binned(profiles).select(*id_cols, "rain", "season", "upstream").join(F.broadcast(wide), ["rain", "season", "upstream"])  # 36 rows
    total, top = sum((F.col(r) for r in RISKS), F.lit(0.0)), F.greatest(*RISKS)
    risk = F.when(F.col("NORMAL") == top, "NORMAL").when(F.col("ERHOHT") == top, "ERHOHT").otherwise("GEFAHR")
    return rows.select(*id_cols, *[(F.col(r) / total).alias(f"bn_{r.lower()}") for r in RISKS], risk.alias("bn_risk"))
