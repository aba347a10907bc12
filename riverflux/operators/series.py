"""Travel time, correlations, level regression and the vote over all models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverflux.functions.risk import RISKS, seasonal_wave
from riverflux.operators.ordering import in_blocks

MAX_LAG, SEARCH, PEAK = 48, 12, 1.2
HORIZONS = (6, 12, 24)


def lagged(series: DataFrame, max_lag: int) -> DataFrame:
    """series with down0, down1, ...: the downstream level so many rows later. i are consecutive numbers, so a block of
    them needs max_lag more rows and one window finds all lags; each row is shuffled once, those near a block's end twice."""
    w = Window.partitionBy("block").orderBy("i")
    return in_blocks(series, "i", 0, max_lag).withColumns({f"down{k}": F.lead("down", k).over(w) for k in range(max_lag + 1)}).where("inside")


def of_each_lag(rows: DataFrame, max_lag: int, **values) -> DataFrame:
    """lag and the named aggregates (functions of the later downstream level) of rows of lagged(); one pass, one row a task."""
    one = rows.agg(*[F.struct(F.lit(k).alias("lag"), *[f(F.col(f"down{k}")).alias(n) for n, f in values.items()]).alias(f"l{k}") for k in range(max_lag + 1)])
    return one.select(F.explode(F.array(*[f"l{k}" for k in range(max_lag + 1)])).alias("l")).select("l.*").where("n > 0")


def cross_correlation(series: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """lag, r with the whole series' means and deviations, divided by the number of pairs."""
    m = series.agg(F.avg("up").alias("mu"), F.avg("down").alias("md"), F.stddev_pop("up").alias("su"), F.stddev_pop("down").alias("sd"))
    rows = lagged(series, max_lag).crossJoin(F.broadcast(m))  # one row
    g = of_each_lag(rows, max_lag, n=F.count, s=lambda d: F.sum((F.col("up") - F.col("mu")) * (d - F.col("md"))), of=lambda d: F.max(F.col("su") * F.col("sd")))
    return g.select("lag", F.when(F.col("of") > 0, F.col("s") / F.col("n") / F.col("of")).otherwise(0.0).alias("r"))


def pearson_by_lag(series: DataFrame, max_lag: int = 24) -> DataFrame:
    """lag, r over the pairs of each lag; lags of five pairs or fewer, or with a constant side, drop out."""
    up = lambda d: F.when(d.isNotNull(), F.col("up"))
    g = of_each_lag(lagged(series, max_lag), max_lag, n=F.count, c=lambda d: F.covar_pop(up(d), d), u=lambda d: F.stddev_pop(up(d)), d=F.stddev_pop)
    return g.where("n > 5 and u > 0 and d > 0").select("lag", (F.col("c") / (F.col("u") * F.col("d"))).alias("r"))


def best_lag(correlations: DataFrame) -> DataFrame:
    return correlations.orderBy(F.desc("r"), "lag").limit(1)


def peak_pairs(series: DataFrame, lag: int) -> DataFrame:
    """i, up, travel: each high local maximum upstream and the hours to the highest value downstream around
    the lag (of equally high ones the first), where that is 1 to MAX_LAG hours."""
    w = Window.partitionBy("block").orderBy("i")
    stats = series.agg(F.avg("up").alias("mean"), F.count("*").alias("n"))  # one row
    rows = in_blocks(series, "i", 1, 1).withColumns({"before": F.lag("up").over(w), "after": F.lead("up").over(w)}).where("inside").crossJoin(F.broadcast(stats))
    peaks = rows.where((F.col("up") > F.col("before")) & (F.col("up") > F.col("after")) & (F.col("up") > F.col("mean") * PEAK) & (F.col("i") >= 1) & (F.col("i") < F.col("n") - lag - 1))
    first, last = F.greatest(F.col("i"), F.col("i") + lag - SEARCH), F.least(F.col("n") - 1, F.col("i") + lag + SEARCH)
    reach = peaks.select("i", "up", F.explode(F.sequence(first, last)).alias("j")).join(series.select(F.col("i").alias("j"), "down"), "j")
    top = reach.groupBy("i", "up").agg(F.max_by("j", F.struct("down", -F.col("j"))).alias("j"))
    return top.select("i", "up", (F.col("j") - F.col("i")).alias("travel")).where((F.col("travel") > 0) & (F.col("travel") <= MAX_LAG))


def travel_fit(series: DataFrame) -> DataFrame:
    """One row: best lag, number of pairs, slope and intercept of travel time over the upstream level."""
    n = series.count()
    if n < MAX_LAG + 10:
        raise ValueError(f"{n} hours are too few; {MAX_LAG + 10} are needed")
    lag = best_lag(cross_correlation(series)).first().lag
    fit = peak_pairs(series, lag).agg(F.count("*").alias("n_pairs"), F.regr_slope("travel", "up").alias("s"), F.avg("travel").alias("t"), F.avg("up").alias("u"))
    slope = F.when(F.col("n_pairs") < 2, 0.0).otherwise(F.coalesce("s", F.lit(0.0)))
    return fit.select(F.lit(int(lag)).alias("lag"), "n_pairs", slope.alias("slope"), F.when(F.col("n_pairs") < 2, float(lag)).otherwise(F.col("t") - slope * F.col("u")).alias("intercept"))


def travel_hours(upstream: Column, slope: float, intercept: float) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(float(MAX_LAG)), F.lit(slope) * upstream + F.lit(intercept)))


def design(samples: DataFrame) -> DataFrame:
    """samples with x: constant, level, rate, upstream, rain and the day's place in the year."""
    sin, cos = seasonal_wave(F.col("hour"))
    return samples.withColumn("x", F.array(F.lit(1.0), "level_cm", "rate_cm_h", "upstream_cm", "precip_mm", sin, cos))


def gram(samples: DataFrame) -> DataFrame:
    """i, j, v: sums of products of all features and, as columns 7 to 9, the targets; one pass over the rows."""
    cols = [F.get("x", i) for i in range(7)] + [F.col(f"target_{h}h") for h in HORIZONS]
    pairs = [(i, j) for i in range(7) for j in range(i, 10)]
    one = design(samples).agg(*[F.sum(cols[i] * cols[j]).alias(f"p{i}_{j}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("v")) for i, j in pairs])).alias("g")).select("g.*").where("v is not null")


def regression_fit(samples: DataFrame) -> dict[int, list[float]]:
    """Weights per horizon from the 7 x 7 normal equations; directions without information get 0."""
    a, b = np.zeros((7, 7)), np.zeros((7, 3))
    for r in gram(samples).collect():  # 49 numbers
        if r.j < 7:
            a[r.i, r.j] = a[r.j, r.i] = r.v or 0.0
        else:
            b[r.i, r.j - 7] = r.v or 0.0
    scale = np.sqrt(np.diag(a))  # columns of equal length, so that no unit decides what counts as without information
    scale[scale == 0] = 1
    w = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-12) @ (b / scale[:, None]) / scale[:, None]
    return {h: w[:, k].tolist() for k, h in enumerate(HORIZONS)}


def regression_predict(samples: DataFrame, weights: dict[int, list[float]]) -> DataFrame:
    """samples with level_6h_cm, level_12h_cm, level_24h_cm, none below 0."""
    out = design(samples)
    for h, w in weights.items():
        out = out.withColumn(f"level_{h}h_cm", F.greatest(F.lit(0.0), sum((F.lit(v) * F.get("x", i) for i, v in enumerate(w)), F.lit(0.0))))
    return out.drop("x")


def daily_forecasts(features: DataFrame, samples: DataFrame, day: Column) -> DataFrame:
    """for_date and the levels expected 6, 12 and 24 hours after the day's last hour, by the regression on samples."""
    levels = [f"level_{h}h_cm" for h in HORIZONS]
    rows = regression_predict(features, regression_fit(samples)).groupBy(day.alias("for_date")).agg(F.max_by(F.struct(*levels), "hour").alias("x"))
    return rows.select("for_date", *[f"x.{c}" for c in levels])


def rmse(predicted: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("horizon"), F.sqrt(F.avg(F.pow(F.col(f"level_{h}h_cm") - F.col(f"target_{h}h"), 2))).alias("rmse")) for h in HORIZONS]
    return predicted.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def ensemble(bayes_net: Column, naive_bayes: Column, kmeans: Column, anomaly: Column) -> tuple[Column, Column]:
    """risk and high_confidence: votes of 3, 2 and 1, of equal sums the lower risk; an anomaly is at
    least ERHOHT and never of high confidence."""
    votes = F.array(*[sum((F.when(v == r, w).otherwise(0) for v, w in ((bayes_net, 3), (naive_bayes, 2), (kmeans, 1))), F.lit(0)) for r in RISKS])
    best = F.element_at(F.array(*map(F.lit, RISKS)), F.array_position(votes, F.array_max(votes)).cast("int"))
    risk = F.when(anomaly & (best == "NORMAL"), "ERHOHT").otherwise(best)
    return risk, (bayes_net == naive_bayes) & (naive_bayes == kmeans) & ~anomaly

