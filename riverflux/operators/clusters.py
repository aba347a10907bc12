"""K-Means and DBSCAN over profile features. Models are small numbers; rows stay distributed."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverflux.functions.risk import FEATURES
from riverflux.operators.ordering import drawn, numbered
from riverflux.operators.spatial import distance, grid_for, groups, near_counts, near_edges, near_groups
from riverflux.scratch import written


def z_params(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature; a constant feature gets deviation 1."""
    r = rows.agg(*[f(c).alias(f"{p}_{c}") for c in FEATURES for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (r[f"m_{c}"] or 0.0, r[f"s_{c}"] if r[f"s_{c}"] and r[f"s_{c}"] > 1e-9 else 1.0) for c in FEATURES}


def z_scored(rows: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumn("z", F.array(*[(F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()]))


def nearest(z: Column, centroids: list[list[float]]) -> Column:
    """Index of the nearest centroid, of equally near ones the first."""
    d = F.array(*[distance(z, F.array(*map(F.lit, c)), len(c)) for c in centroids])
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def seed_draws(k: int, seed: int) -> list[float]:
    """The numbers from 0 to below 1 that the seeds are drawn with."""
    return [random.Random(f"{seed}/{i}").random() for i in range(k)]


def kmeans_fit(rows: DataFrame, order: list[str], k: int = 3, max_iter: int = 200, seed: int = 42) -> dict:
    """Centroids in z-scores, and each cluster's risk by the rank of its mean level.

    Seeds are drawn one after the other from the rows in their order: the first evenly, the others with the distance to
    the nearest seed as weight, so no row is drawn twice."""
    params = z_params(rows)
    z = written(z_scored(rows, params).select("z", *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]))
    by = [f"o{i}" for i in range(len(order))]
    centroids: list[list[float]] = []
    for u in seed_draws(k, seed):
        weight = F.lit(1.0) if not centroids else F.array_min(F.array(*[distance(F.col("z"), F.array(*map(F.lit, c)), len(c)) for c in centroids]))
        pick = drawn(z.withColumn("w", weight), by, "w", [u]).first()
        if pick is None:  # no other rows are left
            break
        centroids.append(list(pick.z))
    for _ in range(max_iter):
        means = z.groupBy(nearest(F.col("z"), centroids).alias("c")).agg(*[F.avg(F.get("z", j)).alias(f"z{j}") for j in range(len(FEATURES))]).collect()
        new = [list(c) for c in centroids]  # an empty cluster keeps its centroid
        for r in means:
            new[r.c] = [r[f"z{j}"] for j in range(len(FEATURES))]
        if all(abs(a - b) < 1e-12 for x, y in zip(new, centroids) for a, b in zip(x, y)):
            break
        centroids = new
    order = sorted(range(len(centroids)), key=lambda i: (centroids[i][0], i))
    risks = {c: ("NORMAL", "ERHOHT", "GEFAHR")[min(rank, 2)] for rank, c in enumerate(order)}
    return {"z": params, "centroids": centroids, "risks": risks}


def kmeans_predict(rows: DataFrame, model: dict) -> DataFrame:
    """rows with cluster and km_risk."""
    out = z_scored(rows, model["z"]).withColumn("cluster", nearest(F.col("z"), model["centroids"])).drop("z")
    risk = F.lit("NORMAL")
    for c, name in model["risks"].items():
        risk = F.when(F.col("cluster") == c, name).otherwise(risk)
    return out.withColumn("km_risk", risk)


def weighted_points(rows: DataFrame) -> DataFrame:
    """pid (the smallest id), z, n: equal rows of a table with id and z as one; rows without a feature are left out."""
    whole = F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v))
    return rows.where(whole).groupBy("z").agg(F.min("id").alias("pid"), F.count("*").alias("n")).select("pid", "z", "n")


def neighbour_counts(rows: DataFrame, eps: float = 1.0) -> DataFrame:
    """z, n_near: how many rows of a table with id and z lie within eps of each z, itself included."""
    points = written(weighted_points(rows))
    return points.join(near_counts(points, points, grid_for(eps, points)), "pid").select("z", "n_near")


def dbscan(rows: DataFrame, order: list[str], eps: float = 1.0, min_points: int = 10) -> DataFrame:
    """rows with id (1.. in the order), z, cluster (0.. by their first core row in the order, -1 for noise) and n_near
    (itself included; 0 for rows without a feature, which are noise).

    Equal rows are one point with a weight. Neighbours are counted, core points linked and border rows assigned by
    boxes (see spatial): only boxes that the radius cuts through are looked into, however dense a place is. A border row
    belongs to the lowest-numbered cluster that has a core row near it."""
    rows = written(z_scored(numbered(rows, order, "id"), z_params(rows)))
    points = written(weighted_points(rows))
    grid = grid_for(eps, points)
    counted = written(points.join(near_counts(points, points, grid), "pid"))
    core, others = counted.where(F.col("n_near") >= min_points), counted.where(F.col("n_near") < min_points)
    roots = written(groups(near_edges(core, grid)))
    names = numbered(roots.select("root").distinct(), ["root"], "cluster", 0)
    of_core = written(core.join(roots, core.pid == roots.node).join(names, "root").select("pid", "z", "n", F.col("cluster").alias("c")))
    beside = near_groups(others, of_core, grid).groupBy("pid").agg(F.min("c").alias("c"))
    known = of_core.select("pid", "c").unionByName(beside)
    found = written(counted.join(known, "pid", "left").select(F.col("z").alias("of"), "n_near", F.coalesce("c", F.lit(-1)).cast("int").alias("cluster")))
    out = rows.join(found, rows.z == found.of, "left").drop("of")
    return out.withColumns({"n_near": F.coalesce("n_near", F.lit(0)), "cluster": F.coalesce("cluster", F.lit(-1))})


def dbscan_predict(rows: DataFrame, fitted: DataFrame, params: dict, id_col: str, eps: float = 1.0) -> DataFrame:
    """id_col and dbscan_cluster of new rows: the commonest cluster among the fitted rows near it (of equally
    common ones the lowest), or -1 if none is near."""
    new = written(z_scored(rows, params).select(F.col(id_col).alias("key"), "z", F.monotonically_increasing_id().alias("id")))
    known = z_scored(fitted, params).where("cluster >= 0").groupBy("z", F.col("cluster").alias("c")).agg(F.count("*").alias("n"))
    known = written(known.withColumn("pid", F.monotonically_increasing_id()))
    points = written(weighted_points(new))
    votes = near_groups(points, known, grid_for(eps, points, known))
    best = votes.groupBy("pid").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("c"))
    of_z = points.join(best, "pid").select(F.col("z").alias("of"), "c")
    return new.join(of_z, new.z == of_z.of, "left").select(F.col("key").alias(id_col), F.coalesce("c", F.lit(-1)).cast("int").alias("dbscan_cluster"))


def describe_anomaly(params: dict) -> Column:
    """The features that lie more than two deviations from the mean, as text."""
    parts = []
    for c, (m, s) in params.items():
        z = F.abs((F.col(c) - F.lit(m)) / F.lit(s))
        parts.append(F.when(z > 2.0, F.format_string(f"{c}: %.1f (z=%.1f)", F.col(c), z)))
    found = F.array_compact(F.array(*parts))
    return F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise("no single feature stands out")
