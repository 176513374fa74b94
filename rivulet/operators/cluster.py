"""k-means, assignment, distances and cluster tables."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_kmeans(train: DataFrame, k: int, seed: int = 42, max_iter: int = 50, tol: float = 1e-4, column: str = "features") -> np.ndarray:
    """Centres (k or fewer, by d) of full-batch Lloyd from parallel k-means++."""
    rows = train.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, initMode="k-means||").fit(rows)
    return np.array(model.clusterCenters())


def best_of(train: DataFrame, k: int, n_init: int, seed: int = 42, max_iter: int = 50, column: str = "features") -> np.ndarray:
    """The centres with the least inertia of several seeds."""
    tries = [fit_kmeans(train, k, seed + i, max_iter, column=column) for i in range(n_init)]
    cost = [assign(train, c, column).agg(F.sum(F.col("cluster_distance") * F.col("cluster_distance"))).first()[0] or 0.0 for c in tries]
    return tries[int(np.argmin(cost))]


def distance(x: Column, y: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def assign(df: DataFrame, centers: np.ndarray, column: str = "features") -> DataFrame:
    """cluster_id and cluster_distance of the nearest centre, the lowest id on ties.

    Centres are a constant of k arrays, so no row is joined or repeated.
    """
    table = F.array(*(F.struct(F.lit(i).alias("id"), F.array(*(F.lit(float(v)) for v in c)).alias("c")) for i, c in enumerate(centers)))
    x = F.col(column).cast("array<double>")
    near = F.array_min(F.transform(table, lambda t: F.struct(distance(x, t["c"]).alias("d"), t["id"].alias("id"))))
    return df.withColumn("_near", near).withColumn("cluster_id", F.col("_near.id")).withColumn("cluster_distance", F.col("_near.d")).drop("_near")


def centroids(df: DataFrame, cluster: str = "cluster_id", column: str = "features") -> DataFrame:
    """(cluster, n, centroid): mean vectors, summed per dimension with map-side combination."""
    cells = df.select(cluster, F.posexplode(F.col(column).cast("array<double>")).alias("i", "v"))
    mean = cells.groupBy(cluster, "i").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return mean.groupBy(cluster).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))


def with_centroid_distance(df: DataFrame, cluster: str = "cluster_id", column: str = "features", name: str = "cluster_distance") -> DataFrame:
    """Distance of each row to its cluster's mean; the means are k rows and broadcast."""
    means = F.broadcast(centroids(df, cluster, column).withColumnRenamed(cluster, "_cluster").drop("n"))
    return df.join(means, F.col(cluster).eqNullSafe(F.col("_cluster"))).withColumn(name, distance(F.col(column).cast("array<double>"), F.col("centroid"))).drop("_cluster", "centroid")


def sizes(df: DataFrame, k: int, by: Iterable[str] = (), cluster: str = "cluster_id") -> DataFrame:
    """(by, cluster, count) with zeros for empty clusters."""
    by = list(by)
    counted = df.groupBy(*by).agg(*(F.count_if(F.col(cluster) == i).alias(str(i)) for i in range(k)))
    return counted.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias(cluster), F.col(str(i)).alias("count")) for i in range(k)))).alias("x")).select(*by, "x.*")


def checked_counts(df: DataFrame, k: int, require_all: bool = True, cluster: str = "cluster_id") -> np.ndarray:
    """Rows of each cluster; ValueError on ids out of range or, if asked, empty clusters."""
    rows = {r[cluster]: r["count"] for r in df.groupBy(cluster).count().collect()}
    if not rows or any(not isinstance(c, int) or not 0 <= c < k for c in rows):
        raise ValueError("cluster ids out of range")
    out = np.array([rows.get(i, 0) for i in range(k)])
    if require_all and not out.all():
        raise ValueError("fewer clusters observed than asked for")
    return out


def export(df: DataFrame, key: str) -> DataFrame:
    return df.select("split", F.col(key).alias("row_index"), "cluster_id", "cluster_distance")
