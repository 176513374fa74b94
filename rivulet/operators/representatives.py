"""Representative rows of clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.config import Config
from rivulet.operators.cluster import centroids, with_centroid_distance

CLUSTER, DISTANCE = "cluster_id", "cluster_distance"


def _distances(df: DataFrame) -> DataFrame:
    return df if DISTANCE in df.columns else with_centroid_distance(df)


def full(df: DataFrame, key: str, cfg: Config) -> DataFrame:
    return df


def medoid(df: DataFrame, key: str, cfg: Config) -> DataFrame:
    """The row nearest to each cluster's centre, the lowest key on ties.

    A minimum with partial minima, so a cluster of any size is combined before the shuffle.
    """
    rows = _distances(df)
    best = rows.groupBy(CLUSTER).agg(F.min(F.struct(DISTANCE, key)).alias("m")).select(F.col(f"m.{key}").alias(key))
    return rows.join(F.broadcast(best), key, "left_semi")


def boundary(df: DataFrame, key: str, cfg: Config) -> DataFrame:
    """The farthest rows of each cluster, the lowest key on ties."""
    if DISTANCE not in df.columns:
        raise ValueError("boundary_sample needs cluster distances")
    rank = F.row_number().over(Window.partitionBy(CLUSTER).orderBy(F.col(DISTANCE).desc(), key))
    return df.withColumn("_k", rank).filter(F.col("_k") <= cfg.boundary_per_cluster).drop("_k")


def stratified(df: DataFrame, key: str, cfg: Config, target: str = "label") -> DataFrame:
    """A budget for each cluster, shared by class in proportion, at least one each while it lasts.

    Quotas are half-even rounded shares given to classes in order of name; what is left goes to
    the next rows in hash order.  Quotas come from counts; rows are then ranked within their class.
    """
    cls = F.col(target).cast("string")
    counts = df.groupBy(CLUSTER, cls.alias("_class")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(CLUSTER)
    counts = counts.withColumn("_size", F.sum("_n").over(own)).withColumn("_budget", F.least(F.lit(cfg.representatives_per_cluster).cast("bigint"), "_size"))
    wish = F.greatest(F.lit(1), F.bround(F.col("_budget") * F.col("_n") / F.col("_size"))).cast("bigint")
    counts = counts.withColumn("_wish", F.least(wish, "_n"))
    # what a class may take is what those before it left, as each takes the least of wish and rest
    before = F.coalesce(F.sum("_wish").over(own.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_quota", F.greatest(F.lit(0), F.least("_wish", F.col("_budget") - before)))
    counts = counts.withColumn("_left", F.col("_budget") - F.sum("_quota").over(own)).select(F.col(CLUSTER).alias("_cl"), "_class", "_quota", "_left")
    draw = F.xxhash64(F.lit(cfg.random_state), key)
    rows = df.withColumn("_t", cls).join(F.broadcast(counts), F.col(CLUSTER).eqNullSafe(F.col("_cl")) & F.col("_t").eqNullSafe(F.col("_class")))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(CLUSTER, "_t").orderBy(draw, key)))
    # no more than a cluster's budget can be chosen of a class, so tasks keep only that many before the shuffle
    rows = rows.filter(F.col("_place") <= cfg.representatives_per_cluster)
    # only the first rows of a class can be chosen, so the second ranking sees few
    rows = rows.filter(F.col("_place") <= F.col("_quota") + F.col("_left")).withColumn("_spare", F.col("_place") > F.col("_quota"))
    fill = F.row_number().over(Window.partitionBy(CLUSTER, "_spare").orderBy(draw, key))
    rows = rows.withColumn("_fill", fill).filter(~F.col("_spare") | (F.col("_fill") <= F.col("_left")))
    return rows.drop("_t", "_cl", "_class", "_quota", "_left", "_place", "_spare", "_fill")


def mixed(df: DataFrame, key: str, cfg: Config, target: str = "label") -> DataFrame:
    """Medoids, boundary and stratified rows, each once."""
    keys = medoid(df, key, cfg).select(key).union(boundary(df, key, cfg).select(key)).union(stratified(df, key, cfg, target).select(key)).distinct()
    return df.join(F.broadcast(keys), key, "left_semi")


def centroid(df: DataFrame, key: str, cfg: Config) -> DataFrame:
    """Synthetic rows: the mean vector, the majority of each target (smallest on ties), weight n."""
    out = centroids(df)
    for t in [t for t in cfg.targets if t in df.columns]:
        tall = df.groupBy(CLUSTER, F.col(t).cast("string").alias("v")).agg(F.count("*").alias("k"))
        most = tall.groupBy(F.col(CLUSTER).alias("_c")).agg(F.min(F.struct((-F.col("k")).alias("k"), "v")).alias("m")).select("_c", F.col("m.v").alias(t))
        out = out.join(F.broadcast(most), F.col(CLUSTER).eqNullSafe(F.col("_c"))).drop("_c")
    return out.withColumnRenamed("n", "weight")


STRATEGIES: dict[str, Callable[[DataFrame, str, Config], DataFrame]] = {"full": full, "centroid": centroid, "medoid": medoid, "stratified_sample": stratified, "boundary_sample": boundary, "mixed": mixed}


def select(df: DataFrame, key: str, cfg: Config) -> DataFrame:
    if cfg.representative_strategy not in STRATEGIES:
        raise ValueError(f"unknown representative strategy {cfg.representative_strategy!r}; one of {', '.join(STRATEGIES)}")
    return STRATEGIES[cfg.representative_strategy](df, key, cfg)


def summary(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """(cluster, original_n, representative_n, ratio)."""
    a = df.groupBy(CLUSTER).agg(F.count("*").alias("original_n"))
    b = chosen.groupBy(F.col(CLUSTER).alias("_c")).agg(F.count("*").alias("representative_n"))
    joined = a.join(b, F.col(CLUSTER).eqNullSafe(F.col("_c")), "left").drop("_c").withColumn("representative_n", F.coalesce("representative_n", F.lit(0).cast("bigint")))
    return joined.withColumn("ratio", F.col("representative_n") / F.col("original_n"))


def metadata(df: DataFrame, chosen: DataFrame, cfg: Config) -> dict:
    n, m = df.count(), chosen.count()
    return {"strategy": cfg.representative_strategy, "original_n": n, "representative_n": m, "compression_ratio": m / n if n else None, "kind": "synthetic_centroids" if cfg.representative_strategy == "centroid" else "real_points"}
