"""Clustering metrics: internal geometry, contingency, concentration, stability."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.cluster import with_centroid_distance

#: Rows that silhouettes may compare with each other.
MOST_SAMPLE = 100_000

# Internal -------------------------------------------------------------------------------------


def inertia(df: DataFrame) -> DataFrame:
    """inertia and clusters_observed."""
    return df.agg(F.sum(F.col("cluster_distance") * F.col("cluster_distance")).alias("inertia"), F.count_distinct("cluster_id").alias("clusters_observed"))


def _means(df: DataFrame, cluster: str, column: str) -> DataFrame:
    """(cluster, i, m, n) of the means, a row for each cluster and dimension."""
    cells = df.select(F.col(cluster).alias("c"), F.posexplode(F.col(column).cast("array<double>")).alias("i", "v"))
    return cells.groupBy("c", "i").agg(F.avg("v").alias("m"), F.count("*").alias("n"))


def davies_bouldin(df: DataFrame, cluster: str = "cluster_id", column: str = "features") -> DataFrame:
    """The mean over clusters of the worst (s_i + s_j) / d_ij around label means, in a row; null for one cluster.

    Pairs of clusters come from the k-row table of means only.
    """
    spread = with_centroid_distance(df, cluster, column, "_d").groupBy(F.col(cluster).alias("c")).agg(F.avg("_d").alias("s"))
    means = _means(df, cluster, column)
    pairs = means.alias("a").join(means.alias("b"), F.expr("a.i = b.i and a.c <> b.c")).groupBy(F.col("a.c").alias("c"), F.col("b.c").alias("o")).agg(F.sqrt(F.sum(F.expr("(a.m - b.m) * (a.m - b.m)"))).alias("d"))
    both = pairs.join(F.broadcast(spread), "c").join(F.broadcast(spread.select(F.col("c").alias("o"), F.col("s").alias("t"))), "o")
    ratio = F.when(F.col("d") > 0, (F.col("s") + F.col("t")) / F.col("d")).otherwise(0.0)
    return both.groupBy("c").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, cluster: str = "cluster_id", column: str = "features") -> DataFrame:
    """Between over within dispersion, each by its degrees of freedom; 1 if nothing is within."""
    cells = df.select(F.col(cluster).alias("c"), F.posexplode(F.col(column).cast("array<double>")).alias("i", "v"))
    part = cells.groupBy("c", "i").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    whole = part.withColumn("g", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("i")) / F.sum("n").over(Window.partitionBy("i")))
    t = whole.agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("b"), F.sum(F.col("n") * F.col("var")).alias("w"), F.count_distinct("c").alias("k"), F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"))
    return t.select(F.when(F.col("w") == 0, 1.0).when((F.col("k") > 1) & (F.col("n") > F.col("k")), F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1))).alias("calinski_harabasz"))


def silhouette_rows(df: DataFrame, key: str, cluster: str = "cluster_id", column: str = "features", block: int = 256) -> DataFrame:
    """(key, cluster, silhouette) of a sample.

    The sample, of MOST_SAMPLE rows at most, is broadcast and each task compares its rows with it,
    block by block, so no pair is ever a row.
    """
    if df.limit(MOST_SAMPLE + 1).count() > MOST_SAMPLE:
        raise ValueError(f"silhouettes are of samples of at most {MOST_SAMPLE} rows")
    found = df.select(key, cluster, F.col(column).cast("array<double>").alias("x")).toArrow()
    points = np.array(found.column("x").to_pylist(), float)
    names, labels = np.unique(np.array(found.column(cluster).to_pylist()), return_inverse=True)
    held = df.sparkSession.sparkContext.broadcast((points, labels, np.bincount(labels), {n.item(): i for i, n in enumerate(names)}))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, labels, size, number = held.value
        member = np.eye(len(size))[labels]
        for batch in batches:
            out = []
            own = np.array([number[c] for c in batch.column(cluster).to_pylist()])
            x = np.array(batch.column("x").to_pylist(), float)
            for lo in range(0, len(x), block):
                a, c = x[lo : lo + block], own[lo : lo + block]
                square = (a * a).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * a @ points.T
                total = np.sqrt(np.maximum(square, 0)) @ member
                rows = np.arange(len(a))
                inside = total[rows, c] / np.maximum(size[c] - 1, 1)
                mean = total / size
                mean[rows, c] = np.inf
                near = mean.min(1)
                worst = np.maximum(inside, near)
                out.append(np.where((size[c] > 1) & (worst > 0), (near - inside) / np.where(worst > 0, worst, 1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(cluster), pa.array(np.concatenate(out) if out else np.zeros(0))], [key, cluster, "silhouette"])

    return df.select(key, cluster, F.col(column).cast("array<double>").alias("x")).mapInArrow(run, f"{key} {kinds[key]}, {cluster} {kinds[cluster]}, silhouette double")


def silhouette(df: DataFrame, key: str, most: int, seed: int = 42, cluster: str = "cluster_id", column: str = "features") -> tuple[float | None, str | None]:
    """The mean over a seeded sample of at most so many rows, or None and why."""
    sample = df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most).select(key, cluster, column)
    k, n = sample.agg(F.count_distinct(cluster), F.count("*")).first()
    if not 1 < k < n:
        return None, "the sample has too few distinct clusters"
    return silhouette_rows(sample, key, cluster, column).agg(F.avg("silhouette")).first()[0], None


def internal(df: DataFrame, key: str, sample: int, seed: int = 42) -> dict:
    """All internal metrics, with reasons where one is undefined."""
    k, n = df.agg(F.count_distinct("cluster_id"), F.count("*")).first()
    value, why = silhouette(df, key, sample, seed)
    out = {"silhouette": value, "undefined_reasons": {"silhouette": why} if why else {}} | inertia(df).first().asDict()
    ok = 1 < k < n
    for name, metric in (("davies_bouldin", davies_bouldin), ("calinski_harabasz", calinski_harabasz)):
        out[name] = metric(df).first()[0] if ok else None
        if not ok:
            out["undefined_reasons"][name] = "too few distinct clusters"
    return out


# Against labels -------------------------------------------------------------------------------


def contingency(df: DataFrame, truth: str, cluster: str = "cluster_id") -> DataFrame:
    """(class, cluster, n); null is a value."""
    return df.groupBy(F.col(truth).cast("string").alias("class"), F.col(cluster).cast("string").alias("cluster")).agg(F.count("*").alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """mutual_info, entropies, V-measure and purity of a contingency table, in a row."""
    a, b = Window.partitionBy("class"), Window.partitionBy("cluster")
    everything = Window.partitionBy(F.lit(1))
    t = table.withColumn("a", F.sum("n").over(a)).withColumn("b", F.sum("n").over(b)).withColumn("t", F.sum("n").over(everything)).withColumn("best", F.max("n").over(b))
    p = F.col("n") / F.col("t")
    part = lambda size: -F.sum(p * F.log(F.col(size) / F.col("t")))
    sums = t.agg(F.sum(p * F.log(F.col("t") * F.col("n") / (F.col("a") * F.col("b")))).alias("mutual_info"), part("a").alias("class_entropy"), part("b").alias("cluster_entropy"), F.sum(F.col("best") * F.col("n") / F.col("b") / F.col("t")).alias("purity"))
    h = F.when(F.col("class_entropy") <= 0, 1.0).otherwise(F.col("mutual_info") / F.col("class_entropy"))
    c = F.when(F.col("cluster_entropy") <= 0, 1.0).otherwise(F.col("mutual_info") / F.col("cluster_entropy"))
    v = F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0)
    return sums.select("mutual_info", "class_entropy", "cluster_entropy", h.alias("homogeneity"), c.alias("completeness"), v.alias("v_measure"), "purity")


def matrix(table: DataFrame) -> np.ndarray:
    """The contingency table as an array; classes times clusters numbers go to the driver."""
    return table.toPandas().pivot_table("n", "class", "cluster", fill_value=0, dropna=False).to_numpy(float) if not table.isEmpty() else np.zeros((0, 0))


def expected_mutual_info(n: np.ndarray) -> float:
    """Under the hypergeometric model, cell by cell, with exact log factorials by cumulated logs."""
    total = int(n.sum())
    if not total:
        return 0.0
    rows, cols = n.sum(1).astype(int), n.sum(0).astype(int)
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, total + 1)))])
    out = 0.0
    for a in rows[rows > 0].tolist():
        for b in cols[cols > 0].tolist():
            k = np.arange(max(1, a + b - total), min(a, b) + 1)
            weight = lf[a] + lf[b] + lf[total - a] + lf[total - b] - lf[total] - lf[k] - lf[a - k] - lf[b - k] - lf[total - a - b + k]
            out += float((k / total * (np.log(total * k) - np.log(a) - np.log(b)) * np.exp(weight)).sum())
    return out


def adjusted_mutual_info(n: np.ndarray) -> float:
    """With the arithmetic mean of the entropies; 1 for two trivial partitions."""
    n = n[n.sum(1) > 0][:, n.sum(0) > 0]
    if n.size == 0 or n.shape == (1, 1):
        return 1.0
    total = n.sum()
    entropy = lambda s: float(-(s / total * np.log(s / total)).sum())
    a, b, hit = n.sum(1), n.sum(0), n > 0
    mi = float((n[hit] / total * np.log((total * n / np.outer(a, b))[hit])).sum())
    emi = expected_mutual_info(n)
    below = (entropy(a) + entropy(b)) / 2 - emi
    below = min(below, -np.finfo(float).eps) if below < 0 else max(below, np.finfo(float).eps)
    return (mi - emi) / below


def ami(df: DataFrame, truth: str, cluster: str = "cluster_id") -> float:
    return adjusted_mutual_info(matrix(contingency(df, truth, cluster)))


def external(df: DataFrame, truths: Iterable[str]) -> dict:
    out = {}
    for t in truths:
        table = contingency(df, t)
        row = agreement(table).first()
        out[t] = {"ami": adjusted_mutual_info(matrix(table)), "v_measure": row.v_measure, "purity": row.purity}
    return out


def stability(assignments: dict[int, DataFrame], key: str) -> dict:
    """AMI of each pair of seeds over the same rows."""
    pairs = []
    for a, b in combinations(sorted(assignments), 2):
        x, y = (assignments[s].select(key, F.col("cluster_id").alias(n)) for s, n in ((a, "x"), (b, "y")))
        both = x.join(y, key, "full_outer")
        if not both.filter("x is null or y is null").isEmpty():
            raise ValueError("the assignments cover different rows")
        pairs.append({"seed_a": a, "seed_b": b, "ami": ami(both, "x", "y")})
    values = [p["ami"] for p in pairs]
    return {"pairs": pairs, "mean_pairwise_stability_ami": float(np.mean(values)), "min_pairwise_stability_ami": min(values), "max_pairwise_stability_ami": max(values)}


# Concentration --------------------------------------------------------------------------------


def concentration(counts: DataFrame) -> DataFrame:
    """Statistics of a table (cluster, count) that includes empty clusters, in a row."""
    order = Window.orderBy(F.col("count").desc())
    t = counts.withColumn("r", F.row_number().over(order)).withColumn("n", F.sum("count").over(Window.partitionBy(F.lit(1))))
    p = F.col("count") / F.col("n")
    entropy = F.coalesce(-F.sum(F.when(F.col("count") > 0, p * F.log(p))), F.lit(0.0))
    top = lambda k: F.sum(F.when(F.col("r") <= k, p).otherwise(0.0))
    small = [x for s in (10, 100, 1000) for x in (F.count_if(F.col("count") < s).alias(f"clusters_lt{s}"), F.avg((F.col("count") < s).cast("double")).alias(f"fraction_clusters_lt{s}"))]
    row = t.agg(F.max("n").alias("n"), F.count("*").alias("k"), F.count_if(F.col("count") > 0).alias("observed_clusters"), F.count_if(F.col("count") == 0).alias("empty_clusters"), F.min("count").alias("min_size"), F.max("count").alias("max_size"), F.avg("count").alias("mean_size"), F.percentile("count", F.lit(0.5)).alias("median_size"), F.stddev_pop("count").alias("std_size"), F.max(p).alias("max_cluster_fraction"), top(5).alias("top5_cluster_fraction"), top(10).alias("top10_cluster_fraction"), entropy.alias("entropy"), *small)
    return row.withColumn("normalized_entropy", F.col("entropy") / F.log("k")).withColumn("effective_number_of_clusters", F.exp("entropy")).withColumn("effective_clusters_ratio", F.exp("entropy") / F.col("k"))


# Flag, statistic, threshold, comparison, and the number of clusters beyond which it applies.
FLAGS = (
    ("dominant_cluster", "max_cluster_fraction", 0.9, "ge", 0),
    ("low_entropy", "normalized_entropy", 0.5, "lt", 0),
    ("low_effective_ratio", "effective_clusters_ratio", 0.25, "lt", 0),
    ("top5_concentration", "top5_cluster_fraction", 0.95, "ge", 5),
    ("top10_concentration", "top10_cluster_fraction", 0.99, "ge", 10),
    ("microclusters_lt10", "fraction_clusters_lt10", 0.5, "ge", 0),
    ("microclusters_lt100", "fraction_clusters_lt100", 0.5, "ge", 0),
    ("microclusters_lt1000", "fraction_clusters_lt1000", 0.5, "ge", 0),
)


def degeneracy(stats: DataFrame, flags: Iterable[tuple[str, str, float, str, int]] = FLAGS) -> DataFrame:
    """(flag, value, threshold, state): triggered, clear or not_applicable."""
    def state(name: str, limit: float, op: str, beyond: int) -> Column:
        hit = F.col(name) >= limit if op == "ge" else F.col(name) < limit
        return F.when(F.col("k") <= beyond, "not_applicable").when(hit, "triggered").otherwise("clear")

    rows = [F.struct(F.lit(f).alias("flag"), F.col(name).alias("value"), F.lit(limit).alias("threshold"), state(name, limit, op, beyond).alias("state")) for f, name, limit, op, beyond in flags]
    return stats.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


