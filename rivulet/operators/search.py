"""Grid search over representations, cluster numbers and seeds; stability, Pareto, sealed decisions."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.digests import digest, file_digest
from rivulet.operators import cluster, clustermetrics
from rivulet.sources.sinks import create_json, plain, read_json, write_json

#: Metric and the sign that makes larger better.
OBJECTIVES = (("mean_silhouette", 1), ("mean_davies_bouldin", -1), ("mean_calinski_harabasz", 1), ("min_pairwise_stability_ami", 1), ("worst_max_cluster_fraction", -1))


def grid(representations: Iterable[str], ks: Iterable[int], seeds: Iterable[int]) -> list[tuple[str, int, int]]:
    return list(itertools.product(representations, ks, seeds))


def run_id(representation: str, k: int, seed: int) -> str:
    return f"{representation}_k{k}_s{seed}"


def pareto_front(rows: DataFrame, objectives: Iterable[tuple[str, int]] = OBJECTIVES) -> DataFrame:
    """The configurations that no other beats: none is as good in all and better in one; ties stay.

    The table has a row for each configuration, and no other columns than its name and the metrics.
    """
    names = [n for n, _ in objectives]
    if set(rows.columns) != {"configuration", *names}:
        raise ValueError("pareto_front takes the configuration and the registered metrics only")
    if not rows.filter(" or ".join(f"{n} is null or isnan({n}) or abs({n}) = double('inf')" for n in names)).isEmpty():
        raise ValueError("metrics must be finite")
    a, b = rows.alias("a"), rows.alias("b")
    good = lambda n, s, strict: (F.col(f"b.{n}") * s > F.col(f"a.{n}") * s) if strict else (F.col(f"b.{n}") * s >= F.col(f"a.{n}") * s)
    every, some = F.lit(True), F.lit(False)
    for n, s in objectives:
        every, some = every & good(n, s, False), some | good(n, s, True)
    return a.join(b, every & some, "left_anti")


def aggregate(runs: DataFrame, metrics: Iterable[str], by: Iterable[str] = ("representation", "k")) -> DataFrame:
    """mean, min, max and sample deviation of each metric over the seeds, and the worst concentration."""
    out = [f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))]
    return runs.groupBy(*by).agg(*out, F.max("max_cluster_fraction").alias("worst_max_cluster_fraction"), F.count_if(F.col("flagged")).alias("flagged_seeds"), F.count("*").alias("seeds"))


def against_base(table: DataFrame, base: str, metrics: Iterable[str]) -> DataFrame:
    """Each representation's difference from the base at the same k."""
    ref = table.filter(F.col("representation") == base).select("k", *(F.col(m).alias(f"_{m}") for m in metrics))
    return table.filter(F.col("representation") != base).join(F.broadcast(ref), "k").select("representation", "k", *((F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in metrics))


def seal(record: dict) -> dict:
    """The record with its own digest."""
    record = plain(record)
    return record | {"digest": digest({k: v for k, v in record.items() if k != "digest"})}


def unseal(record: dict) -> dict:
    """The record, if its digest holds."""
    if record.get("digest") != digest({k: v for k, v in record.items() if k != "digest"}):
        raise ValueError("the record was changed after it was sealed")
    return record


def artifact(path: str | Path) -> dict:
    found = file_digest(path)
    return {"path": str(path), "bytes": found["bytes"], "sha256": found["sha256"]}


def execute(df: DataFrame, key: str, representation: str, k: int, seed: int, root: str | Path, max_iter: int = 100, sample: int = 20_000, retry_invalid: bool = False) -> tuple[dict, DataFrame]:
    """One run: fit, metrics, sealed record.  A valid record is read again instead of run."""
    path = Path(root) / "runs" / f"{run_id(representation, k, seed)}.json"
    centers = None
    if path.exists():
        record = unseal(read_json(path))
        if record["status"] == "VALID" or not retry_invalid:
            centers = record.get("centers")
    if centers is None:
        try:
            import numpy as np

            centers = cluster.fit_kmeans(df, k, seed, max_iter).tolist()
            rows = cluster.assign(df, np.array(centers)).cache()
            counts = cluster.checked_counts(rows, k)
            stats = clustermetrics.concentration(cluster.sizes(rows, k)).first().asDict()
            record = {"status": "VALID", "centers": centers, "counts": counts.tolist(), "metrics": clustermetrics.internal(rows, key, sample, seed), "concentration": stats}
            rows.unpersist()
        except ValueError as e:
            record = {"status": "INVALID", "reason": str(e)}
        record = seal({"representation": representation, "k": k, "seed": seed} | record)
        if path.exists():
            path.rename(path.with_suffix(".previous.json"))
        write_json(path, record)
    import numpy as np

    rows = cluster.assign(df, np.array(record["centers"])) if record.get("centers") else df.limit(0)
    return record, rows


def stage(frames: dict[str, DataFrame], key: str, ks: Iterable[int], seeds: Iterable[int], root: str | Path, sample: int = 20_000, retry_invalid: bool = False) -> DataFrame:
    """All runs of a grid, resumable, invalid ones only run again if asked; a table with a row for each configuration."""
    ks, seeds, rows = list(ks), list(seeds), []
    spark = next(iter(frames.values())).sparkSession
    for name, frame in frames.items():
        for k in ks:
            done = {s: execute(frame, key, name, k, s, root, sample=sample, retry_invalid=retry_invalid) for s in seeds}
            if any(r["status"] != "VALID" for r, _ in done.values()):
                continue
            steady = clustermetrics.stability({s: a for s, (_, a) in done.items()}, key)
            metric = lambda m: [r["metrics"][m] for r, _ in done.values()]  # noqa: E731, B023
            if any(v is None for m in ("silhouette", "davies_bouldin", "calinski_harabasz") for v in metric(m)):
                continue
            mean = lambda m: float(sum(metric(m)) / len(seeds))  # noqa: E731, B023
            rows.append((f"{name}_k{k}", mean("silhouette"), mean("davies_bouldin"), mean("calinski_harabasz"), steady["min_pairwise_stability_ami"], max(r["concentration"]["max_cluster_fraction"] for r, _ in done.values())))
    return spark.createDataFrame(rows, "configuration string, " + ", ".join(f"{n} double" for n, _ in OBJECTIVES))


def decide(root: str | Path, name: str, front: Iterable[str], chosen: list[str], approved_by: str, rationale: str, previous: dict | None = None) -> dict:
    """Freeze one to three configurations of the front, once; a later stage can't add any."""
    if not 1 <= len(chosen) <= 3 or len(set(chosen)) < len(chosen) or not set(chosen) <= set(front):
        raise ValueError("choose one to three configurations of the front")
    if not approved_by.strip() or not rationale.strip():
        raise ValueError("a decision needs a name and a reason")
    if previous is not None and not set(chosen) <= set(unseal(previous)["configurations"]):
        raise ValueError("a later stage can't add configurations")
    record = seal({"stage": name, "configurations": chosen, "approved_by": approved_by, "rationale": rationale, "external_metrics_used": False, "previous_decision_digest": previous["digest"] if previous else None})
    create_json(Path(root) / f"decision_{name}.json", record)
    return record


def verified(root: str | Path, names: Iterable[str] = ("A", "B")) -> list[dict]:
    """The chain of decisions, each sealed and bound to the one before."""
    out: list[dict] = []
    for name in names:
        record = unseal(read_json(Path(root) / f"decision_{name}.json"))
        if record["previous_decision_digest"] != (out[-1]["digest"] if out else None):
            raise ValueError("a previous decision was changed")
        out.append(record)
    return out


def external(df: DataFrame, truths: Iterable[str], root: str | Path) -> dict:
    """Label metrics of an assigned table by split; only after both decisions."""
    verified(root)
    return {s: clustermetrics.external(df.filter(F.col("split") == s), truths) for s in ("train", "val", "test")}


def markdown(rows: DataFrame) -> str:
    names = rows.columns
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows.collect())]) + "\n"
