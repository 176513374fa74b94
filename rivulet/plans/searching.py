"""The search's prepare stage, and the grid on what it prepared.

A prepared folder binds the search to a parent experiment: its frozen split and preprocessing are
verified and replayed without any fit, projections are fitted on all training rows, and only the
development sample of them is kept, once for each representation.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.config import Config
from rivulet.functions.digests import digest
from rivulet.operators import features, normalize, prep, reduce, search
from rivulet.plans import pipeline
from rivulet.sources import sinks

BASE = "base"


def replayed(spark: SparkSession, cfg: Config, parent: str | Path, path: str | None = None) -> tuple[DataFrame, dict]:
    """The parent's rows with split and features, and what they are bound to.

    ValueError if the table, the split's parameters or the frozen preprocessing don't fit.
    """
    parent = Path(parent)
    table, population = pipeline.load(spark, cfg, path)
    names = [c for c in features.select(table, cfg.feature_policy, cfg.label_col, cfg.type_col, cfg.targets) if c not in ("orig_pos", pipeline.KEY)]
    table, names = features.time_features(table, names, cfg.timestamp_col, cfg.timestamp_policy, cfg.timestamp_unit)
    assigned = pipeline.reload(spark, table, cfg, parent, population)
    info = sinks.read_json(parent / "artifacts" / "preprocessing_metadata.json")
    fitted = prep.Prep.from_dict(info["frozen"])
    own = set(features.service_features(names, cfg.service_policy))
    if lost := [c for c in (*fitted.numeric, *fitted.nominal) if c not in own]:
        raise ValueError(f"the frozen preprocessing needs features that the policy doesn't give: {lost}")
    features.guard(names, cfg.feature_policy, cfg.label_col, cfg.type_col, "search")
    ready = fitted.transform(normalize.apply_log1p(assigned, info["log1p"]))
    bound = {"population_id": population, "split_hash": sinks.read_json(parent / "split_manifest.json")["split_hash"], "preprocessing_digest": digest(info["frozen"])}
    return ready, bound


def prepare(spark: SparkSession, cfg: Config, parent: str | Path, out: str | Path, path: str | None = None, sample: int = 20_000, components: Iterable[int] = (5, 10, 20)) -> dict:
    """Write the development sample in every representation and a sealed manifest; returns the manifest.

    The sample is taken from the training rows by hash; projections see all training rows.  An
    existing manifest is refused.
    """
    out = Path(out)
    ready, bound = replayed(spark, cfg, parent, path)
    train = ready.filter("split = 'train'").select(pipeline.KEY, "features").cache()
    try:
        rows = train.orderBy(F.xxhash64(F.lit(cfg.random_state), pipeline.KEY), pipeline.KEY).limit(sample)
        sinks.write_table(rows, str(out / "representations" / BASE))
        found = {BASE: {"dimensions": None, "singular_values": None}}
        for k in components:
            fitted = reduce.pca(train, k)
            if fitted is None:
                continue
            projected = fitted.transform(rows, "features", "reduced").select(pipeline.KEY, F.col("reduced").alias("features"))
            sinks.write_table(projected, str(out / "representations" / f"pca{k}"))
            found[f"pca{k}"] = {"dimensions": len(fitted.components), "singular_values": fitted.singular.tolist()}
        record = search.seal(bound | {"seed": cfg.random_state, "sample_rows": rows.count(), "train_rows": train.count(), "representations": found})
    finally:
        train.unpersist()
    sinks.create_json(out / "prepare_manifest.json", record)
    return record


def run_grid(spark: SparkSession, out: str | Path, ks: Iterable[int], seeds: Iterable[int], sample: int = 20_000, retry_invalid: bool = False) -> DataFrame:
    """search.stage() over a prepared folder's representations; its Pareto front goes to a file."""
    out = Path(out)
    record = search.unseal(sinks.read_json(out / "prepare_manifest.json"))
    frames = {name: spark.read.parquet(str(out / "representations" / name)).cache() for name in record["representations"]}
    table = search.stage(frames, pipeline.KEY, ks, seeds, out, sample, retry_invalid)
    (out / "search_table.md").write_text(search.markdown(table), encoding="utf-8")
    front = [] if table.isEmpty() else [r.configuration for r in search.pareto_front(table).collect()]
    sinks.write_json(out / "pareto_front.json", {"prepare_digest": record["digest"], "configurations": sorted(front)})
    for frame in frames.values():
        frame.unpersist()
    return table


def against_history(table: DataFrame, history: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """(configuration, metric, now, before, delta) of configurations that an earlier search has too."""
    names = list(metrics)
    tall = lambda df, name: df.select("configuration", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in names))).alias("x")).select("configuration", "x.*")
    return tall(table, "now").join(tall(history, "before"), ["configuration", "metric"]).withColumn("delta", F.col("now") - F.col("before"))
