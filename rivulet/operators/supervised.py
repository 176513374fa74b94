"""Random forests for one or several targets."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.config import Config
from rivulet.operators import classmetrics as M
from rivulet.sources.sinks import write_csv, write_json

MOST_CLASSES = 10_000


@dataclass
class Forest:
    """A fitted forest and its classes, sorted, seen in training."""

    classes: list[str]
    model: RandomForestClassificationModel | None

    def predict(self, df: DataFrame, column: str = "features") -> DataFrame:
        """df with predicted and probability; partitions are predicted as they come."""
        names = F.array(*map(F.lit, self.classes))
        if self.model is None:  # one class
            return df.withColumn("predicted", F.lit(self.classes[0])).withColumn("probability", F.array(F.lit(1.0)))
        rows = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
        out = self.model.transform(rows)
        return out.withColumn("predicted", F.element_at(names, F.col("_pred").cast("int") + 1)).withColumn("probability", vector_to_array("_prob")).drop("_v", "_pred", "_prob", "_raw")


def fit(train: DataFrame, target: str, cfg: Config, column: str = "features") -> Forest:
    """cpu semantics weigh rows by N / (C n_c); gpu semantics don't, and use 128 bins."""
    counts = {r.c: r.n for r in train.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("c")).agg(F.count("*").alias("n")).limit(MOST_CLASSES + 1).collect()}
    classes = sorted(counts)
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"{target} has more than {MOST_CLASSES} classes")
    if not classes:
        raise ValueError(f"no training rows with {target}")
    if len(classes) == 1:
        return Forest(classes, None)
    total, cpu = sum(counts.values()), cfg.semantics == "cpu"
    number = F.create_map(*(F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))))
    weight = F.create_map(*(F.lit(x) for c in classes for x in (c, total / (len(classes) * counts[c]) if cpu else 1.0)))
    key = F.col(target).cast("string")
    rows = train.filter(F.col(target).isNotNull()).select(array_to_vector(F.col(column).cast("array<double>")).alias("_v"), F.element_at(number, key).alias("_y"), F.element_at(weight, key).alias("_w"))
    forest = RandomForestClassifier(featuresCol="_v", labelCol="_y", weightCol="_w", predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw", numTrees=cfg.random_forest_estimators, maxDepth=min(30, cfg.random_forest_max_depth), maxBins=32 if cpu else 128, featureSubsetStrategy="sqrt", seed=cfg.random_state)
    return Forest(classes, forest.fit(rows))


def evaluate(forest: Forest, df: DataFrame, target: str, small: int = 30) -> dict:
    """All metrics over rows with a known target."""
    scored = forest.predict(df.filter(F.col(target).isNotNull())).cache()
    try:
        table = M.confusion(scored, target, "predicted")
        out = M.summary(table).first().asDict() | M.support_report(table, forest.classes, small)
        positive = M.positive_label(forest.classes)
        score = F.element_at("probability", forest.classes.index(positive) + 1)
        return out | M.binary(scored.withColumn("_score", score), target, "_score", forest.classes)
    finally:
        scored.unpersist()


def run(assigned: DataFrame, targets: tuple[str, ...], cfg: Config, out: str | Path | None = None, train: DataFrame | None = None) -> dict:
    """Fit on training rows (or on representatives), evaluate on val and test, write artifacts."""
    found = {}
    for target in targets:
        forest = fit(assigned.filter("split = 'train'") if train is None else train, target, cfg)
        found[target] = {s: evaluate(forest, assigned.filter(F.col("split") == s), target, cfg.small_support) for s in ("val", "test")} | {"classes": forest.classes}
        if out:
            root = Path(out)
            table = M.confusion(forest.predict(assigned.filter("split = 'test'")), target, "predicted").cache()
            for suffix in (f"_{target}", *([""] if target == "label" else [])):
                (root / "artifacts").mkdir(parents=True, exist_ok=True)
                (root / f"classification_report{suffix}.txt").write_text(M.report_text(table), encoding="utf-8")
                write_csv(M.confusion_matrix(table), str(root / f"confusion_matrix{suffix}.csv"))
                if forest.model:
                    forest.model.write().overwrite().save(str(root / "artifacts" / f"random_forest{suffix}"))
            table.unpersist()
    if out:
        write_json(Path(out) / "metrics_supervised.json", found)
    return found
