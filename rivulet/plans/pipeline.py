"""Whole experiments: load, select features, split, preprocess, cluster, pick representatives, classify."""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.config import Config
from rivulet.contract import recognised
from rivulet.functions.digests import digest, file_digest
from rivulet.operators import cluster, clustermetrics, features, normalize, prep, quality, reduce, representatives, splits, supervised
from rivulet.sources import readers, sinks

STAGES = ("prepare", "cluster", "representatives", "supervised", "all")
KEY = "elig_pos"


@dataclass
class Profiler:
    """Wall seconds and resident memory by stage."""

    rows: list[dict] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            pages = int(Path("/proc/self/statm").read_text().split()[1]) if Path("/proc/self/statm").exists() else 0
            self.rows.append({"stage": name, "seconds": time.perf_counter() - began, "driver_rss_mb": pages * os.sysconf("SC_PAGE_SIZE") / 1e6})

    def report(self) -> dict:
        return {"stages": self.rows, "total_seconds": sum(r["seconds"] for r in self.rows)}


def fingerprints(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each source, on whatever store it lies."""
    return {name: file_digest(uri, spark)["sha256"] for uri, name in readers.resolve(spark, path)}


def load(spark: SparkSession, cfg: Config, path: str | None, out: Path | None = None, sample: int | None = None) -> tuple[DataFrame, str | None]:
    """The eligible, normalised table with places orig_pos and elig_pos, and its population id."""
    if path is None or path.startswith("synthetic://"):
        n = int(path.removeprefix("synthetic://")) if path else cfg.synthetic_n
        table = readers.number_rows(readers.synthetic(spark, n, cfg.random_state), "orig_pos")
        return table.withColumn(KEY, F.col("orig_pos")), None
    raw = readers.load_raw(spark, path)
    if not recognised(raw.columns):
        table = readers.with_position(raw)
        kept, population = table.withColumn(KEY, F.col("orig_pos")), None
    else:
        found = quality.report(raw, fingerprints(spark, path))
        population = found["population_id"]
        if out:
            quality.save(found, out / "data_quality_report.json")
        eligible = quality.eligible(readers.with_position(raw))
        clean, _ = normalize.normalize(eligible, out / "schema_normalization_report.json" if out else None, "orig_pos")
        kept = readers.with_eligible_position(clean)
    if sample:
        kept = readers.with_eligible_position(readers.sample(kept, sample, cfg.random_state, "orig_pos").drop(KEY))
    return kept.drop(readers.FILE_NO, readers.SOURCE_ID, readers.FILE_ROW), population


def run(spark: SparkSession, cfg: Config, out: str | Path, path: str | None = None, stage: str = "all") -> dict:
    """Run the stages up to the one named; artifacts go to out, a summary is returned.

    Fits see training rows only.  The feature guard runs before every fit.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    out, clock = Path(out), Profiler()
    sinks.write_json(out / "config_resolved.json", cfg.as_dict())
    with clock.stage("load"):
        table, population = load(spark, cfg, path, out)
        table = table.cache()
        sinks.write_json(out / "dataset_info.json", {"dataset": cfg.dataset_name, "rows": table.count(), "columns": table.columns, "population_id": population})
    with clock.stage("features"):
        names = features.select(table, cfg.feature_policy, cfg.label_col, cfg.type_col, cfg.targets)
        names = [c for c in names if c not in ("orig_pos", KEY)]
        table, names = features.time_features(table, names, cfg.timestamp_col, cfg.timestamp_policy, cfg.timestamp_unit)
        names = features.service_features(names, cfg.service_policy)
        guard = lambda where: features.guard(names, cfg.feature_policy, cfg.label_col, cfg.type_col, where, out / "forbidden_columns_check.json")
        guard("features")
        sinks.write_json(out / "selected_features.json", features.metadata(cfg.feature_policy, names))
    with clock.stage("split"):
        try:
            assigned, search = splits.make(table, cfg, KEY)
        except splits.SplitError as e:
            sinks.write_json(out / "split_failure_diagnostics.json", e.diagnostics)
            raise
        assigned = assigned.cache()
        manifest = splits.manifest(assigned, cfg, KEY, population, search)
        freeze(assigned, manifest, out, cfg)
        if not manifest["validation_ok"]:
            raise splits.SplitError("the split is not valid", manifest)
    summary = {"population_id": population, "split_hash": manifest["split_hash"], "counts": manifest["counts"]}
    if stage == "prepare":
        return _done(summary, clock, out)
    with clock.stage("preprocess"):
        guard("preprocessing")
        ready, fitted = preprocess(assigned, names, cfg)
        ready = ready.cache()
        sinks.write_json(out / "artifacts" / "preprocessing_metadata.json", fitted)
    with clock.stage("cluster"):
        guard("clustering")
        train = ready.filter("split = 'train'")
        centers = cluster.best_of(train, cfg.selected_k, cfg.cluster_n_init, cfg.random_state, cfg.cluster_max_iter)
        ready = cluster.assign(ready, centers).cache()
        metrics = {"internal": clustermetrics.internal(ready.filter("split = 'train'"), KEY, cfg.silhouette_sample_size, cfg.random_state)}
        metrics["external"] = {s: clustermetrics.external(ready.filter(F.col("split") == s), [t for t in (cfg.label_col, cfg.type_col) if t in ready.columns]) for s in splits.NAMES}
        sinks.write_json(out / "metrics_clustering.json", metrics)
        sinks.write_json(out / "artifacts" / "kmeans.json", {"centers": centers})
        if cfg.export_cluster_assignments:
            sinks.write_csv(cluster.export(ready, KEY), str(out / "cluster_assignments.csv"))
    summary["clustering"] = metrics["internal"]
    if stage == "cluster":
        return _done(summary, clock, out)
    with clock.stage("representatives"):
        train = ready.filter("split = 'train'")
        chosen = representatives.select(train, KEY, cfg)
        info = representatives.metadata(train, chosen, cfg)
        sinks.write_json(out / "representatives_metadata.json", info)
        sinks.write_csv(representatives.summary(train, chosen) if cfg.representative_strategy != "centroid" else chosen.select("cluster_id", "weight"), str(out / "representatives_cluster_summary.csv"))
        if cfg.representative_strategy not in ("full", "centroid"):
            sinks.write_csv(chosen.select(KEY, "cluster_id"), str(out / "representatives_indices.csv"))
    summary["representatives"] = info
    if stage == "representatives":
        return _done(summary, clock, out)
    with clock.stage("supervised"):
        guard("supervised")
        reduced = chosen.withColumnRenamed("centroid", "features") if cfg.representative_strategy == "centroid" else chosen
        summary["supervised"] = supervised.run(ready, cfg.targets, cfg, out, reduced if cfg.use_representatives_for_supervised else None)
    return _done(summary, clock, out)


def preprocess(assigned: DataFrame, names: list[str], cfg: Config) -> tuple[DataFrame, dict]:
    """log1p, then statistics of training rows, then the optional projection; column ``features``."""
    numeric, nominal = normalize.feature_kinds(assigned, names, cfg.feature_policy == "behavioral_strict")
    numeric_types = {f.name: f.dataType.simpleString() for f in assigned.schema}
    timed = [c for c in numeric if numeric_types[c].startswith("timestamp")] + [c for c in nominal if numeric_types[c].startswith("timestamp")]
    assigned = assigned.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") / 1e6 for c in timed}) if timed else assigned
    numeric, nominal = [*numeric, *(c for c in timed if c not in numeric)], [c for c in nominal if c not in timed]
    logged = normalize.log_columns(numeric, cfg.log1p_columns) if cfg.log1p_numeric else []
    assigned = normalize.apply_log1p(assigned, logged)
    train = assigned.filter("split = 'train'")
    fitted = prep.fit(train, numeric, nominal, cfg)
    ready = fitted.transform(assigned)
    info = fitted.describe() | {"log1p": logged, "fit_split": "train"}
    found = reduce.svd(ready.filter("split = 'train'"), cfg.svd_components)
    if found is not None:
        ready = found.transform(ready, "features", "features")
        info |= {"svd_components": len(found.components), "singular_values": found.singular}
    return ready, info | {"frozen": fitted.to_dict()}


def freeze(assigned: DataFrame, manifest: dict, out: Path, cfg: Config) -> None:
    """Write the assignment and, last, its manifest; FileExistsError if there is one."""
    path = out / "splits"
    if (out / "split_manifest.json").exists():
        raise FileExistsError(out / "split_manifest.json")
    sinks.write_table(assigned.select(KEY, "split"), str(path / "assignment"))
    for target in {cfg.label_col, cfg.type_col} & set(assigned.columns):
        sinks.write_csv(splits.distribution(assigned, target), str(out / f"target_distribution_{target}.csv"))
    if cfg.extra.get("split_export_npy", False):
        sinks.export_indices(assigned, path, KEY)
    sinks.write_json(out / "split_summary.json", {"counts": manifest["counts"], "proportions": manifest["proportions"]})
    sinks.create_json(out / "split_manifest.json", manifest)


def reload(spark: SparkSession, table: DataFrame, cfg: Config, out: str | Path, population: str | None = None) -> DataFrame:
    """A frozen split joined back; ValueError if population, order or parameters changed."""
    saved = sinks.read_json(Path(out) / "split_manifest.json")
    if not saved["validation_ok"]:
        raise ValueError("the frozen split was not valid")
    assigned = table.join(spark.read.parquet(str(Path(out) / "splits" / "assignment")), KEY)
    if splits.manifest(assigned, cfg, KEY, population)["split_hash"] != saved["split_hash"]:
        raise ValueError("the frozen split doesn't belong to this table and configuration")
    return assigned


def describe(spark: SparkSession, table: DataFrame, out: str | Path, targets: list[str]) -> dict[str, list[dict]]:
    """Class shares of a frozen split."""
    assigned = table.join(spark.read.parquet(str(Path(out) / "splits" / "assignment")), KEY)
    return {t: [r.asDict() for r in splits.distribution(assigned, t).orderBy("split", "class").collect()] for t in targets}


def audit_protocols(table: DataFrame, configs: dict[str, Config]) -> dict[str, dict]:
    """Every protocol on the same rows: its manifest, or why it failed."""
    out = {}
    for name, cfg in configs.items():
        try:
            assigned, found = splits.make(table, cfg, KEY)
            out[name] = splits.manifest(assigned, cfg, KEY, search=found)
        except ValueError as e:
            out[name] = {"validation_ok": False, "error": str(e), "diagnostics": getattr(e, "diagnostics", None)}
    return out


def checkpoint(manifest: dict, expected: dict) -> dict[str, bool]:
    """Named checks of a manifest against a frozen one; all must hold before it is used."""
    goals = manifest["parameters"]
    same = lambda k: manifest.get(k) == expected.get(k)
    checks = {k: same(k) for k in ("protocol_version", "scientific_question", "population", "parameters", "seed", "counts", "proportions", "index_hashes", "distributions", "group_overlap", "split_hash")}
    checks["rows_partitioned"] = manifest["row_validation"]["ok"]
    checks["no_split_empty"] = all(manifest["counts"].values())
    checks["groups_disjoint"] = manifest["group_overlap"] is None or not any(v for k, v in manifest["group_overlap"].items() if k.endswith("_overlap")) or not goals["group_cols"]
    checks["validation_ok"] = manifest["validation_ok"] and expected["validation_ok"]
    return checks


def freeze_after_agreement(first: dict, second: dict, path: str | Path) -> Path:
    """Write a manifest once, if two independent runs agree in every check."""
    failed = [k for k, ok in checkpoint(sinks.plain(first), sinks.plain(second)).items() if not ok]
    if failed:
        raise ValueError(f"the runs disagree in {', '.join(failed)}")
    return sinks.create_json(path, first)


def checkpoint_markdown(manifest: dict) -> str:
    """A short review page of a split manifest."""
    lines = [f"# {manifest['protocol_version']}", "", manifest["scientific_question"], "", "| split | rows | share |", "|---|---|---|"]
    lines += [f"| {s} | {manifest['counts'][s]} | {manifest['proportions'][s]:.4f} |" for s in splits.NAMES]
    for target, found in manifest["distributions"].items():
        lines += ["", f"## {target}", "", "| class | " + " | ".join(splits.NAMES) + " |", "|---|---|---|---|"]
        lines += [f"| {c} | " + " | ".join(str(found["splits"][s]["counts"][c]) for s in splits.NAMES) + " |" for c in found["splits"]["train"]["counts"]]
    return "\n".join([*lines, "", f"valid: {manifest['validation_ok']}", f"hash: {manifest['split_hash']}", ""])


def provenance(root: str | Path, files: list[str]) -> dict:
    """The commit, whether the tree is clean, and digests of source files."""
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], capture_output=True, text=True).stdout.strip()
    record = {"commit": git("rev-parse", "HEAD") or None, "dirty": bool(git("status", "--porcelain")), "files": {f: file_digest(Path(root) / f)["sha256"] for f in files}}
    return record | {"digest": digest(record)}


def inventory(out: str | Path, required: list[str]) -> dict:
    """Sizes and digests of the artifacts, and which required ones are missing."""
    out = Path(out)
    found = {str(p.relative_to(out)): {k: v for k, v in file_digest(p).items() if k != "mtime_ns"} for p in sorted(out.rglob("*")) if p.is_file() and not p.name.startswith(".")}
    missing = [r for r in required if not any(f == r or f.startswith(r + "/") for f in found)]
    return {"artifacts": found, "missing": missing, "ok": not missing}


def collect_summaries(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One row per experiment, target and split from metrics_supervised.json."""
    rows = []
    for root in roots:
        path = Path(root) / "metrics_supervised.json"
        for target, by in (sinks.read_json(path) if path.exists() else {}).items():
            rows += [(str(root), target, s, by[s].get("accuracy"), by[s].get("macro_f1"), by[s].get("weighted_f1"), by[s].get("roc_auc"), by[s].get("average_precision")) for s in ("val", "test")]
    return spark.createDataFrame(rows, "experiment string, target string, split string, accuracy double, macro_f1 double, weighted_f1 double, roc_auc double, average_precision double")


def experiment(spark: SparkSession, cfg: Config, out: str | Path, path: str | None = None, required: list[str] | None = None) -> dict:
    """run() with a manifest that is RUNNING and then APPROVED or INVALID; an existing output is refused."""
    out = Path(out)
    if out.exists() and any(out.iterdir()):
        raise FileExistsError(out)
    record = {"status": "RUNNING", "config_digest": digest(sinks.plain(cfg.as_dict()))}
    sinks.write_json(out / "experiment_manifest.json", record)
    try:
        record["summary"] = run(spark, cfg, out, path)
        record["inventory"] = inventory(out, required or ["metrics_supervised.json", "metrics_clustering.json", "split_manifest.json"])
        record["status"] = "APPROVED" if record["inventory"]["ok"] else "INVALID"
    except Exception as e:
        record |= {"status": "INVALID", "error": f"{type(e).__name__}: {e}"}
        raise
    finally:
        sinks.write_json(out / "experiment_manifest.json", record)
    return record


def _done(summary: dict, clock: Profiler, out: Path) -> dict:
    summary["profile"] = clock.report()
    sinks.write_json(out / "profile.json", summary["profile"])
    return summary
