"""The search's prepare stage and the commands around it."""

import json

import pytest
import yaml

from rivulet import session
from rivulet.config import Config, load
from rivulet.operators import search
from rivulet.plans import cli, pipeline, searching
from rivulet.sources import sinks

VALUES = {"synthetic_n": 240, "feature_policy": "no_raw_ip_port", "selected_k": 2, "cluster_n_init": 1, "split_strategy": "random_stratified", "random_forest_estimators": 3, "random_forest_max_depth": 4, "svd_components": 0}


@pytest.fixture(scope="module")
def parent(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("search")
    (root / "c.yaml").write_text(yaml.safe_dump(VALUES))
    pipeline.run(spark, load(root / "c.yaml"), root / "parent", stage="cluster")
    return root


def test_prepare_replays_the_parent(spark, parent):
    cfg = load(parent / "c.yaml")
    record = searching.prepare(spark, cfg, parent / "parent", parent / "grid", sample=60, components=(2, 3))
    assert search.unseal(record)["sample_rows"] == 60 and set(record["representations"]) == {"base", "pca2", "pca3"}
    rows = spark.read.parquet(str(parent / "grid" / "representations" / "pca2"))
    assert rows.count() == 60 and len(rows.first().features) == 2
    split = spark.read.parquet(str(parent / "parent" / "splits" / "assignment")).filter("split = 'train'")
    assert rows.join(split, pipeline.KEY, "left_anti").isEmpty()
    with pytest.raises(FileExistsError):
        searching.prepare(spark, cfg, parent / "parent", parent / "grid", sample=60, components=())
    with pytest.raises(ValueError):
        searching.replayed(spark, Config(**{**VALUES, "test_size": 0.3}), parent / "parent")


def test_commands(spark, parent, monkeypatch, capsys):
    monkeypatch.setattr(session, "build", lambda *a, **b: spark)
    own = parent / "own"
    assert cli.main(["prepare-search", "--config", str(parent / "c.yaml"), "--parent", str(parent / "parent"), "--output-dir", str(own), "--sample", "50", "--components", "2"]) == 0
    assert cli.main(["search", "--output-dir", str(own), "--k", "2", "--seeds", "1", "2"]) == 0
    assert "pca2_k2" in capsys.readouterr().out and sinks.read_json(own / "pareto_front.json")["configurations"]
    manifest = str(parent / "parent" / "split_manifest.json")
    assert cli.main(["checkpoint", manifest, manifest, "--review", str(parent / "review.md")]) == 0 and "valid: True" in (parent / "review.md").read_text()
    other = parent / "other.json"
    other.write_text(json.dumps(sinks.read_json(manifest) | {"seed": 1}))
    assert cli.main(["checkpoint", manifest, str(other)]) == 1
    assert cli.main(["audit-splits", "--config", str(parent / "c.yaml"), "--output-dir", str(parent / "audit"), "--protocols", "random_stratified"]) == 0
    assert sinks.read_json(parent / "audit" / "split_audit_random_stratified.json")["validation_ok"]
    assert cli.main(["report", str(parent / "parent"), "--output", str(parent / "report")]) == 0


def test_history(spark):
    now, before = (spark.createDataFrame([("a", x, 1.0), ("b", 2.0, x)], "configuration string, m double, n double") for x in (3.0, 1.0))
    rows = {(r.configuration, r.metric): r.delta for r in searching.against_history(now, before.filter("configuration = 'a'"), ["m", "n"]).collect()}
    assert rows == {("a", "m"): 2.0, ("a", "n"): 0.0}
