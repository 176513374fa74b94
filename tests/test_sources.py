import json

import pytest
from pyspark.sql import functions as F

from rivulet.config import Config
from rivulet.operators import audit
from rivulet.plans import cli, pipeline
from rivulet.sources import convert, readers, sinks
from rivulet.streaming import quality as stream

HEADER = "ts,src_ip,dst_ip,src_bytes,dns_qtype,src_port,dns_AA,label,type\n"


@pytest.fixture()
def raw(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "part_1.csv").write_text("﻿" + HEADER + "".join(f"{1554198358 + i},10.0.0.1,10.0.0.2,{'0.0.0.0' if i == 2 else i * 10},1,{i},T,{i % 2},{'ddos' if i % 2 else 'normal'}\n" for i in range(5)), encoding="utf-8")
    (root / "sub" / "part_2.csv").write_text(HEADER + "1554198400,10.0.0.1,10.0.0.2,-,28,,F,0,normal\n1554198401,10.0.0.1,10.0.0.2,,1,-,0,1,ddos\n", encoding="utf-8")
    return root


def test_resolution_order(spark, raw):
    (raw / "a.parquet").write_bytes(b"")
    names = [n for _, n in readers.resolve(spark, str(raw))]
    assert names == ["part_1.csv", "sub/part_2.csv", "a.parquet"]
    assert [n for _, n in readers.resolve(spark, f"{raw}/part_*.csv")] == ["part_1.csv"]
    for lost in (f"{raw}/none", f"{raw}/x*.csv"):
        with pytest.raises(FileNotFoundError):
            readers.resolve(spark, lost)


def test_load_keeps_tokens_and_places(spark, raw):
    table, population = pipeline.load(spark, Config(), str(raw))
    rows = table.orderBy("orig_pos").collect()
    assert [r.orig_pos for r in rows] == [0, 1, 3, 4, 5, 6] and [r.elig_pos for r in rows] == list(range(6))
    assert [r.src_bytes for r in rows] == [0.0, 10.0, 30.0, 40.0, None, None] and population.startswith("sha256:")
    again, same = pipeline.load(spark, Config(), str(raw))
    assert population == same
    assert pipeline.load(spark, Config(), str(raw), sample=3)[0].count() == 3


def test_repeated_header_and_mixed_files_are_refused(spark, raw, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        readers.header(spark, str(bad))
    (raw / "part_9.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.load_raw(spark, str(raw))


def test_audit(spark, raw):
    table = readers.load_raw(spark, str(raw))
    by = {r["column"]: r for r in audit.by_column(table, ["src_bytes", "src_port"]).collect()}
    assert by["src_bytes"].invalid == 1 and by["src_bytes"].sentinel_missing == 2 and by["src_port"].rows == 7
    assert audit.quality(readers.with_position(table), readers.SOURCE_ID, "orig_pos")[1]["compatible"]


def test_convert(spark, raw, tmp_path):
    with pytest.raises(ValueError):  # the corrupt token isn't quarantined here
        convert.convert(spark, str(raw / "part_1.csv"), str(tmp_path / "out"))
    done = convert.convert(spark, str(raw / "sub"), str(tmp_path / "out"))
    assert done["files"][0]["rows"] == 2 and (tmp_path / "out" / "_conversion_manifest.json").exists()
    with pytest.raises(FileExistsError):
        convert.convert(spark, str(raw / "sub"), str(tmp_path / "out"))
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.csv").write_text("x,y,z\n1,1.5,q\n2,,r\n")
    (plain / "b.csv").write_text("x,w\n1.5,7\n")
    convert.convert(spark, str(plain), str(tmp_path / "p"))
    assert dict(spark.read.parquet(str(tmp_path / "p" / "b.parquet")).dtypes) == {"x": "double", "y": "double", "z": "string", "w": "bigint"}


def test_sinks(spark, tmp_path):
    path = sinks.write_json(tmp_path / "a.json", {"b": float("nan"), "a": {2, 1}})
    assert json.loads(path.read_text()) == {"a": [1, 2], "b": None}
    with pytest.raises(FileExistsError):
        sinks.create_json(path, {})
    with sinks.lock(tmp_path / "l"), pytest.raises(RuntimeError):
        with sinks.lock(tmp_path / "l"):
            pass
    assert not (tmp_path / "l").exists()
    found = sinks.export_indices(spark.createDataFrame([(3, "train"), (1, "train"), (2, "val"), (0, "test")], "elig_pos long, split string"), tmp_path / "s")
    import numpy as np

    assert np.load(found["train"]).tolist() == [1, 3]


def test_experiment(spark, tmp_path):
    cfg = Config(synthetic_n=200, random_forest_estimators=2, random_forest_max_depth=3, representative_strategy="mixed", cluster_n_init=1, svd_components=3, onehot_min_frequency=2)
    done = pipeline.experiment(spark, cfg, tmp_path / "x")
    assert done["status"] == "APPROVED" and done["summary"]["counts"] == {"train": 120, "val": 30, "test": 50}
    for name in ("config_resolved.json", "dataset_info.json", "selected_features.json", "split_manifest.json", "metrics_clustering.json", "representatives_metadata.json", "classification_report_label.txt", "metrics_supervised.json", "profile.json"):
        assert (tmp_path / "x" / name).exists(), name
    with pytest.raises(FileExistsError):
        pipeline.experiment(spark, cfg, tmp_path / "x")
    table, _ = pipeline.load(spark, cfg, None)
    assert pipeline.reload(spark, table, cfg, tmp_path / "x").count() == 200
    with pytest.raises(ValueError):
        pipeline.reload(spark, table.withColumn("label", 1 - F.col("label")), cfg, tmp_path / "x")
    assert pipeline.collect_summaries(spark, [str(tmp_path / "x")]).count() == 2
    assert "valid: True" in pipeline.checkpoint_markdown(sinks.read_json(tmp_path / "x" / "split_manifest.json"))


def test_strict_policy_needs_the_counters(spark, tmp_path):
    with pytest.raises(ValueError):
        pipeline.run(spark, Config(synthetic_n=50, feature_policy="behavioral_strict"), tmp_path / "y", stage="prepare")


def test_cli_parses():
    args = cli.parser().parse_args(["run", "--config", "c.yaml", "--output-dir", "o", "--stage", "cluster"])
    assert args.stage == "cluster"


def test_stream_audit(spark, tmp_path):
    df = spark.createDataFrame([("0.0.0.0", "a"), ("5", "a"), ("-", "b")], "src_bytes string, type string")
    df.write.parquet(str(tmp_path / "in"))
    found = stream.audit_batches(stream.eligible(stream.read(spark, str(tmp_path / "in"), df.schema)), ["src_bytes"], str(tmp_path / "out"), str(tmp_path / "cp"))
    found.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("rows")).first()[0] == 2
