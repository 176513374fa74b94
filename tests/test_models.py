import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.config import Config
from rivulet.operators import classmetrics as V
from rivulet.operators import cluster as C
from rivulet.operators import clustermetrics as M
from rivulet.operators import features as X
from rivulet.operators import prep, reduce, search, supervised
from rivulet.operators import representatives as R

POINTS = [(i, float(x), float(y), i // 4, "ab"[i % 2]) for i, (x, y) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1), (10, 10), (10.4, 10.4), (11, 10), (10, 11), (20, 0), (20.5, 0.5), (21, 0), (20, 1)])]


@pytest.fixture(scope="module")
def toy(spark):
    df = spark.createDataFrame(POINTS, "row long, x double, y double, cluster_id int, label string").withColumn("features", F.array("x", "y"))
    return C.with_centroid_distance(df).cache()


def test_representatives(toy):
    cfg = Config(representatives_per_cluster=2, boundary_per_cluster=1)
    assert [r.row for r in R.medoid(toy, "row", cfg).orderBy("row").collect()] == [0, 5, 9]
    assert R.boundary(toy, "row", cfg).count() == 3
    picked = R.stratified(toy, "row", cfg)
    assert {r.cluster_id: (r.n, r.k) for r in picked.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).collect()} == {0: (2, 2), 1: (2, 2), 2: (2, 2)}
    mixed = R.mixed(toy, "row", cfg)
    assert mixed.count() == mixed.select("row").distinct().count() >= 6
    means = {r.cluster_id: r for r in R.centroid(toy, "row", Config(targets=("label",))).collect()}
    assert means[0].centroid == [0.5, 0.5] and means[0].weight == 4 and means[0].label == "a"
    assert R.metadata(toy, R.select(toy, "row", Config(representative_strategy="centroid")), Config(representative_strategy="centroid"))["compression_ratio"] == 0.25
    with pytest.raises(ValueError):
        R.select(toy, "row", Config(representative_strategy="other"))
    with pytest.raises(ValueError):
        R.boundary(toy.drop("cluster_distance"), "row", cfg)


def test_stratified_fills_up_to_its_budget(spark):
    df = spark.createDataFrame([(i, 0, "big" if i < 97 else f"a rare {i}") for i in range(100)], "row long, cluster_id int, label string")
    picked = R.stratified(df, "row", Config(representatives_per_cluster=10))
    assert picked.count() == 10 and picked.filter("label <> 'big'").count() == 3


def test_internal_metrics(spark, toy):
    x, c = np.array([p[1:3] for p in POINTS]), np.array([p[3] for p in POINTS])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        a, b = d[i, own].mean(), min(d[i, c == k].mean() for k in set(c) - {c[i]})
        s.append((b - a) / max(a, b))
    assert M.silhouette(toy, "row", 100)[0] == pytest.approx(np.mean(s))
    means = np.array([x[c == k].mean(0) for k in range(3)])
    spread = [np.linalg.norm(x[c == k] - means[k], axis=1).mean() for k in range(3)]
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(means[i] - means[j]) for j in range(3) if j != i) for i in range(3)])
    assert M.davies_bouldin(toy).first()[0] == pytest.approx(db)
    within = sum(((x[c == k] - means[k]) ** 2).sum() for k in range(3))
    between = sum(4 * ((means[k] - x.mean(0)) ** 2).sum() for k in range(3))
    assert M.calinski_harabasz(toy).first()[0] == pytest.approx(between * 9 / (within * 2))
    assert M.inertia(toy).first().inertia == pytest.approx(within)
    one = toy.withColumn("cluster_id", F.lit(0))
    assert M.silhouette(one, "row", 100)[0] is None and M.internal(one, "row", 10)["davies_bouldin"] is None


def test_agreement_metrics(spark):
    df = spark.createDataFrame([("a", 0)] * 5 + [("a", 1)] + [("b", 1)] * 4 + [("c", 2)] * 3 + [("c", 0)], "type string, cluster_id int")
    same = spark.createDataFrame([(str(i % 3), i % 3) for i in range(30)], "type string, cluster_id int")
    assert M.ami(same, "type") == pytest.approx(1) and M.agreement(M.contingency(same, "type")).first().v_measure == pytest.approx(1)
    assert M.agreement(M.contingency(df, "type")).first().purity == pytest.approx(12 / 14)
    assert M.adjusted_mutual_info(np.array([[7.0]])) == 1.0
    n = np.array([[5, 1, 0], [0, 4, 0], [1, 0, 3]], float)
    # the expectation by enumerating shuffles
    rng = np.random.default_rng(0)
    u, v = np.repeat([0, 1, 2], n.sum(1).astype(int)), np.repeat([0, 1, 2], n.sum(0).astype(int))
    mi = lambda t: sum(t[i, j] / 14 * math.log(14 * t[i, j] / (t[i].sum() * t[:, j].sum())) for i in range(3) for j in range(3) if t[i, j])
    tries = []
    for _ in range(4000):
        t = np.zeros((3, 3))
        np.add.at(t, (u, rng.permutation(v)), 1)
        tries.append(mi(t))
    assert M.expected_mutual_info(n) == pytest.approx(np.mean(tries), abs=0.01)
    steady = M.stability({s: df.withColumn("row", F.monotonically_increasing_id()) for s in (1, 2, 3)}, "row")
    assert steady["min_pairwise_stability_ami"] == pytest.approx(1)


@pytest.mark.parametrize("counts", [[0, 10, 20], [1, 1, 1], [99, 1, 0], [1000] * 10])
def test_concentration(spark, counts):
    row = M.concentration(spark.createDataFrame(list(enumerate(counts)), "cluster int, count long")).first()
    p = np.array(counts) / sum(counts)
    h = -(p[p > 0] * np.log(p[p > 0])).sum()
    assert row.k == len(counts) and row.empty_clusters == counts.count(0)
    assert row.normalized_entropy == pytest.approx(h / math.log(len(counts))) and row.effective_number_of_clusters == pytest.approx(math.exp(h))
    assert row.top5_cluster_fraction == pytest.approx(np.sort(p)[-5:].sum())
    states = {r.flag: r.state for r in M.degeneracy(M.concentration(spark.createDataFrame(list(enumerate(counts)), "cluster int, count long"))).collect()}
    assert states["top10_concentration"] == "not_applicable" and (states["dominant_cluster"] == "triggered") == (p.max() >= 0.9)


def test_kmeans_and_assignment(spark, toy):
    centers = C.fit_kmeans(toy, 3)
    found = C.assign(toy.drop("cluster_id", "cluster_distance"), centers)
    assert M.ami(found.withColumn("truth", F.floor(F.col("row") / 4)), "truth") == pytest.approx(1)
    assert (C.checked_counts(found, 3) == 4).all()
    with pytest.raises(ValueError):
        C.checked_counts(found, 4)
    with pytest.raises(ValueError):
        C.checked_counts(found, 2)
    assert [r["count"] for r in C.sizes(found, 5).orderBy("cluster_id").collect()] == [4, 4, 4, 0, 0]


def test_one_hot_and_ordinal(spark):
    train = spark.createDataFrame([("S0",), ("SF",), ("SF",), (None,)], "conn_state string")
    enc = prep.fit_one_hot(train, ["conn_state"])
    assert enc.names("conn_state") == ['conn_state="S0"', 'conn_state="SF"']
    rows = spark.createDataFrame([("NEW",), (None,), ("S0",)], "conn_state string").select(enc.apply("conn_state")).collect()
    assert [r[0] for r in rows] == [[0.0, 0.0], [0.0, 1.0], [1.0, 0.0]]
    rare = prep.fit_one_hot(train, ["conn_state"], 2)
    assert [r[0] for r in spark.createDataFrame([("S0",), ("SF",)], "conn_state string").select(rare.apply("conn_state")).collect()] == [[0.0, 1.0], [1.0, 0.0]]
    assert prep.fit_ordinal(train, ["conn_state"]).codes["conn_state"] == {"SF": 1, "S0": 2}


def test_scaler_uses_training_rows_only(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None), (9.0, None)], "a double, b double")
    s = prep.fit_scaler(df, ["a", "b"])
    assert s.median == {"a": 2.0, "b": 0.0} and s.mean["a"] == 3.5 and s.scale["b"] == 1.0
    assert s.scale["a"] == pytest.approx(np.std([1, 2, 2, 9])) and prep.fit_scaler(df, ["a"], 1).scale["a"] == pytest.approx(np.std([1, 2, 2, 9], ddof=1))
    fitted = prep.fit(df, ["a"], [])
    assert [r.features[0] for r in fitted.transform(spark.createDataFrame([(3.5,), (None,)], "a double")).collect()] == pytest.approx([0.0, (2 - 3.5) / s.scale["a"]])


def test_frozen_preprocessing_is_replayed(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "b")], "x double, c string")
    for cfg in (Config(), Config(semantics="gpu")):
        fitted = prep.fit(df, ["x"], ["c"], cfg)
        again = prep.Prep.from_dict(json.loads(json.dumps(fitted.to_dict())))
        assert fitted.transform(df).collect() == again.transform(df).collect()
    broken = fitted.to_dict()
    broken["scaler"]["scale"]["x"] = 0.0
    with pytest.raises(ValueError):
        prep.Prep.from_dict(broken)


def test_quantiles_by_brackets(spark, monkeypatch):
    df = spark.range(5000).select((F.xxhash64("id") % 997).cast("double").alias("x"))
    want = prep.quantiles(df, ["x"], [0.1, 0.5, 0.77])["x"]
    monkeypatch.setattr(prep, "EXACT_ROWS", 100)
    assert prep.quantiles(df, ["x"], [0.1, 0.5, 0.77])["x"] == pytest.approx(want)


def test_svd_and_pca(spark):
    x = np.random.default_rng(1).normal(size=(60, 4)) * [5, 3, 1, 0.1] + 2
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>")
    found = reduce.svd(df, 3)
    assert found.singular == pytest.approx(np.linalg.svd(x)[1][:3]) and reduce.svd(df, 9).components.shape == (3, 4)
    assert reduce.pca(df, 2).singular == pytest.approx(np.linalg.svd(x - x.mean(0))[1][:2])
    got = np.array([r.reduced for r in found.transform(df).collect()])
    assert got == pytest.approx(x @ found.components.T)
    assert reduce.svd(df.limit(1), 3) is None


def test_feature_policies(spark):
    df = spark.createDataFrame([(1,) * 9], "src_ip int, dport int, uid int, dataset_id int, label int, type int, Service int, duration int, conn_state int")
    assert X.select(df, "all_except_labels") == ["src_ip", "dport", "uid", "Service", "duration", "conn_state"]
    assert X.select(df, "no_raw_ip") == ["dport", "Service", "duration", "conn_state"]
    assert X.select(df, "no_raw_ip_port") == ["Service", "duration", "conn_state"]
    with pytest.raises(ValueError):
        X.select(df, "behavioral_strict")
    with pytest.raises(ValueError):
        X.select(df, "other")
    with pytest.raises(X.LeakageError):
        X.guard(["duration", "Src_IP"], "no_raw_ip_port")
    with pytest.raises(X.LeakageError):
        X.guard(list(reversed(X.STRICT)), "behavioral_strict")
    assert X.guard(X.STRICT, "behavioral_strict")["ok"] and X.service_features(["Service", "a"], "drop") == ["a"]


def test_confusion_with_a_class_never_predicted(spark):
    rows = list(zip("normal mitm normal ransomware backdoor backdoor".split(), "normal normal normal backdoor backdoor normal".split()))
    t = V.confusion(spark.createDataFrame(rows, "y string, p string"), "y", "p")
    by = {r["class"]: r for r in V.by_class(t).collect()}
    s = V.summary(t).first()
    assert by["mitm"].recall == 0 and by["ransomware"].f1 == 0 and s.accuracy == 0.5
    assert s.macro_f1 == pytest.approx(np.mean([by[c].f1 for c in by]))
    assert V.confusion_matrix(t).columns == ["truth", "pred_backdoor", "pred_mitm", "pred_normal", "pred_ransomware"]
    assert "weighted avg" in V.report_text(t) and V.support_report(t, ["normal", "new"], 3) == {"support": {"normal": 2, "new": 0}, "absent": ["new"], "small_support": {"normal": 2}}


def test_binary_scores(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1], [0.05, 0.2, 0.4, 0.7, 0.9, 0.95])), "y int, s double")
    assert V.binary(df, "y", "s", ["0", "1"]) == pytest.approx({"roc_auc": 1.0, "average_precision": 1.0, "fpr_at_tpr95": 0.0, "threshold": 0.7})
    tied = V.score_table(spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double"), "s", "y")
    assert V.roc_auc(tied).first()[0] == pytest.approx(0.875) and V.average_precision(tied).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert V.binary(df, "y", "s", ["0", "1", "2"])["roc_auc"] is None
    assert [V.positive_label(c) for c in (["0", "1"], ["Attack", "benign"], ["a", "b"])] == ["1", "Attack", "b"]


def test_forest(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("string").alias("label"), F.array((F.col("id") % 2 * 3).cast("double"), (F.col("id") % 7).cast("double")).alias("features"))
    cfg = Config(random_forest_estimators=3, random_forest_max_depth=3)
    assert supervised.evaluate(supervised.fit(df, "label", cfg), df, "label")["accuracy"] == 1.0
    one = supervised.fit(df.filter("label = '0'"), "label", cfg)
    assert one.predict(df).select("predicted").distinct().first()[0] == "0"


def test_pareto_and_decisions(spark, tmp_path):
    names = [n for n, _ in search.OBJECTIVES]
    rows = spark.createDataFrame([("a", 0.9, 0.5, 10.0, 0.9, 0.2), ("b", 0.8, 0.4, 9.0, 0.8, 0.1), ("c", 0.7, 0.6, 8.0, 0.7, 0.3), ("tie", 0.9, 0.5, 10.0, 0.9, 0.2)], "configuration string, " + ", ".join(f"{n} double" for n in names))
    front = sorted(r.configuration for r in search.pareto_front(rows).collect())
    assert front == ["a", "b", "tie"]
    with pytest.raises(ValueError):
        search.pareto_front(rows.withColumn("test_ami", F.lit(1.0)))
    with pytest.raises(ValueError):
        search.pareto_front(rows.withColumn(names[0], F.lit(float("nan"))))
    a = search.decide(tmp_path, "A", front, ["a", "b"], "me", "they hold")
    search.decide(tmp_path, "B", front, ["a"], "me", "it holds", a)
    assert len(search.verified(tmp_path)) == 2
    with pytest.raises(FileExistsError):
        search.decide(tmp_path, "A", front, ["a"], "me", "again")
    with pytest.raises(ValueError):
        search.decide(tmp_path, "C", front, ["tie"], "me", "new", a)
    with pytest.raises(ValueError):
        search.unseal(a | {"approved_by": "you"})
    assert len(search.grid("abcd", range(8), (1, 2, 3))) == 96


def test_curves_don_t_depend_on_ranges_of_scores(spark):
    """Running sums and corners across the ranges' ends."""
    rows = [(int(i % 7 in (0, 3) or i > 150), float((i * 37) % 101) / 10) for i in range(200)]
    df = spark.createDataFrame(rows, "y int, s double")
    for f in (lambda t: t.drop("range"), V.roc_points, V.roc_auc, V.average_precision, V.fpr_at_tpr):
        one, many = (sorted(tuple(r) for r in f(V.score_table(df, "s", "y", n)).collect()) for n in (1, 6))
        assert len(one) == len(many) and all(a == pytest.approx(b) for a, b in zip(one, many))
