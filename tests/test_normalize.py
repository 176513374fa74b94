import pytest
from pyspark.sql import functions as F

from rivulet import contract
from rivulet.functions import scalar as S
from rivulet.operators import normalize as N
from rivulet.operators import quality as Q


def frame(spark, name, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"pos int, {name} {kind}")


def column(df, name):
    return [r[name] for r in df.orderBy("pos").collect()]


def test_contract_has_47_columns_and_11_logged():
    assert len(contract.FLOW) == 47 and len(contract.LOG1P) == 11
    assert list(contract.FLOW)[:2] == ["ts", "uid"] and list(contract.FLOW)[-2:] == ["label", "type"]
    assert contract.recognised(["ts", "src_ip", "dst_ip", "src_bytes", "dns_qtype", "x"]) and not contract.recognised(["ts"])
    assert [f.dataType.simpleString() for f in contract.schema(["ts", "src_port", "dns_qtype"])] == ["double", "bigint", "string"]


def test_missing_tokens(spark):
    out = N.project(frame(spark, "src_bytes", ["10", "20", "3e2", "-", "", None]))
    assert column(out, "src_bytes") == [10.0, 20.0, 300.0, None, None, None]
    info = N.column_report(frame(spark, "src_bytes", ["10", "-", "", None]))["src_bytes"]
    assert (info["native_missing_count"], info["sentinel_missing_count"], info["missing_after"], info["invalid_count"]) == (1, 2, 3, 0)


@pytest.mark.parametrize("token", ["not-a-number", "NA", "NULL", "nan", "None", "5d", "1e400", " - "])
def test_conversion_failures(spark, token):
    with pytest.raises(N.SchemaError) as e:
        N.normalize(frame(spark, "src_bytes", ["1", token]), position="pos")
    assert e.value.report["columns"]["src_bytes"]["issues"]["conversion_failure"] == {"count": 1, "examples": [{"position": 1, "value": token}]}


@pytest.mark.parametrize(
    ("name", "value", "issue"),
    [("src_bytes", "-1", "domain_violation"), ("src_pkts", "1.5", "domain_violation"), ("src_port", "65536", "domain_violation"), ("label", "2", "domain_violation"), ("dns_AA", "yes", "domain_violation"), ("ts", "-1", "domain_violation"), ("ts", "1e20", "domain_violation"), ("duration", "inf", "infinite"), ("duration", "-Infinity", "infinite"), ("src_bytes", "9007199254740993", "unsafe_integer_precision"), ("label", "-", "missing_required")],
)
def test_violations(spark, name, value, issue):
    info = N.column_report(frame(spark, name, [value]))[name]
    assert info["issues"][issue]["count"] == 1 and info["invalid_count"] == 1


def test_codes_and_booleans(spark):
    assert column(N.project(frame(spark, "dns_qtype", ["1", "01", "1.0", "0", "-"])), "dns_qtype") == ["1", "1", "1", "0", None]
    assert column(N.project(frame(spark, "dns_AA", ["T", "F", "true", "false", "1", "0", "-"])), "dns_AA") == ["T", "F", "T", "F", "T", "F", None]
    assert column(N.project(frame(spark, "dns_AA", [True, False, None], "boolean")), "dns_AA") == ["T", "F", None]


def test_normalising_twice_changes_nothing(spark):
    df = spark.createDataFrame([(0, "10", "1.0", "true", "1"), (1, "-", "", "F", "0")], "pos int, src_bytes string, dns_qtype string, dns_AA string, label string")
    once, _ = N.normalize(df)
    twice, report = N.normalize(once)
    assert once.orderBy("pos").collect() == twice.orderBy("pos").collect() and report["ok"]


def test_report_names_unknown_and_absent_columns(spark):
    _, report = N.normalize(spark.createDataFrame([("1", 2)], "src_bytes string, mine int"))
    assert report["unknown_columns"] == ["mine"] and "ts" in report["absent_columns"] and len(report["absent_columns"]) == 46


def test_feature_kinds_and_log1p(spark):
    df = spark.createDataFrame([(1.0, 2, "SF", 3.0)], "duration double, src_port bigint, conn_state string, own double")
    assert N.feature_kinds(df, ["duration", "src_port", "conn_state", "own"]) == (["duration", "own"], ["src_port", "conn_state"])
    with pytest.raises(ValueError):
        N.feature_kinds(df, ["own"], strict=True)
    with pytest.raises(ValueError):
        N.feature_kinds(df, ["label"])
    with pytest.raises(ValueError):
        N.log_columns(["duration"], ["conn_state"])
    assert N.log_columns(["duration", "own"]) == ["duration"]
    with pytest.raises(ValueError):
        N.apply_log1p(spark.createDataFrame([(-1.0,)], "duration double"), ["duration"])


def test_time_units_and_calendar(spark):
    assert [S.unit_of(1.0, m) for m in (1.7e9, 1.7e12, 1.7e15, 1.7e18)] == ["s", "ms", "us", "ns"] and S.unit_of(0.5, 1e9) is None
    df = spark.createDataFrame([("1700000000.5",), ("x",)], "t string").withColumn("ts", S.timestamp(F.col("t"), "s"))
    found = df.select(S.bucket(F.col("ts"), "1s"), S.bucket(F.col("ts"), "10ms"), S.hour_of(F.col("ts")), S.weekday_of(F.col("ts"))).collect()
    assert list(found[0]) == [1700000000000000, 1700000000500000, 22, 1] and list(found[1]) == [None, None, -1, -1]
    with pytest.raises(ValueError):
        S.width_us("7 weeks")


def test_quarantine(spark):
    df = spark.createDataFrame([(0, "f", i, v, lab, t) for i, (v, lab, t) in enumerate([("0.0.0.0", 0, "normal"), ("10", 0, "normal"), ("20", 1, "ddos"), ("0.0.0.0", 1, "ddos"), (None, 0, "normal"), ("30", 0, "normal")])], "_file_no int, _source_id string, _file_row long, src_bytes string, label int, type string")
    report = Q.report(df, {"f": "00"})
    assert (report["original_rows"], report["quarantined_rows"], report["eligible_rows"]) == (6, 2, 4)
    assert report["population_identity_manifest"]["files"][0]["quarantined_row_positions_0based"] == [0, 3]
    assert report["eligible_target_distributions"] == {"label": {"values": {"0": 3, "1": 1}, "native_nulls": 0}, "type": {"values": {"ddos": 1, "normal": 3}, "native_nulls": 0}}
    assert report["population_id"].startswith("sha256:")
    Q.verify(report, report)
    with pytest.raises(ValueError):
        Q.verify(report, Q.report(df, {"f": "01"}))
    assert Q.eligible(df.withColumn("src_bytes", F.lit(0.0))).count() == 6
    with pytest.raises(ValueError):
        Q.eligible(df.drop("src_bytes"))
    assert Q.partitions(["a_1.csv", "a_3.csv", "a_3.parquet"], 3) == {"missing": [2], "extra": [], "repeated": [3], "ok": False}
