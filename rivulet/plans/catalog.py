"""The registered queries, each with its SQL where SQL can express it.

Adapters give the test tables the roles of a flow table: events are flows (with injected tokens
where raw text is needed), lineitem and part are wide numeric tables, embeddings a matrix with
given clusters, labels a truth and a prediction.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.config import Config
from rivulet.contract import DATASET_IDS, FLOW, IDENTITY, IPS, PORTS, ROW_IDS, SERVICES, TARGETS
from rivulet.functions import scalar as S
from rivulet.operators import audit, classmetrics, cluster, clustermetrics, features, normalize, prep, quality, reduce, representatives, search, splits, supervised
from rivulet.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql.strip()
        return f

    return add


# Adapters -------------------------------------------------------------------------------------


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw flows: text with missing, corrupt and invalid tokens at fixed rows."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    amount = F.floor(F.abs("value") * 100).cast("bigint").cast("string")
    src_bytes = F.when(i % 97 == 0, "0.0.0.0").when(i % 89 == 0, "-").when(i % 83 == 0, "").when(i % 79 == 0, F.lit(None)).when(i % 401 == 0, "nan").when(i % 397 == 0, "-5").when(i % 389 == 0, "1.5").otherwise(amount)
    spelled = F.element_at(F.array(*map(F.lit, ("T", "F", "true", "FALSE", "1", "0.0", "-", "yes", "True"))), (i % 9 + 1).cast("int"))
    coded = F.element_at(F.array(*map(F.lit, ("1", "01", "1.0", "28", "-", "x", "0"))), (i % 7 + 1).cast("int"))
    port = F.when(i % 211 == 0, "65536").when(i % 199 == 0, "-1").otherwise((i % 65536).cast("string"))
    return e.select(
        i.alias("orig_pos"), "ts", "user_id", F.concat(F.lit("f"), (i % 3).cast("string")).alias("file"), src_bytes.alias("src_bytes"), port.alias("src_port"),
        spelled.alias("dns_AA"), coded.alias("dns_qtype"), (F.col("event_type") == "error").cast("bigint").alias("label"), F.col("event_type").alias("type"),
    )


_FLOW = """
flow AS (SELECT event_id AS orig_pos, ts, user_id, 'f' || (event_id % 3)::VARCHAR AS file,
CASE WHEN event_id % 97 = 0 THEN '0.0.0.0' WHEN event_id % 89 = 0 THEN '-' WHEN event_id % 83 = 0 THEN '' WHEN event_id % 79 = 0 THEN NULL
WHEN event_id % 401 = 0 THEN 'nan' WHEN event_id % 397 = 0 THEN '-5' WHEN event_id % 389 = 0 THEN '1.5' ELSE floor(abs(value) * 100)::BIGINT::VARCHAR END AS src_bytes,
CASE WHEN event_id % 211 = 0 THEN '65536' WHEN event_id % 199 = 0 THEN '-1' ELSE (event_id % 65536)::VARCHAR END AS src_port,
['T','F','true','FALSE','1','0.0','-','yes','True'][event_id % 9 + 1] AS dns_AA, ['1','01','1.0','28','-','x','0'][event_id % 7 + 1] AS dns_qtype,
(event_type = 'error')::BIGINT AS label, event_type AS type FROM events),
parsed AS (SELECT *, src_bytes IS NULL OR src_bytes IN ('', '-') AS gone, CASE WHEN regexp_full_match(src_bytes, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN src_bytes::DOUBLE END AS x FROM flow)
""".strip()


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a split by fixed rows."""
    m = F.col("event_id") % 10
    return table(spark, sf_dir, "events").withColumn("split", F.when(m < 6, "train").when(m < 8, "val").otherwise("test"))


_ASSIGNED = "assigned AS (SELECT *, CASE WHEN event_id % 10 < 6 THEN 'train' WHEN event_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM events)"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("int").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("features"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.with_centroid_distance(matrix(spark, sf_dir))


_CELLS = "cells AS (SELECT vec_id, label AS c, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), means AS (SELECT c, i, avg(v) AS m, count(*) AS n FROM cells GROUP BY c, i), dist AS (SELECT vec_id, cells.c AS c, sqrt(sum((v - m) * (v - m))) AS d FROM cells JOIN means USING (c, i) GROUP BY vec_id, cells.c)"
EVENTS = Config(label_col="label", type_col="event_type", timestamp_col="ts", temporal_bucket_freq="1d", group_cols=("user_id",))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles at a precision that doesn't depend on the order of sums; no negative zeros."""
    names = columns or [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", (F.col("event_type") == "error").cast("bigint"))


# Quality and normalisation --------------------------------------------------------------------


@query(f"WITH {_FLOW} SELECT count(*) AS original_rows, count(*) FILTER (coalesce(src_bytes = '0.0.0.0', false)) AS quarantined_rows, count(*) FILTER (NOT coalesce(src_bytes = '0.0.0.0', false)) AS eligible_rows FROM flow")
def flow_quarantine_counts(spark, sf_dir):
    return quality.counts(flow(spark, sf_dir))


@query(f"WITH {_FLOW} SELECT file, count(*) AS original_rows, count(*) FILTER (coalesce(src_bytes = '0.0.0.0', false)) AS quarantined_rows, count(*) FILTER (NOT coalesce(src_bytes = '0.0.0.0', false)) AS eligible_rows FROM flow GROUP BY file")
def flow_quarantine_by_file(spark, sf_dir):
    return quality.counts(flow(spark, sf_dir), ["file"])


@query(f"WITH {_FLOW}, kept AS (SELECT * FROM flow WHERE NOT coalesce(src_bytes = '0.0.0.0', false)) SELECT 'label' AS target, label::VARCHAR AS value, count(*) AS count FROM kept GROUP BY label UNION ALL SELECT 'type', type, count(*) FROM kept GROUP BY type")
def flow_target_distribution(spark, sf_dir):
    return quality.target_counts(flow(spark, sf_dir))


@query(f"WITH {_FLOW} SELECT orig_pos, row_number() OVER (ORDER BY orig_pos) - 1 AS elig_pos FROM flow WHERE NOT coalesce(src_bytes = '0.0.0.0', false)")
def eligible_positions(spark, sf_dir):
    return readers.with_eligible_position(quality.eligible(flow(spark, sf_dir)).select("orig_pos"))


@query(f"WITH {_FLOW} SELECT orig_pos, CASE WHEN NOT gone AND x >= 0 AND x % 1 = 0 AND x <= 9007199254740991 THEN x END AS src_bytes FROM parsed")
def normalize_missing_tokens(spark, sf_dir):
    return normalize.project(flow(spark, sf_dir).select("orig_pos", "src_bytes"))


_VIOLATIONS = f"""WITH {_FLOW}, kept AS (SELECT * FROM parsed WHERE NOT coalesce(src_bytes = '0.0.0.0', false))
SELECT file, 'src_bytes' AS "column", 'conversion_failure' AS issue, count(*) FILTER (NOT gone AND x IS NULL) AS count FROM kept GROUP BY file
UNION ALL SELECT file, 'src_bytes', 'infinite', 0 FROM kept GROUP BY file
UNION ALL SELECT file, 'src_bytes', 'domain_violation', count(*) FILTER (NOT gone AND (x < 0 OR x % 1 <> 0)) FROM kept GROUP BY file
UNION ALL SELECT file, 'src_bytes', 'unsafe_integer_precision', count(*) FILTER (NOT gone AND abs(x) > 9007199254740991) FROM kept GROUP BY file
UNION ALL SELECT file, 'src_port', 'conversion_failure', 0 FROM kept GROUP BY file
UNION ALL SELECT file, 'src_port', 'infinite', 0 FROM kept GROUP BY file
UNION ALL SELECT file, 'src_port', 'domain_violation', count(*) FILTER (src_port::BIGINT < 0 OR src_port::BIGINT > 65535) FROM kept GROUP BY file
UNION ALL SELECT file, 'src_port', 'unsafe_integer_precision', 0 FROM kept GROUP BY file
UNION ALL SELECT file, 'dns_AA', 'domain_violation', count(*) FILTER (dns_AA = 'yes') FROM kept GROUP BY file"""


@query(_VIOLATIONS)
def normalize_numeric_violations(spark, sf_dir):
    return audit.quality(flow(spark, sf_dir).select("file", "orig_pos", "src_bytes", "src_port", "dns_AA"), "file", "orig_pos")[0]


@query(f"WITH {_FLOW} SELECT orig_pos, CASE WHEN dns_AA IN ('T', 'true', 'True', '1') THEN 'T' WHEN dns_AA IN ('F', 'FALSE', '0.0') THEN 'F' END AS \"dns_AA\" FROM flow")
def normalize_boolean_map(spark, sf_dir):
    return normalize.project(flow(spark, sf_dir).select("orig_pos", "dns_AA"))


@query(f"WITH {_FLOW} SELECT orig_pos, CASE WHEN dns_qtype IN ('1', '01', '1.0') THEN '1' WHEN dns_qtype IN ('28', '0') THEN dns_qtype END AS dns_qtype FROM flow")
def normalize_codes(spark, sf_dir):
    return normalize.project(flow(spark, sf_dir).select("orig_pos", "dns_qtype"))


_AUDIT = """SELECT {by} 'src_bytes' AS "column", count(*) AS rows, count(*) FILTER (src_bytes IS NULL) AS native_missing, count(*) FILTER (src_bytes IN ('', '-')) AS sentinel_missing, count(*) FILTER (NOT gone AND x IS NULL) AS invalid, count(*) FILTER (NOT gone AND x < 0) AS negative, count(*) FILTER (NOT gone AND x % 1 <> 0) AS non_integral, 0::BIGINT AS out_of_port_range, 0::BIGINT AS bad_boolean FROM parsed {group}
UNION ALL SELECT {by} 'src_port', count(*), 0, 0, 0, count(*) FILTER (src_port::BIGINT < 0), 0, count(*) FILTER (src_port::BIGINT < 0 OR src_port::BIGINT > 65535), 0 FROM parsed {group}
UNION ALL SELECT {by} 'dns_AA', count(*), 0, count(*) FILTER (dns_AA = '-'), 0, 0, 0, 0, count(*) FILTER (dns_AA = 'yes') FROM parsed {group}"""
_AUDITED = ["src_bytes", "src_port", "dns_AA"]


@query(f"WITH {_FLOW} " + _AUDIT.format(by="", group=""))
def schema_audit_by_column(spark, sf_dir):
    return audit.by_column(flow(spark, sf_dir), _AUDITED).drop("dtype", "bad_label")


@query(f"WITH {_FLOW} " + _AUDIT.format(by="file,", group="GROUP BY file") + " UNION ALL " + _AUDIT.format(by="'ALL' AS file,", group=""))
def schema_audit_rollup(spark, sf_dir):
    return audit.with_total(flow(spark, sf_dir), _AUDITED, "file").drop("bad_label")


@query(f"WITH {_FLOW} SELECT orig_pos AS position, src_bytes AS value FROM parsed WHERE NOT gone AND (x < 0 OR x % 1 <> 0) ORDER BY orig_pos LIMIT 5")
def issue_examples_first5(spark, sf_dir):
    return normalize.examples(flow(spark, sf_dir), "src_bytes", "domain_violation", "orig_pos")


@query("WITH m AS (SELECT epoch_us(ts) AS u FROM events) SELECT 's' AS unit, quantile_cont(floor(u / 1000000.0), 0.5) AS median FROM m UNION ALL SELECT 'ms', quantile_cont(floor(u / 1000.0), 0.5) FROM m UNION ALL SELECT 'us', quantile_cont(u::DOUBLE, 0.5) FROM m")
def infer_ts_unit(spark, sf_dir):
    us = table(spark, sf_dir, "events").select(S.micros(F.col("ts")).cast("double").alias("us"), F.floor(S.micros(F.col("ts")) / 1000).cast("double").alias("ms"), F.floor(S.micros(F.col("ts")) / 1_000_000).cast("double").alias("s"))
    return spark.createDataFrame([(normalize.infer_unit(us, c), prep.quantiles(us, [c], [0.5])[c][0]) for c in ("s", "ms", "us")], "unit string, median double")


def _buckets(spark: SparkSession, sf_dir: str, freq: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.bucket(F.col("ts"), freq).alias("bucket_us"))


for _name, _freq, _us in (("time_bucket_1s", "1s", 1_000_000), ("time_bucket_10ms", "10ms", 10_000), ("time_bucket_5min", "5min", 300_000_000)):
    query(f"SELECT event_id, epoch_us(ts) - epoch_us(ts) % {_us} AS bucket_us FROM events", _name)(partial(_buckets, freq=_freq))


@query("SELECT event_id, hour(ts)::BIGINT AS ts_hour, (isodow(ts) - 1)::BIGINT AS ts_day_of_week FROM events")
def causal_calendar(spark, sf_dir):
    from rivulet.operators.features import time_features

    df, names = time_features(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts"], "ts", "extract_causal")
    return df.select("event_id", *names)


@query(f"SELECT l_returnflag, {r('avg(ln(1 + l_quantity))')} AS l_quantity, {r('avg(ln(1 + l_extendedprice))')} AS l_extendedprice FROM lineitem GROUP BY l_returnflag")
def log1p_transform(spark, sf_dir):
    df = normalize.apply_log1p(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(df.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("l_quantity"), F.avg("l_extendedprice").alias("l_extendedprice")))


# Splits ---------------------------------------------------------------------------------------


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(table(spark, sf_dir, "events")).withColumn("user_id", F.when(F.col("event_id") % 50 != 0, F.col("user_id")))
    return splits.group_histogram(e, ["user_id", "event_type"], ["label", "event_type"], "event_id")


_GROUPS = "g AS (SELECT CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id, event_type, count(*) AS size, min(event_id) AS first FROM events GROUP BY ALL)"


@query(f"WITH {_GROUPS} SELECT * FROM g")
def group_codes_null_safe(spark, sf_dir):
    return grouped(spark, sf_dir).drop("classes")


@query(f"WITH {_GROUPS} SELECT q, {r('quantile_cont(size, q)')} AS size FROM g, (VALUES (0.0), (0.25), (0.5), (0.75), (0.9), (0.99), (1.0)) v(q) GROUP BY q".replace("quantile_cont(size, q)", "CASE WHEN q = 0.0 THEN quantile_cont(size, 0.0) WHEN q = 0.25 THEN quantile_cont(size, 0.25) WHEN q = 0.5 THEN quantile_cont(size, 0.5) WHEN q = 0.75 THEN quantile_cont(size, 0.75) WHEN q = 0.9 THEN quantile_cont(size, 0.9) WHEN q = 0.99 THEN quantile_cont(size, 0.99) ELSE quantile_cont(size, 1.0) END").replace("SELECT q,", "SELECT q::DOUBLE AS q,"))
def group_size_quantiles(spark, sf_dir):
    return rounded(splits.size_quantiles(grouped(spark, sf_dir)), "size")


@query("WITH u AS (SELECT event_type AS class, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT class, sum(n)::BIGINT AS rows, count(*) AS groups, " + r("max(n) / sum(n)") + " AS largest_group_fraction FROM u GROUP BY class")
def group_class_support(spark, sf_dir):
    h = splits.group_histogram(labelled(table(spark, sf_dir, "events")), ["user_id"], ["event_type"], "event_id")
    return rounded(splits.class_support(h).drop("target"))


@query(f"SELECT user_id, {r('count(*) / (SELECT count(*) FROM events)')} AS fraction FROM events GROUP BY user_id ORDER BY count(*) DESC, min(event_id) LIMIT 20")
def group_top20_fraction(spark, sf_dir):
    h = splits.group_histogram(labelled(table(spark, sf_dir, "events")), ["user_id"], ["event_type"], "event_id")
    return rounded(splits.largest_shares(h).select("user_id", "fraction"))


@query(f"WITH {_ASSIGNED}, u AS (SELECT user_id, max(split = 'train') AS tr, max(split = 'val') AS va, max(split = 'test') AS te FROM assigned GROUP BY user_id) SELECT count(*) FILTER (tr) AS n_train_groups, count(*) FILTER (va) AS n_val_groups, count(*) FILTER (te) AS n_test_groups, count(*) FILTER (tr AND va) AS train_val_overlap, count(*) FILTER (tr AND te) AS train_test_overlap, count(*) FILTER (va AND te) AS val_test_overlap FROM u")
def group_overlap(spark, sf_dir):
    return splits.overlap(assigned(spark, sf_dir), ["user_id"])


@query(f"WITH {_ASSIGNED}, t AS (SELECT event_type AS c, max(split = 'train') AS tr, max(split = 'val') AS va, max(split = 'test') AS te FROM assigned GROUP BY event_type) SELECT coalesce(string_agg(c, ',' ORDER BY c) FILTER (tr), '') AS known_in_train, coalesce(string_agg(c, ',' ORDER BY c) FILTER (va AND NOT tr), '') AS first_seen_validation, coalesce(string_agg(c, ',' ORDER BY c) FILTER (te AND NOT tr AND NOT va), '') AS first_seen_test, coalesce(string_agg(c, ',' ORDER BY c) FILTER (te AND NOT tr), '') AS unseen_from_train_in_test, coalesce(string_agg(c, ',' ORDER BY c) FILTER (te AND tr), '') AS closed_set_test_classes FROM t")
def class_set_report(spark, sf_dir):
    found = splits.class_sets(assigned(spark, sf_dir), "event_type")
    return found.select(*(F.array_join(c, ",").alias(c) for c in found.columns))


_DISTRIBUTION = f"WITH {_ASSIGNED}, s AS (SELECT DISTINCT split FROM assigned), c AS (SELECT DISTINCT event_type AS class FROM assigned), n AS (SELECT split, event_type AS class, count(*) AS k FROM assigned GROUP BY ALL), d AS (SELECT split, class, coalesce(k, 0) AS count FROM s CROSS JOIN c LEFT JOIN n USING (split, class)), t AS (SELECT *, sum(count) OVER (PARTITION BY split)::BIGINT AS split_total FROM d)"


@query(f"{_DISTRIBUTION} SELECT split, class, count, split_total, {r('count / split_total')} AS fraction FROM t")
def split_distribution(spark, sf_dir):
    return rounded(splits.distribution(assigned(spark, sf_dir), "event_type"))


@query(f"{_DISTRIBUTION} SELECT class, " + ", ".join(f"max(count) FILTER (split = '{s}') AS {s}_count, {r(f'max(count / split_total) FILTER (split = {chr(39)}{s}{chr(39)})')} AS {s}_fraction" for s in splits.NAMES) + ", sum(count)::BIGINT AS total FROM t GROUP BY class")
def split_distribution_pivot(spark, sf_dir):
    return rounded(splits.distribution_pivot(assigned(spark, sf_dir), "event_type"))


_CUTS = """b AS (SELECT {by} epoch_us(ts) - epoch_us(ts) % 86400000000 AS u, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT {by} u, row_number() OVER ({part} ORDER BY u) AS r, sum(n) OVER ({part} ORDER BY u) AS upto, sum(n) OVER ({all}) AS total FROM b),
k AS (SELECT {sel} x.r AS i, y.r AS j, x.total AS total, abs(x.upto - x.total * 0.6) + abs(y.upto - x.upto - x.total * 0.15) + abs(x.total - y.upto - x.total * 0.25) AS cost FROM p x JOIN p y ON {on} x.r < y.r AND y.r < (SELECT max(r) FROM p z WHERE {same} true)),
w AS (SELECT * FROM (SELECT *, row_number() OVER ({part} ORDER BY round(cost, 6), i, j) AS best FROM k) WHERE best = 1)"""
_CUT_ALL = _CUTS.format(by="", part="", all="", sel="", on="", same="")
_CUT_EACH = _CUTS.format(by="event_type,", part="PARTITION BY event_type", all="PARTITION BY event_type", sel="x.event_type,", on="x.event_type = y.event_type AND", same="z.event_type = x.event_type AND")


@query(f"WITH {_CUT_ALL} SELECT i, j, {r('cost::DOUBLE')} AS cost, (SELECT u FROM p WHERE r = i + 1) AS val_from_us, (SELECT u FROM p WHERE r = j + 1) AS test_from_us FROM w")
def temporal_cuts(spark, sf_dir):
    rows = splits.bucket_histogram(table(spark, sf_dir, "events").withColumn("_bucket", S.bucket(F.col("ts"), "1d"))).orderBy("_bucket").collect()
    i, j, cost = splits.two_cuts(np.array([x.n for x in rows]), splits.goals_of(EVENTS))
    return rounded(spark.createDataFrame([(i, j, cost, rows[i]["_bucket"], rows[j]["_bucket"])], "i bigint, j bigint, cost double, val_from_us bigint, test_from_us bigint"))


@query(f"WITH {_CUT_ALL}, a AS (SELECT CASE WHEN r <= i THEN 'train' WHEN r <= j THEN 'val' ELSE 'test' END AS split, epoch_us(ts) AS t, epoch_us(ts) - epoch_us(ts) % 86400000000 AS u FROM events JOIN p ON epoch_us(ts) - epoch_us(ts) % 86400000000 = p.u CROSS JOIN w) SELECT split, min(t) AS start_us, max(t) AS end_us, count(*) AS records, count(DISTINCT u) AS buckets FROM a GROUP BY split")
def temporal_split_counts(spark, sf_dir):
    return splits.chronology(splits.temporal(table(spark, sf_dir, "events"), EVENTS), F.col("ts"), "1d")


@query(f"WITH {_CUT_EACH}, a AS (SELECT e.event_type, CASE WHEN r <= i THEN 'train' WHEN r <= j THEN 'val' ELSE 'test' END AS split FROM events e JOIN p ON e.event_type = p.event_type AND epoch_us(ts) - epoch_us(ts) % 86400000000 = p.u JOIN w ON w.event_type = e.event_type) SELECT event_type, split, count(*) AS count FROM a GROUP BY ALL")
def temporal_per_class_counts(spark, sf_dir):
    return splits.temporal_per_class(table(spark, sf_dir, "events"), EVENTS).groupBy("event_type", "split").count()


_TEMPORAL_PIVOT = f"""WITH {_CUT_ALL}, a AS (SELECT event_type AS class, CASE WHEN r <= i THEN 'train' WHEN r <= j THEN 'val' ELSE 'test' END AS split FROM events JOIN p ON epoch_us(ts) - epoch_us(ts) % 86400000000 = p.u CROSS JOIN w),
n AS (SELECT class, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'val') AS val_count, count(*) FILTER (split = 'test') AS test_count FROM a GROUP BY class)
SELECT class, train_count, {r('train_count / sum(train_count) OVER ()')} AS train_fraction, val_count, {r('val_count / sum(val_count) OVER ()')} AS val_fraction, test_count, {r('test_count / sum(test_count) OVER ()')} AS test_fraction, train_count + val_count + test_count AS total FROM n"""


@query(_TEMPORAL_PIVOT)
def flagship_temporal_distribution(spark, sf_dir):
    """Scan, time buckets, optimal cuts, assignment and per-split class shares."""
    return rounded(splits.distribution_pivot(splits.temporal(table(spark, sf_dir, "events"), EVENTS), "event_type"))


@query(f"WITH {_ASSIGNED} SELECT event_type, split, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us, count(*) AS records, count(DISTINCT epoch_us(ts) - epoch_us(ts) % 86400000000) AS buckets FROM assigned GROUP BY ALL")
def chronology_report(spark, sf_dir):
    return splits.chronology(assigned(spark, sf_dir), F.col("ts"), "1d", ["event_type"])


@query(f"WITH {_ASSIGNED}, b AS (SELECT epoch_us(ts) // 86400000000 AS u, max(split = 'train') AS tr, max(split = 'val') AS va, max(split = 'test') AS te FROM assigned GROUP BY u) SELECT count(*) FILTER (tr AND va) AS train_val_bucket_overlap, count(*) FILTER (tr AND te) AS train_test_bucket_overlap, count(*) FILTER (va AND te) AS val_test_bucket_overlap FROM b")
def bucket_overlap(spark, sf_dir):
    return splits.bucket_overlap(assigned(spark, sf_dir), F.col("ts"), "1d")


_ROWS = "a AS (SELECT event_id AS elig_pos, CASE WHEN event_id % 10 < 6 THEN 'train' WHEN event_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM events WHERE event_id % 31 <> 0 UNION ALL SELECT event_id, 'test' FROM events WHERE event_id % 13 = 0 UNION ALL SELECT -1 - event_id, 'train' FROM events WHERE event_id % 101 = 0)"


@query(f"WITH {_ROWS}, n AS (SELECT count(*) AS n FROM events), g AS (SELECT elig_pos, count(*) AS k, count(DISTINCT split) AS s FROM a GROUP BY elig_pos) SELECT coalesce(sum(k) FILTER (NOT elig_pos BETWEEN 0 AND n - 1), 0)::BIGINT AS out_of_range, coalesce(sum(k - s) FILTER (elig_pos BETWEEN 0 AND n - 1), 0)::BIGINT AS duplicates_within_splits, count(*) FILTER (elig_pos BETWEEN 0 AND n - 1 AND s > 1) AS overlapping_rows, max(n) - count(*) FILTER (elig_pos BETWEEN 0 AND n - 1) AS missing_rows FROM g, n")
def row_partition_validation(spark, sf_dir):
    a, i = assigned(spark, sf_dir).select(F.col("event_id").alias("elig_pos"), "split"), F.col("elig_pos")
    bad = a.filter(i % 31 != 0).union(a.filter(i % 13 == 0).select("elig_pos", F.lit("test"))).union(a.filter(i % 101 == 0).select(-1 - i, F.lit("train")))
    return splits.row_validation(bad, a.count())


@query("WITH c AS (SELECT l_returnflag, count(*) AS n, round_even(count(*) * 0.25, 0) AS test FROM lineitem GROUP BY l_returnflag), v AS (SELECT *, round_even((n - test) * 0.2, 0) AS val FROM c) SELECT l_returnflag, 'test' AS split, test::BIGINT AS count FROM v UNION ALL SELECT l_returnflag, 'val', val::BIGINT FROM v UNION ALL SELECT l_returnflag, 'train', (n - test - val)::BIGINT FROM v")
def random_stratified_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("_row", F.monotonically_increasing_id())
    return splits.random_stratified(rows, Config(label_col="l_returnflag"), "_row").groupBy("l_returnflag", "split").count()


@query()
def group_greedy_assignment(spark, sf_dir):
    found, _ = splits.group_stratified(labelled(table(spark, sf_dir, "events")), EVENTS, "event_id")
    return found.select("event_id", "user_id", "split")


# Preprocessing --------------------------------------------------------------------------------

_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing values at fixed prices."""
    hole = F.floor(F.col("l_extendedprice")) % 17 == 0
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", *(F.when(~hole, F.col(c)).alias(c) for c in _NUMERIC))


_GAPS = "t AS (SELECT " + ", ".join(f"CASE WHEN floor(l_extendedprice)::BIGINT % 17 <> 0 THEN {c} END AS {c}" for c in _NUMERIC) + " FROM lineitem)"


def _scaler_sql(dev: str) -> str:
    one = "SELECT '{c}' AS \"column\", " + r("max(m)", 8) + " AS median, " + r("avg(coalesce({c}, m))", 8) + " AS mean, " + r(f"coalesce(nullif({dev}(coalesce({{c}}, m)), 0), 1)", 8) + " AS scale FROM t, (SELECT quantile_cont({c}, 0.5) AS m FROM t)"
    return f"WITH {_GAPS} " + " UNION ALL ".join(one.format(c=c) for c in _NUMERIC)


def _scaler(spark: SparkSession, sf_dir: str, ddof: int) -> DataFrame:
    s = prep.fit_scaler(_gaps(spark, sf_dir), _NUMERIC, ddof)
    return rounded(spark.createDataFrame([(c, s.median[c], s.mean[c], s.scale[c]) for c in _NUMERIC], "column string, median double, mean double, scale double"), digits=8)


query(_scaler_sql("stddev_pop"), "standardize_pop")(partial(_scaler, ddof=0))
query(_scaler_sql("stddev_samp"), "standardize_samp")(partial(_scaler, ddof=1))


@query(f"SELECT p_partkey, {r('(p_retailprice - a) / s')} AS z FROM part, (SELECT avg(p_retailprice) AS a, stddev_pop(p_retailprice) AS s FROM part)")
def median_impute_and_scale(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    s = prep.fit_scaler(part, ["p_retailprice"])
    return rounded(part.select("p_partkey", s.apply("p_retailprice").alias("z")))


@query("SELECT 'p_brand' AS \"column\", (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1) AS mode UNION ALL SELECT 'p_type', (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1)")
def mode_impute(spark, sf_dir):
    found = prep.modes(prep.value_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type"]))
    return spark.createDataFrame(sorted(found.items()), "column string, mode string")


@query("WITH v AS (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 3 <> 0) SELECT p_partkey, (SELECT string_agg(CASE WHEN v.p_brand = part.p_brand THEN '1' ELSE '0' END, '' ORDER BY v.p_brand) FROM v) AS code FROM part")
def onehot_fixed_vocab(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    enc = prep.fit_one_hot(part.filter("p_partkey % 3 <> 0"), ["p_brand"])
    return part.select("p_partkey", F.array_join(F.transform(enc.apply("p_brand"), lambda x: x.cast("int").cast("string")), "").alias("code"))


@query("SELECT p_type AS value, row_number() OVER (ORDER BY count(*) DESC, p_type) AS code FROM part GROUP BY p_type QUALIFY code <= 64")
def ordinal_topk_codes(spark, sf_dir):
    codes = prep.top_codes(prep.value_counts(table(spark, sf_dir, "part"), ["p_type"]))["p_type"]
    return spark.createDataFrame(sorted(codes.items()), "value string, code bigint")


@query()
def svd_singular_values(spark, sf_dir):
    found = reduce.svd(matrix(spark, sf_dir), 20)
    return rounded(spark.createDataFrame([(i, float(s)) for i, s in enumerate(found.singular)], "i int, singular double"), digits=4)


@query()
def pca_projection(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return rounded(reduce.pca(m, 3).transform(m).select("vec_id", *(F.element_at("reduced", i + 1).alias(f"pc{i}") for i in range(3))), digits=4)


# Clusters -------------------------------------------------------------------------------------


@query(f"WITH {_CELLS} SELECT c AS cluster_id, i::INTEGER AS i, {r('m')} AS mean FROM means")
def cluster_centroids(spark, sf_dir):
    return rounded(cluster.centroids(matrix(spark, sf_dir)).select("cluster_id", F.posexplode("centroid").alias("i", "mean")))


@query(f"WITH {_CELLS} SELECT vec_id, c AS cluster_id, {r('d')} AS cluster_distance FROM dist")
def cluster_distance(spark, sf_dir):
    return rounded(measured(spark, sf_dir).select("vec_id", "cluster_id", "cluster_distance"))


@query(f"WITH {_CELLS}, x AS (SELECT cells.vec_id AS vec_id, means.c AS c, sqrt(sum((v - m) * (v - m))) AS d FROM cells JOIN means USING (i) GROUP BY cells.vec_id, means.c) SELECT vec_id, c::INTEGER AS cluster_id, {r('d')} AS cluster_distance FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1")
def nearest_centre(spark, sf_dir):
    m = matrix(spark, sf_dir)
    centers = np.array([x.centroid for x in cluster.centroids(m).orderBy("cluster_id").collect()])
    return rounded(cluster.assign(m, centers).select("vec_id", "cluster_id", "cluster_distance"))


@query(f"WITH {_CELLS} SELECT c AS cluster_id, vec_id FROM dist QUALIFY row_number() OVER (PARTITION BY c ORDER BY d, vec_id) = 1")
def medoids(spark, sf_dir):
    return representatives.medoid(measured(spark, sf_dir), "vec_id", Config()).select("cluster_id", "vec_id")


_BOUNDARY = f"WITH {_CELLS}, far AS (SELECT c AS cluster_id, vec_id FROM dist QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC, vec_id) <= 5)"


@query(f"{_BOUNDARY} SELECT * FROM far")
def boundary_topk(spark, sf_dir):
    return representatives.boundary(measured(spark, sf_dir), "vec_id", Config()).select("cluster_id", "vec_id")


@query(f"{_BOUNDARY}, n AS (SELECT label AS cluster_id, count(*) AS original_n FROM embeddings GROUP BY label), k AS (SELECT cluster_id, count(*) AS representative_n FROM far GROUP BY cluster_id) SELECT cluster_id, original_n, coalesce(representative_n, 0) AS representative_n, {r('coalesce(representative_n, 0) / original_n')} AS ratio FROM n LEFT JOIN k USING (cluster_id)")
def cluster_summary(spark, sf_dir):
    m = measured(spark, sf_dir)
    return rounded(representatives.summary(m, representatives.boundary(m, "vec_id", Config())))


@query("SELECT label AS cluster_id, least(count(*), 20) AS n FROM embeddings GROUP BY label")
def stratified_representatives(spark, sf_dir):
    m = measured(spark, sf_dir).withColumn("label", (F.col("vec_id") % 3).cast("string"))
    return representatives.stratified(m, "vec_id", Config()).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query()
def mixed_representatives(spark, sf_dir):
    m = measured(spark, sf_dir).withColumn("label", (F.col("vec_id") % 3).cast("string"))
    return representatives.mixed(m, "vec_id", Config()).select("cluster_id", "vec_id")


@query(f"WITH {_CELLS} SELECT {r('sum(d * d)')} AS inertia, count(DISTINCT c) AS clusters_observed FROM dist")
def inertia(spark, sf_dir):
    return rounded(clustermetrics.inertia(measured(spark, sf_dir)))


@query(f"WITH {_CELLS}, s AS (SELECT c, avg(d) AS s FROM dist GROUP BY c), p AS (SELECT a.c AS c, b.c AS o, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM means a JOIN means b ON a.i = b.i AND a.c <> b.c GROUP BY a.c, b.c), w AS (SELECT p.c, max(CASE WHEN d > 0 THEN (x.s + y.s) / d ELSE 0 END) AS r FROM p JOIN s x ON x.c = p.c JOIN s y ON y.c = p.o GROUP BY p.c) SELECT {r('avg(r)')} AS davies_bouldin FROM w")
def davies_bouldin(spark, sf_dir):
    return rounded(clustermetrics.davies_bouldin(matrix(spark, sf_dir)))


@query(f"WITH {_CELLS}, g AS (SELECT i, avg(v) AS g FROM cells GROUP BY i), b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM means JOIN g USING (i)), w AS (SELECT sum(d * d) AS w, count(*) AS n, count(DISTINCT c) AS k FROM dist) SELECT {r('b * (n - k) / (w * (k - 1))')} AS calinski_harabasz FROM b, w")
def calinski_harabasz(spark, sf_dir):
    return rounded(clustermetrics.calinski_harabasz(matrix(spark, sf_dir)))


@query(f"""WITH e AS (SELECT vec_id, label AS c, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.vec_id AS v, a.c AS c, b.c AS o, sum(list_distance(a.x, b.x)) AS total, count(*) AS n FROM e a, e b GROUP BY ALL),
s AS (SELECT v, c, max(CASE WHEN c = o THEN n END) AS own, max(CASE WHEN c = o THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN c <> o THEN total / n END) AS b FROM p GROUP BY v, c)
SELECT c AS cluster_id, {r('avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END)')} AS silhouette FROM s GROUP BY c""")
def silhouette_by_cluster(spark, sf_dir):
    """Over the metric's sample, which is the whole table up to its size."""
    sample = matrix(spark, sf_dir).orderBy(F.xxhash64(F.lit(42), "vec_id"), "vec_id").limit(20_000)
    return rounded(clustermetrics.silhouette_rows(sample, "vec_id").groupBy("cluster_id").agg(F.avg("silhouette").alias("silhouette")))


_CONTINGENCY = "t AS (SELECT l_linestatus AS class, l_returnflag AS cluster, count(*) AS n FROM lineitem GROUP BY ALL)"


@query(f"WITH {_CONTINGENCY} SELECT * FROM t")
def contingency(spark, sf_dir):
    return clustermetrics.contingency(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag")


@query(f"WITH {_CONTINGENCY}, m AS (SELECT *, sum(n) OVER (PARTITION BY class) AS a, sum(n) OVER (PARTITION BY cluster) AS b, sum(n) OVER () AS s, max(n) OVER (PARTITION BY cluster) AS best FROM t), h AS (SELECT sum(n / s * ln(s * n / (a * b))) AS mi, -sum(n / s * ln(a / s)) AS hu, -sum(n / s * ln(b / s)) AS hv, sum(best * n / b / s) AS purity FROM m) SELECT {r('mi')} AS mutual_info, {r('hu')} AS class_entropy, {r('hv')} AS cluster_entropy, {r('mi / hu')} AS homogeneity, {r('mi / hv')} AS completeness, {r('2 * (mi / hu) * (mi / hv) / (mi / hu + mi / hv)')} AS v_measure, {r('purity')} AS purity FROM h")
def v_measure_purity(spark, sf_dir):
    return rounded(clustermetrics.agreement(clustermetrics.contingency(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag")))


def _ami_sql(name: str, source: str, a: str, b: str) -> str:
    """CTEs that end in a table of this name with one column, ami; log factorials are lgamma."""
    lf = lambda x: f"lgamma({x} + 1)"
    return f"""{name}_t AS (SELECT {a} AS u, {b} AS v, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL), {name}_a AS (SELECT u, sum(n) AS a FROM {name}_t GROUP BY u), {name}_b AS (SELECT v, sum(n) AS b FROM {name}_t GROUP BY v), {name}_n AS (SELECT sum(n) AS t FROM {name}_t),
{name}_m AS (SELECT sum(n / t * ln(t * n / (a * b))) AS mi FROM {name}_t JOIN {name}_a USING (u) JOIN {name}_b USING (v), {name}_n),
{name}_h AS (SELECT ((SELECT -sum(a / t * ln(a / t)) FROM {name}_a, {name}_n) + (SELECT -sum(b / t * ln(b / t)) FROM {name}_b, {name}_n)) / 2 AS h),
{name}_k AS (SELECT a, b, t, unnest(range(greatest(1, a + b - t)::BIGINT, least(a, b)::BIGINT + 1)) AS k FROM {name}_a, {name}_b, {name}_n),
{name}_e AS (SELECT sum(k / t * ln(t * k / (a * b)) * exp({lf("a")} + {lf("b")} + {lf("t - a")} + {lf("t - b")} - {lf("t")} - {lf("k")} - {lf("a - k")} - {lf("b - k")} - {lf("t - a - b + k")})) AS e FROM {name}_k),
{name} AS (SELECT (mi - e) / (h - e) AS ami FROM {name}_m, {name}_h, {name}_e)"""


@query(f"WITH {_ami_sql('x', 'labels', 'quality', 'toxic')} SELECT {r('ami')} AS ami FROM x")
def ami(spark, sf_dir):
    return rounded(spark.createDataFrame([(clustermetrics.ami(table(spark, sf_dir, "labels"), "quality", "toxic"),)], "ami double"))


_USERS = "c AS (SELECT user_id, count(*) AS count FROM events GROUP BY user_id), q AS (SELECT *, row_number() OVER (ORDER BY count DESC) AS r, sum(count) OVER () AS n FROM c)"
_STATS = f"""WITH {_USERS}, s AS (SELECT max(n)::BIGINT AS n, count(*) AS k, count(*) FILTER (count > 0) AS observed_clusters, count(*) FILTER (count = 0) AS empty_clusters, min(count) AS min_size, max(count) AS max_size, avg(count) AS mean_size, quantile_cont(count, 0.5) AS median_size, stddev_pop(count) AS std_size, max(count / n) AS max_cluster_fraction, sum(count / n) FILTER (r <= 5) AS top5_cluster_fraction, sum(count / n) FILTER (r <= 10) AS top10_cluster_fraction, -sum(count / n * ln(count / n)) AS entropy,
count(*) FILTER (count < 10) AS clusters_lt10, avg((count < 10)::INT) AS fraction_clusters_lt10, count(*) FILTER (count < 100) AS clusters_lt100, avg((count < 100)::INT) AS fraction_clusters_lt100, count(*) FILTER (count < 1000) AS clusters_lt1000, avg((count < 1000)::INT) AS fraction_clusters_lt1000 FROM q)"""
_DOUBLES = ("mean_size", "median_size", "std_size", "max_cluster_fraction", "top5_cluster_fraction", "top10_cluster_fraction", "entropy", "fraction_clusters_lt10", "fraction_clusters_lt100", "fraction_clusters_lt1000")


def _user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustermetrics.concentration(table(spark, sf_dir, "events").groupBy("user_id").count())


@query(f"{_STATS} SELECT * REPLACE (" + ", ".join(f"{r(c)} AS {c}" for c in _DOUBLES) + f"), {r('entropy / ln(k)')} AS normalized_entropy, {r('exp(entropy)', 4)} AS effective_number_of_clusters, {r('exp(entropy) / k')} AS effective_clusters_ratio FROM s")
def concentration_stats(spark, sf_dir):
    found = _user_stats(spark, sf_dir)
    return rounded(rounded(found, "effective_number_of_clusters", digits=4), *(f.name for f in found.schema if f.dataType.simpleString() == "double" and f.name != "effective_number_of_clusters"))


@query(f"{_STATS}, v AS (SELECT *, entropy / ln(k) AS normalized_entropy, exp(entropy) / k AS effective_clusters_ratio FROM s) " + " UNION ALL ".join(f"SELECT '{f}' AS flag, {r(m)} AS value, {x} AS threshold, CASE WHEN k <= {b} THEN 'not_applicable' WHEN {m} {'>=' if o == 'ge' else '<'} {x} THEN 'triggered' ELSE 'clear' END AS state FROM v".replace(f"{x} AS threshold", f"{x}::DOUBLE AS threshold") for f, m, x, o, b in clustermetrics.FLAGS))
def degeneracy_flags(spark, sf_dir):
    return rounded(clustermetrics.degeneracy(_user_stats(spark, sf_dir)), "value")


@query()
def kmeans_fit(spark, sf_dir):
    m = matrix(spark, sf_dir).drop("cluster_id")
    return rounded(cluster.assign(m, cluster.fit_kmeans(m, 10)).select("vec_id", "cluster_id", "cluster_distance"), digits=4)


# Classification -------------------------------------------------------------------------------

_CONFUSION = "t AS (SELECT quality::VARCHAR AS truth, toxic::VARCHAR AS predicted, count(*) AS n FROM labels GROUP BY ALL)"
_PRF = f"WITH {_CONFUSION}, c AS (SELECT truth AS class FROM t UNION SELECT predicted FROM t), s AS (SELECT class, coalesce((SELECT sum(n) FROM t WHERE truth = class), 0)::BIGINT AS support, coalesce((SELECT sum(n) FROM t WHERE predicted = class), 0)::BIGINT AS predicted, coalesce((SELECT sum(n) FROM t WHERE truth = class AND predicted = class), 0)::BIGINT AS tp FROM c), m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM s), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classmetrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"WITH {_CONFUSION} SELECT * FROM t")
def confusion(spark, sf_dir):
    return _labels(spark, sf_dir)


@query(f"{_PRF} SELECT class, support, predicted, tp, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM f")
def prf_by_class(spark, sf_dir):
    return rounded(classmetrics.by_class(_labels(spark, sf_dir)))


@query(f"{_PRF} SELECT {r('sum(tp) / sum(support)')} AS accuracy, " + ", ".join(f"{r(f'avg({m})')} AS macro_{m}, {r(f'sum({m} * support) / sum(support)')} AS weighted_{m}" for m in ("precision", "recall", "f1")) + " FROM f")
def prf_macro_weighted(spark, sf_dir):
    return rounded(classmetrics.summary(_labels(spark, sf_dir)))


_SCORES = "h AS (SELECT value AS score, count(*) FILTER (event_type = 'error') AS pos, count(*) AS k FROM events GROUP BY value), c AS (SELECT score, pos, k, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(k - pos) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(k - pos) OVER () AS n FROM h)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classmetrics.score_table(labelled(table(spark, sf_dir, "events")), "value", "label")


@query(f"WITH {_SCORES} SELECT {r('sum(pos * (n - fp + (k - pos) / 2)) / max(p * n)')} AS roc_auc FROM c")
def roc_auc_rank(spark, sf_dir):
    return rounded(classmetrics.roc_auc(_scores(spark, sf_dir)))


@query(f"WITH {_SCORES} SELECT {r('sum(pos / p * tp / (tp + fp))')} AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return rounded(classmetrics.average_precision(_scores(spark, sf_dir)))


@query(f"WITH {_SCORES}, k2 AS (SELECT *, lag(tp) OVER w AS t0, lead(tp) OVER w AS t1, lag(fp) OVER w AS f0, lead(fp) OVER w AS f1 FROM c WINDOW w AS (ORDER BY score DESC)) SELECT {r('fp / n')} AS fpr_at_tpr, {r('score')} AS threshold FROM k2 WHERE tp / p >= 0.95 AND (t0 IS NULL OR t1 IS NULL OR t0 + t1 <> 2 * tp OR f0 + f1 <> 2 * fp) ORDER BY fp / n, score DESC LIMIT 1")
def fpr_at_tpr95(spark, sf_dir):
    return rounded(classmetrics.fpr_at_tpr(_scores(spark, sf_dir)))


@query()
def rf_predict(spark, sf_dir):
    cfg = Config(random_forest_estimators=10, random_forest_max_depth=8)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("label"), F.array(*(F.col(c) for c in _NUMERIC)).alias("features"))
    forest = supervised.fit(rows, "label", cfg)
    return classmetrics.confusion(forest.predict(rows), "label", "predicted")


# Search ---------------------------------------------------------------------------------------

_RUNS = "runs AS (SELECT l_returnflag AS representation, l_linenumber::BIGINT AS k, l_linestatus AS seed, round(avg(l_quantity), 6) AS silhouette, round(avg(l_discount), 6) AS max_cluster_fraction FROM lineitem GROUP BY ALL)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("representation"), F.col("l_linenumber").cast("bigint").alias("k"), F.col("l_linestatus").alias("seed"))
    return g.agg(F.round(F.avg("l_quantity"), 6).alias("silhouette"), F.round(F.avg("l_discount"), 6).alias("max_cluster_fraction")).withColumn("flagged", F.col("max_cluster_fraction") >= 0.05)


@query(f"WITH {_RUNS} SELECT representation, k, {r('avg(silhouette)')} AS mean_silhouette, min(silhouette) AS min_silhouette, max(silhouette) AS max_silhouette, {r('stddev_samp(silhouette)')} AS std_silhouette, max(max_cluster_fraction) AS worst_max_cluster_fraction, count(*) FILTER (max_cluster_fraction >= 0.05) AS flagged_seeds, count(*) AS seeds FROM runs GROUP BY representation, k")
def seed_aggregate(spark, sf_dir):
    return rounded(search.aggregate(_runs(spark, sf_dir), ["silhouette"]))


@query(f"WITH {_RUNS}, m AS (SELECT representation, k, avg(silhouette) AS s FROM runs GROUP BY ALL) SELECT a.representation, a.k, {r('a.s - b.s')} AS delta_mean_silhouette FROM m a JOIN m b ON a.k = b.k AND b.representation = 'A' WHERE a.representation <> 'A'")
def delta_vs_baseline(spark, sf_dir):
    return rounded(search.against_base(search.aggregate(_runs(spark, sf_dir), ["silhouette"]), "A", ["mean_silhouette"]))


_CANDIDATES = "c AS (SELECT p_brand || '_' || (p_size % 4)::VARCHAR AS configuration, round(avg(p_size), 3) AS mean_silhouette, round(avg(p_retailprice), 3) AS mean_davies_bouldin, count(*)::DOUBLE AS mean_calinski_harabasz, max(p_size)::DOUBLE AS min_pairwise_stability_ami, min(p_size)::DOUBLE AS worst_max_cluster_fraction FROM part GROUP BY 1)"


@query(f"WITH {_CANDIDATES} SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.mean_silhouette >= a.mean_silhouette AND b.mean_davies_bouldin <= a.mean_davies_bouldin AND b.mean_calinski_harabasz >= a.mean_calinski_harabasz AND b.min_pairwise_stability_ami >= a.min_pairwise_stability_ami AND b.worst_max_cluster_fraction <= a.worst_max_cluster_fraction AND (b.mean_silhouette > a.mean_silhouette OR b.mean_davies_bouldin < a.mean_davies_bouldin OR b.mean_calinski_harabasz > a.mean_calinski_harabasz OR b.min_pairwise_stability_ami > a.min_pairwise_stability_ami OR b.worst_max_cluster_fraction < a.worst_max_cluster_fraction))")
def pareto_front(spark, sf_dir):
    name = F.concat_ws("_", "p_brand", (F.col("p_size") % 4).cast("string"))
    rows = table(spark, sf_dir, "part").groupBy(name.alias("configuration")).agg(F.round(F.avg("p_size"), 3).alias("mean_silhouette"), F.round(F.avg("p_retailprice"), 3).alias("mean_davies_bouldin"), F.count("*").cast("double").alias("mean_calinski_harabasz"), F.max("p_size").cast("double").alias("min_pairwise_stability_ami"), F.min("p_size").cast("double").alias("worst_max_cluster_fraction"))
    return search.pareto_front(rows)


@query()
def synthetic_flow(spark, sf_dir):
    return readers.synthetic(spark, 300)


# The contract on injected tokens --------------------------------------------------------------

#: Columns of the adapter: the modulus of event_id at which each token stands, and the plain value in Spark and SQL.
_SECONDS = ("floor(unix_micros(cast(ts as timestamp)) / 1000000)", "epoch_us(ts) // 1000000")
_TOKENS: dict[str, tuple[dict[int, str | None], str, str]] = {
    "ts": ({101: "1e11", 103: "-5", 107: "-"}, f"cast({_SECONDS[0]} as string)", f"({_SECONDS[1]})::VARCHAR"),
    "duration": ({109: "inf", 113: "-Infinity", 127: "1e400", 131: "abc", 137: "1_0", 139: ""}, "cast(event_id as string)", "event_id::VARCHAR"),
    "dst_bytes": ({149: "9007199254740993", 151: "1e300", 157: "0.5", 163: "nan", 167: None}, "cast(event_id as string)", "event_id::VARCHAR"),
    "dst_port": ({173: "70000", 179: "inf", 181: "-1", 191: "443.0"}, "cast(event_id % 1000 as string)", "(event_id % 1000)::VARCHAR"),
    "label": ({193: None, 197: "-", 199: "2", 211: "0.5"}, "cast(event_id % 2 as string)", "(event_id % 2)::VARCHAR"),
    "type": ({223: None, 227: ""}, "event_type", "event_type"),
    "dns_qclass": ({229: "1.5", 233: "-2", 239: "x"}, "cast(event_id % 3 as string)", "(event_id % 3)::VARCHAR"),
    "http_uri": ({241: "-", 251: " - "}, "concat('/', event_type)", "'/' || event_type"),
}


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw cells with every kind of violation at fixed rows."""
    case = lambda odd, plain: "CASE " + " ".join(f"WHEN event_id % {m} = 0 THEN {_text(t)}" for m, t in odd.items()) + f" ELSE {plain} END"
    return table(spark, sf_dir, "events").selectExpr("event_id AS orig_pos", *(f"cast({case(odd, plain)} as string) AS {c}" for c, (odd, plain, _) in _TOKENS.items()))


def _text(t: str | None) -> str:
    return "NULL" if t is None else f"'{t}'"


def _tokens_sql() -> str:
    """raw, and for each numeric column its number x, whether it is gone, and the checks."""
    case = lambda odd, plain: "CASE " + " ".join(f"WHEN event_id % {m} = 0 THEN {_text(t)}" for m, t in odd.items()) + f" ELSE {plain} END"
    return "raw AS (SELECT event_id AS orig_pos, " + ", ".join(f"{case(odd, plain)} AS {c}" for c, (odd, _, plain) in _TOKENS.items()) + " FROM events)"


def _number_sql(c: str) -> str:
    plain = rf"regexp_full_match({c}, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')"
    return f"CASE WHEN {c} = '1e400' THEN NULL WHEN {plain} THEN TRY_CAST({c} AS DOUBLE) WHEN lower({c}) IN ('inf', 'infinity') THEN 'inf'::DOUBLE WHEN lower({c}) IN ('-inf', '-infinity') THEN '-inf'::DOUBLE END"


#: Column to least and largest value, whether whole, whether it may be missing.
_RULES = {"ts": (0, 9223372036.854775807, False, True), "duration": (0, None, False, True), "dst_bytes": (0, None, True, True), "dst_port": (0, 65535, True, True), "label": (0, 1, True, False), "dns_qclass": (0, None, True, True)}


def _checks_sql(c: str) -> dict[str, str]:
    low, high, whole, nullable = _RULES[c]
    gone, x, finite = f"({c} IS NULL OR {c} IN ('', '-'))", f"{c}_x", f"NOT isinf({c}_x)"
    out = {} if nullable else {"missing_required": gone}
    above = [] if high is None else [f"{x} >= {high}" if c == "ts" else f"{x} > {high}"]
    bad = [f"{x} < {low}", *above, *([f"{x} % 1 <> 0"] if whole else [])]
    out |= {"conversion_failure": f"NOT {gone} AND {x} IS NULL", "infinite": f"isinf({x})", "domain_violation": f"{finite} AND ({' OR '.join(bad)})"}
    return out | ({"unsafe_integer_precision": f"{finite} AND abs({x}) > 9007199254740991"} if whole else {})


_NUMBERS = f"{_tokens_sql()}, numbers AS (SELECT *, " + ", ".join(f"{_number_sql(c)} AS {c}_x" for c in _RULES) + " FROM raw)"


@query(f"WITH {_NUMBERS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS issue, count(*) FILTER (coalesce({x}, false)) AS count FROM numbers" for c in _RULES for k, x in _checks_sql(c).items()) + " UNION ALL SELECT 'type', 'missing_required', count(*) FILTER (type IS NULL OR type = '') FROM numbers")
def injected_violations(spark, sf_dir):
    """Missing required, unparsable, infinite, out of domain and imprecise cells of every kind."""
    found = normalize.column_report(tokens(spark, sf_dir))
    return spark.createDataFrame([(c, k, v["count"]) for c, x in found.items() for k, v in x["issues"].items()], "column string, issue string, count bigint")


@query(f"WITH {_NUMBERS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS native_missing_count, count(*) FILTER ({c} IN ('', '-')) AS sentinel_missing_count, count(*) FILTER ({' OR '.join(f'coalesce({x}, false)' for x in _checks_sql(c).values())}) AS invalid_count, count(*) FILTER ({c} IS NULL OR {c} IN ('', '-') OR {' OR '.join(f'coalesce({x}, false)' for x in _checks_sql(c).values())}) AS missing_after FROM numbers" for c in _RULES))
def injected_column_report(spark, sf_dir):
    found, names = normalize.column_report(tokens(spark, sf_dir), list(_RULES)), ("native_missing_count", "sentinel_missing_count", "invalid_count", "missing_after")
    return spark.createDataFrame([(c, *(x[n] for n in names)) for c, x in found.items()], "column string, " + ", ".join(f"{n} bigint" for n in names))


def _clean_sql(c: str) -> str:
    bad = " OR ".join(f"coalesce({x}, false)" for x in _checks_sql(c).values())
    value = f"CASE WHEN NOT ({c} IS NULL OR {c} IN ('', '-') OR {bad}) THEN {c}_x END"
    return f"({value})::BIGINT::VARCHAR AS {c}" if c == "dns_qclass" else f"({value})::BIGINT AS {c}" if c in ("dst_port", "label") else f"{value} AS {c}"


_CLEAN = f"WITH {_NUMBERS} SELECT orig_pos, " + ", ".join(_clean_sql(c) for c in _RULES) + ", nullif(type, '') AS type, CASE WHEN http_uri <> '-' THEN http_uri END AS http_uri FROM numbers"


@query(_CLEAN)
def normalize_injected(spark, sf_dir):
    return normalize.project(tokens(spark, sf_dir))


@query(_CLEAN)
def normalize_twice(spark, sf_dir):
    """Normalised cells are left as they are, and old typed tables are read the same way."""
    return normalize.project(normalize.project(tokens(spark, sf_dir)))


@query(f"WITH {_FLOW} SELECT (row_number() OVER (PARTITION BY file ORDER BY orig_pos) - 1) * 0 + orig_pos AS file_row, file AS source_id FROM flow WHERE src_bytes = '0.0.0.0'")
def quarantine_positions(spark, sf_dir):
    rows = flow(spark, sf_dir).withColumns({readers.FILE_NO: F.lit(0), readers.SOURCE_ID: F.col("file"), readers.FILE_ROW: F.col("orig_pos")})
    return quality.positions(rows).select(F.col(readers.SOURCE_ID).alias("source_id"), F.col(readers.FILE_ROW).alias("file_row"))


_UNITS_SQL = " UNION ALL ".join(f"SELECT '{u}' AS unit, event_id, (epoch_us(ts) // {d}) * {d} AS us FROM events" for u, d in (("s", 1_000_000), ("ms", 1_000), ("us", 1)))


@query(_UNITS_SQL)
def timestamps_by_unit(spark, sf_dir):
    """Epoch numbers of three units as text, parsed by the unit that their size gives."""
    parts = []
    for unit, width in (("s", 1_000_000), ("ms", 1_000), ("us", 1)):
        raw = table(spark, sf_dir, "events").select("event_id", F.floor(S.micros(F.col("ts")) / width).cast("bigint").cast("string").alias("t"))
        parts.append(normalize.with_time(raw, "t").select(F.lit(unit).alias("unit"), "event_id", S.micros(F.col("_ts")).alias("us")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Feature policies -----------------------------------------------------------------------------

_EXTRA = ("dataset_id", "Flow_ID", "srcip", "application", "_hidden")


def _universe(spark: SparkSession) -> DataFrame:
    """An empty table of the contract's columns and some with other names of the same roles."""
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (*FLOW, *_EXTRA)))


def _listed(names: Iterable[str]) -> str:
    return ", ".join(f"'{n}'" for n in sorted(names))


_COLUMNS = "cols AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate((*FLOW, *_EXTRA))) + ") v(i, c))"
_GONE = {"all_except_labels": TARGETS | DATASET_IDS, "no_raw_ip": TARGETS | DATASET_IDS | IPS | ROW_IDS, "no_raw_ip_port": TARGETS | DATASET_IDS | IPS | ROW_IDS | PORTS}
_BANNED = {"all_except_labels": TARGETS | DATASET_IDS, "no_raw_ip": TARGETS | DATASET_IDS | IPS | ROW_IDS, "no_raw_ip_port": TARGETS | DATASET_IDS | IDENTITY, "behavioral_strict": TARGETS | DATASET_IDS | IDENTITY | SERVICES}
_STRICT_SQL = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(features.STRICT)) + ") v(i, c)"


@query(f"WITH {_COLUMNS} " + " UNION ALL ".join(f"SELECT '{p}' AS policy, (row_number() OVER (ORDER BY i) - 1) AS place, c AS feature FROM cols WHERE lower(c) NOT IN ({_listed(gone)}) AND c NOT LIKE '\\_%' ESCAPE '\\'" for p, gone in _GONE.items()) + f" UNION ALL SELECT 'behavioral_strict', i, c FROM {_STRICT_SQL}")
def feature_policies(spark, sf_dir):
    df = _universe(spark)
    return spark.createDataFrame([(p, i, c) for p in features.POLICIES for i, c in enumerate(features.select(df, p))], "policy string, place bigint, feature string")


@query(f"WITH {_COLUMNS} " + " UNION ALL ".join(f"SELECT '{p}' AS policy, c AS feature FROM cols WHERE lower(c) IN ({_listed(banned)})" for p, banned in _BANNED.items()))
def feature_leaks(spark, sf_dir):
    """What the guard refuses, column by column."""
    def refused(policy: str, c: str) -> bool:
        try:
            features.guard([*features.STRICT, c] if policy == "behavioral_strict" else [c], policy)
        except features.LeakageError as e:
            return "forbidden" in str(e)
        return False

    return spark.createDataFrame([(p, c) for p in features.POLICIES for c in (*FLOW, *_EXTRA) if refused(p, c)], "policy string, feature string")


@query(f"WITH {_COLUMNS} SELECT 'drop' AS policy, c AS feature FROM cols WHERE lower(c) NOT IN ({_listed(SERVICES)}) UNION ALL SELECT 'keep', c FROM cols")
def service_policies(spark, sf_dir):
    names = [*FLOW, *_EXTRA]
    return spark.createDataFrame([(p, c) for p in ("keep", "drop") for c in features.service_features(names, p)], "policy string, feature string")


@query(f"WITH {_COLUMNS} SELECT c AS feature, c IN ({_listed(c for c, s in FLOW.items() if s.log1p)}) AS log1p, CASE WHEN c IN ({_listed(c for c, s in FLOW.items() if s.treatment == 'numeric')}) THEN 'numeric' ELSE 'nominal' END AS kind FROM cols WHERE lower(c) NOT IN ({_listed(TARGETS)})")
def feature_treatments(spark, sf_dir):
    df = _universe(spark)
    names = [c for c in df.columns if c.lower() not in TARGETS]
    numeric, _ = normalize.feature_kinds(df, names)
    logs = normalize.log_columns(names)
    return spark.createDataFrame([(c, c in logs, "numeric" if c in numeric else "nominal") for c in names], "feature string, log1p boolean, kind string")


# Splits, reports and manifests ----------------------------------------------------------------


@query(f"WITH {_ASSIGNED}, g AS (SELECT s.split, c.event_type AS class, count(a.event_id) AS n FROM (VALUES ('train'), ('val'), ('test')) s(split) CROSS JOIN (SELECT DISTINCT event_type FROM assigned) c LEFT JOIN assigned a ON a.split = s.split AND a.event_type = c.event_type GROUP BY ALL) SELECT split, class, n AS count, n = 0 AS missing, n > 0 AND n < 3000 AS small, n < 2000 AS below FROM g")
def split_distribution_report(spark, sf_dir):
    cfg = Config(extra={"split_small_support_threshold": 3000, "split_min_class_support": 2000})
    found = splits.distribution_report(assigned(spark, sf_dir), ["event_type", "absent"], cfg)["event_type"]["splits"]
    return spark.createDataFrame([(s, c, n, c in x["missing"], c in x["small_support"], c in x["below_minimum"]) for s, x in found.items() for c, n in x["counts"].items()], "split string, class string, count bigint, missing boolean, small boolean, below boolean")


@query("WITH u AS (SELECT event_type AS class, count(DISTINCT user_id) AS g, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT max(k)::DOUBLE / sum(k) AS share, count(*) AS groups FROM (SELECT user_id, count(*) AS k FROM events GROUP BY user_id)) SELECT 'groups' AS reason, (groups < 3) AS holds FROM b UNION ALL SELECT 'largest', share > 0.62 FROM b UNION ALL SELECT 'event_type=' || class, g < 3 OR n < 3 * 1900 FROM u UNION ALL SELECT 'label=' || (class = 'error')::INT::VARCHAR, bool_or(false) OR sum(n) < 3 * 1900 FROM u GROUP BY class = 'error'")
def group_infeasibility(spark, sf_dir):
    """Which reasons exclude a group split when every class needs 1,900 rows in each split."""
    cfg = Config(extra={"split_min_class_support": 1900})
    e = labelled(table(spark, sf_dir, "events"))
    found = splits.group_diagnostics(splits.group_histogram(e, ["user_id"], ["label", "event_type"], "event_id"))
    reasons = splits.impossible(found, cfg)
    rows = [("groups", any("fewer groups" in x for x in reasons)), ("largest", any("one group" in x for x in reasons))]
    rows += [(f"{t}={c}", any(x.startswith(f"{t}={c} ") for x in reasons)) for t, own in found["class_group_support"].items() for c in own]
    return spark.createDataFrame(rows, "reason string, holds boolean")


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT 'groups_whole' AS check, true AS ok UNION ALL SELECT 'within_tolerance', true UNION ALL SELECT 'every_row_once', true UNION ALL SELECT 'every_class_everywhere', true")
def group_split_invariants(spark, sf_dir):
    """What any acceptable group split has: whole groups, the wanted shares, each row once, all classes."""
    e = labelled(table(spark, sf_dir, "events"))
    found, diagnostics = splits.group_stratified(e, EVENTS, "event_id")
    found = found.cache()
    shared = splits.overlap(found, ["user_id"]).first()
    n, goals = e.count(), EVENTS.goals()
    counts = {x["split"]: x["count"] for x in found.groupBy("split").count().collect()}
    classes = splits.class_counts(found, "event_type").filter("count < 1").isEmpty()
    rows = [("groups_whole", not any(shared[f"{a}_{b}_overlap"] for a, b in splits.PAIRS)), ("within_tolerance", all(abs(counts[s] / n - goals[s]) <= EVENTS.group_tolerance for s in splits.NAMES)), ("every_row_once", sum(counts.values()) == n and found.select("event_id").distinct().count() == n), ("every_class_everywhere", classes and diagnostics["feasible_found"])]
    found.unpersist()
    return spark.createDataFrame(rows, "check string, ok boolean")


@query(f"WITH {_CUT_ALL}, a AS (SELECT CASE WHEN r <= i THEN 'train' WHEN r <= j THEN 'val' ELSE 'test' END AS split FROM events JOIN p ON epoch_us(ts) - epoch_us(ts) % 86400000000 = p.u CROSS JOIN w), t AS (SELECT count(*) AS n FROM a) SELECT split, count(*) AS count, {r('count(*) / max(n)')} AS proportion, true AS validation_ok FROM a, t GROUP BY split")
def temporal_manifest(spark, sf_dir):
    cfg = Config(split_strategy="temporal", label_col="label", type_col="event_type", timestamp_col="ts", temporal_bucket_freq="1d")
    found = splits.manifest(splits.temporal(labelled(table(spark, sf_dir, "events")), cfg), cfg, "event_id")
    return rounded(spark.createDataFrame([(s, found["counts"][s], found["proportions"][s], found["validation_ok"]) for s in splits.NAMES], "split string, count bigint, proportion double, validation_ok boolean"))


# Feature vectors ------------------------------------------------------------------------------

_VECTOR = ["l_quantity", "l_discount"]
_VECTOR_SQL = "WITH f AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem WHERE l_linenumber % 2 = 0), v AS (SELECT l_linestatus, [(l_quantity - mq) / sq, (l_discount - md) / sd, (l_returnflag = 'A')::INT, (l_returnflag = 'N')::INT, (l_returnflag = 'R')::INT] AS x FROM lineitem, f), e AS (SELECT l_linestatus, unnest(range(5)) AS i, unnest(x) AS v FROM v) SELECT l_linestatus, i::INTEGER AS i, " + r("avg(v)") + " AS mean FROM e GROUP BY ALL"


def _vectors(spark: SparkSession, sf_dir: str, replay: bool) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    fitted = prep.fit(rows.filter("l_linenumber % 2 = 0"), _VECTOR, ["l_returnflag"])
    own = prep.Prep.from_dict(fitted.to_dict()) if replay else fitted
    cells = own.transform(rows).select("l_linestatus", F.posexplode("features").alias("i", "v"))
    return rounded(cells.groupBy("l_linestatus", "i").agg(F.avg("v").alias("mean")))


query(_VECTOR_SQL, "feature_vectors")(partial(_vectors, replay=False))
query(_VECTOR_SQL, "feature_vectors_replayed")(partial(_vectors, replay=True))


@query("WITH n AS (SELECT p_brand, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_brand), c AS (SELECT quantile_disc(n, 0.5) AS least FROM n), kept AS (SELECT p_brand FROM n, c WHERE n >= least) SELECT p_partkey, (SELECT string_agg(CASE WHEN kept.p_brand = part.p_brand THEN '1' ELSE '0' END, '' ORDER BY kept.p_brand) FROM kept) || CASE WHEN p_brand NOT IN (SELECT p_brand FROM kept) THEN '1' ELSE '0' END AS code FROM part")
def onehot_rare_bucket(spark, sf_dir):
    """Values seen less often than the median one share a bucket."""
    part = table(spark, sf_dir, "part")
    train = part.filter("p_partkey % 3 <> 0")
    least = train.groupBy("p_brand").count().agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY count)")).first()[0]
    enc = prep.fit_one_hot(train, ["p_brand"], int(least))
    return part.select("p_partkey", F.array_join(F.transform(enc.apply("p_brand"), lambda x: x.cast("int").cast("string")), "").alias("code"))


# Cluster tables -------------------------------------------------------------------------------


@query(f"WITH {_CELLS} SELECT CASE WHEN vec_id % 10 < 6 THEN 'train' ELSE 'test' END AS split, vec_id AS row_index, c AS cluster_id, {r('d')} AS cluster_distance FROM dist")
def cluster_export(spark, sf_dir):
    rows = measured(spark, sf_dir).withColumn("split", F.when(F.col("vec_id") % 10 < 6, "train").otherwise("test"))
    return rounded(cluster.export(rows, "vec_id"))


@query("WITH s AS (SELECT vec_id % 2 AS part, label AS c, count(*) AS n FROM embeddings GROUP BY ALL) SELECT p.part, k.k::INTEGER AS cluster_id, coalesce(n, 0) AS count FROM (VALUES (0), (1)) p(part) CROSS JOIN (SELECT unnest(range(14)) AS k) k LEFT JOIN s ON s.part = p.part AND s.c = k.k")
def cluster_sizes_by_split(spark, sf_dir):
    return cluster.sizes(matrix(spark, sf_dir).withColumn("part", F.col("vec_id") % 2), 14, ["part"])


@query("SELECT label::INTEGER AS cluster_id, count(*) AS count FROM embeddings GROUP BY label")
def cluster_count_validation(spark, sf_dir):
    rows = matrix(spark, sf_dir)
    k = rows.agg(F.max("cluster_id")).first()[0] + 1
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(cluster.checked_counts(rows, k))], "cluster_id int, count bigint")


_SEEDS = "e0 AS (SELECT vec_id, label AS a, vec_id % 7 AS b, (label + vec_id % 2) % 10 AS c FROM embeddings)"


@query(f"WITH {_SEEDS}, {_ami_sql('p', 'e0', 'a', 'b')}, {_ami_sql('q', 'e0', 'a', 'c')}, {_ami_sql('s', 'e0', 'b', 'c')}, v AS (SELECT ami FROM p UNION ALL SELECT ami FROM q UNION ALL SELECT ami FROM s) SELECT {r('avg(ami)')} AS mean_pairwise_stability_ami, {r('min(ami)')} AS min_pairwise_stability_ami, {r('max(ami)')} AS max_pairwise_stability_ami FROM v")
def seed_stability(spark, sf_dir):
    rows = matrix(spark, sf_dir)
    other = {1: rows, 2: rows.withColumn("cluster_id", (F.col("vec_id") % 7).cast("int")), 3: rows.withColumn("cluster_id", ((F.col("cluster_id") + F.col("vec_id") % 2) % 10).cast("int"))}
    found = clustermetrics.stability(other, "vec_id")
    names = ("mean_pairwise_stability_ami", "min_pairwise_stability_ami", "max_pairwise_stability_ami")
    return rounded(spark.createDataFrame([tuple(float(found[n]) for n in names)], ", ".join(f"{n} double" for n in names)))


@query(f"WITH {_CELLS}, v AS (SELECT label AS c, (vec_id % 3)::VARCHAR AS t, count(*) AS k FROM embeddings GROUP BY ALL), m AS (SELECT c, t FROM v QUALIFY row_number() OVER (PARTITION BY c ORDER BY k DESC, t) = 1) SELECT means.c AS cluster_id, max(n) AS weight, {r('sum(m * m)')} AS square, any_value(m.t) AS label FROM means JOIN m ON m.c = means.c GROUP BY means.c")
def centroid_representatives(spark, sf_dir):
    """Mean vectors with their weight and the majority of the target."""
    rows = matrix(spark, sf_dir).withColumn("label", (F.col("vec_id") % 3).cast("string"))
    found = representatives.centroid(rows, "vec_id", Config(targets=("label",)))
    square = F.aggregate("centroid", F.lit(0.0), lambda s, v: s + v * v)
    return rounded(found.select("cluster_id", "weight", square.alias("square"), "label"))


_MIXED = f"WITH {_CELLS}, near AS (SELECT vec_id FROM dist QUALIFY row_number() OVER (PARTITION BY c ORDER BY d, vec_id) = 1), far AS (SELECT vec_id FROM dist QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC, vec_id) <= 5)"


@query(f"{_MIXED} SELECT c AS cluster_id, vec_id, true AS chosen FROM dist WHERE vec_id IN (SELECT vec_id FROM near UNION SELECT vec_id FROM far)")
def mixed_holds_medoids_and_boundary(spark, sf_dir):
    """The medoids and boundary rows, looked up among the mixed representatives."""
    m = measured(spark, sf_dir).withColumn("label", (F.col("vec_id") % 3).cast("string"))
    own = representatives.mixed(m, "vec_id", Config()).select("vec_id", F.lit(True).alias("chosen"))
    fixed = representatives.medoid(m, "vec_id", Config()).select("cluster_id", "vec_id").union(representatives.boundary(m, "vec_id", Config()).select("cluster_id", "vec_id")).distinct()
    return fixed.join(own, "vec_id", "left").select("cluster_id", "vec_id", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query("SELECT 'full' AS strategy, count(*) AS original_n, count(*) AS representative_n, 1.0::DOUBLE AS compression_ratio, 'real_points' AS kind FROM embeddings UNION ALL SELECT 'medoid', count(*), count(DISTINCT label), " + r("count(DISTINCT label) / count(*)") + ", 'real_points' FROM embeddings UNION ALL SELECT 'centroid', count(*), count(DISTINCT label), " + r("count(DISTINCT label) / count(*)") + ", 'synthetic_centroids' FROM embeddings")
def representative_strategies(spark, sf_dir):
    m, rows = measured(spark, sf_dir), []
    for name in ("full", "medoid", "centroid"):
        cfg = Config(representative_strategy=name, targets=())
        rows.append(representatives.metadata(m, representatives.select(m, "vec_id", cfg), cfg))
    names = ("strategy", "original_n", "representative_n", "compression_ratio", "kind")
    return rounded(spark.createDataFrame([tuple(x[n] for n in names) for x in rows], "strategy string, original_n bigint, representative_n bigint, compression_ratio double, kind string"))


@query(f"WITH {_CELLS}, s AS (SELECT c, avg(d) AS s FROM dist GROUP BY c), pr AS (SELECT a.c AS c, b.c AS o, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM means a JOIN means b ON a.i = b.i AND a.c <> b.c GROUP BY a.c, b.c), w AS (SELECT pr.c, max((x.s + y.s) / d) AS r FROM pr JOIN s x ON x.c = pr.c JOIN s y ON y.c = pr.o GROUP BY pr.c), g AS (SELECT i, avg(v) AS g FROM cells GROUP BY i), b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM means JOIN g USING (i)), wi AS (SELECT sum(d * d) AS w, count(*) AS n, count(DISTINCT c) AS k FROM dist) SELECT {r('(SELECT avg(r) FROM w)')} AS davies_bouldin, {r('b * (n - k) / (w * (k - 1))')} AS calinski_harabasz, {r('w')} AS inertia, k AS clusters_observed, '' AS undefined FROM b, wi UNION ALL SELECT NULL, NULL, {r('sum(d1 * d1)')}, 1, 'calinski_harabasz,davies_bouldin,silhouette' FROM (SELECT vec_id, sqrt(sum((v - m1) * (v - m1))) AS d1 FROM cells JOIN (SELECT i, avg(v) AS m1 FROM cells GROUP BY i) USING (i) GROUP BY vec_id)")
def internal_metrics_bundle(spark, sf_dir):
    """All internal metrics of ten clusters, and of one, where three have no value."""
    several = measured(spark, sf_dir)
    one = cluster.with_centroid_distance(matrix(spark, sf_dir).withColumn("cluster_id", F.lit(0)))
    rows = []
    for df in (several, one):
        x = clustermetrics.internal(df, "vec_id", 200)
        rows.append((x["davies_bouldin"], x["calinski_harabasz"], x["inertia"], x["clusters_observed"], ",".join(sorted(x["undefined_reasons"]))))
    return rounded(spark.createDataFrame(rows, "davies_bouldin double, calinski_harabasz double, inertia double, clusters_observed bigint, undefined string"))


# Reports of classifiers -----------------------------------------------------------------------


@query("SELECT 'true_' || q AS truth, count(*) FILTER (t = 0) AS pred_0, count(*) FILTER (t = 1) AS pred_1 FROM (SELECT quality AS q, toxic AS t FROM labels) GROUP BY q")
def confusion_wide(spark, sf_dir):
    return classmetrics.confusion_matrix(_labels(spark, sf_dir))


@query(f"{_PRF}, w AS (SELECT sum(tp) / sum(support) AS acc, sum(support)::BIGINT AS total, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f, sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM f) SELECT class AS name, printf('%.4f', precision) AS precision, printf('%.4f', recall) AS recall, printf('%.4f', f1) AS f1, support FROM f UNION ALL SELECT 'accuracy', '', '', printf('%.4f', acc), total FROM w UNION ALL SELECT 'macro avg', printf('%.4f', p), printf('%.4f', r), printf('%.4f', f), total FROM w UNION ALL SELECT 'weighted avg', printf('%.4f', wp), printf('%.4f', wr), printf('%.4f', wf), total FROM w")
def classification_report(spark, sf_dir):
    """The lines of the report's text."""
    out = []
    for line in classmetrics.report_text(_labels(spark, sf_dir)).splitlines()[1:]:
        words = line.rsplit(None, 2 if "accuracy" in line else 4)
        name, numbers = words[0].strip(), words[1:]
        out.append((name, "", "", numbers[0], int(numbers[1])) if name == "accuracy" else (name, *numbers[:3], int(numbers[3])))
    return spark.createDataFrame(out, "name string, precision string, recall string, f1 string, support bigint")


@query(f"WITH {_SCORES}, k2 AS (SELECT *, lag(tp) OVER w AS t0, lead(tp) OVER w AS t1, lag(fp) OVER w AS f0, lead(fp) OVER w AS f1 FROM c WINDOW w AS (ORDER BY score DESC)) SELECT score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp FROM k2 WHERE t0 IS NULL OR t1 IS NULL OR t0 + t1 <> 2 * tp OR f0 + f1 <> 2 * fp")
def roc_corners(spark, sf_dir):
    return classmetrics.roc_points(_scores(spark, sf_dir)).select("threshold", "tp", "fp")


@query(f"WITH {_SCORES} SELECT 'two' AS classes, {r('sum(pos * (n - fp + (k - pos) / 2)) / max(p * n)')} AS roc_auc, {r('sum(pos / p * tp / (tp + fp))')} AS average_precision FROM c UNION ALL SELECT 'three', NULL, NULL")
def binary_metrics(spark, sf_dir):
    """Scores of two classes by their positive label, and nulls for three."""
    e = labelled(table(spark, sf_dir, "events")).withColumn("kind", F.when(F.col("label") == 1, "attack").otherwise("normal"))
    rows = [("two", classmetrics.binary(e, "kind", "value", ["normal", "attack"])), ("three", classmetrics.binary(e, "event_type", "value", ["a", "b", "c"]))]
    return rounded(spark.createDataFrame([(n, x["roc_auc"], x["average_precision"]) for n, x in rows], "classes string, roc_auc double, average_precision double"))


@query("SELECT DISTINCT l_returnflag AS class, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code, true AS seen FROM lineitem")
def forest_classes(spark, sf_dir):
    """A forest's classes are the sorted training classes, and its probabilities are in their order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.array(*(F.col(c) for c in _NUMERIC)).alias("features"))
    forest = supervised.fit(rows, "label", Config(random_forest_estimators=3, random_forest_max_depth=4))
    scored = forest.predict(rows)
    best = F.array_position("probability", F.array_max("probability"))
    wrong = scored.filter(F.element_at(F.array(*map(F.lit, forest.classes)), best.cast("int")) != F.col("predicted")).count()
    return spark.createDataFrame([(c, i, wrong == 0) for i, c in enumerate(forest.classes)], "class string, code bigint, seen boolean")


# Sources --------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder where all executors can read and write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rivulet-")
    return f"{base.rstrip('/')}/rivulet-tables-{uuid.uuid4().hex}"


@query(f"WITH {_tokens_sql()} SELECT orig_pos, CASE WHEN orig_pos % 3 = 0 THEN 'a/x.csv' ELSE 'b.csv' END AS source_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _TOKENS) + " FROM raw")
def csv_tokens(spark, sf_dir):
    """Cells written as CSV into two files and read back as they are; null and empty both come back empty."""
    folder, rows = _folder(spark), tokens(spark, sf_dir)
    for name, part in (("a/x.csv", rows.filter("orig_pos % 3 = 0")), ("b.csv", rows.filter("orig_pos % 3 <> 0"))):
        part.select(F.col("orig_pos").cast("string").alias("uid"), *_TOKENS).coalesce(1).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{folder}/{name}")
    files = [uri for uri, _ in readers.resolve(spark, f"{folder}")]
    parts = [readers.read_csv(spark, uri).withColumn("source_id", F.lit("a/x.csv" if "/a/x.csv/" in uri else "b.csv")) for uri in files]
    both = parts[0].unionByName(parts[1])
    return both.select(F.col("uid").cast("bigint").alias("orig_pos"), "source_id", *_TOKENS)


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS orig_pos, 'events.parquet' AS source_id, event_type FROM events")
def parquet_rows(spark, sf_dir):
    """Rows of a Parquet file with their place in reading order."""
    raw = readers.with_position(readers.load_raw(spark, f"{sf_dir.rstrip('/')}/events.parquet"))
    return raw.select("event_id", F.col("orig_pos").cast("bigint").alias("orig_pos"), F.col(readers.SOURCE_ID).alias("source_id"), "event_type")
