"""Ordered file resolution, scans that keep tokens and row identity, and the synthetic table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.contract import recognised

#: Columns that readers add: place of the file, its relative name, row in the file.
FILE_NO, SOURCE_ID, FILE_ROW = "_file_no", "_source_id", "_file_row"


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def resolve(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(uri, name relative to the root) of the input files, in reading order.

    A glob gives its matches sorted; a directory its *.csv and then its *.parquet, at any depth;
    a file itself.  Anything else raises FileNotFoundError.  Works on every store Spark can read.
    """
    where, fs = _hadoop(spark, path)
    if any(c in path for c in "*?["):
        found = sorted(s.getPath().toString() for s in fs.globStatus(where) or [])
        if not found:
            raise FileNotFoundError(path)
        return [(f, f.rsplit("/", 1)[1]) for f in found]
    if not fs.exists(where):
        raise FileNotFoundError(path)
    status = fs.getFileStatus(where)
    root = status.getPath().toString()
    if status.isFile():
        return [(root, root.rsplit("/", 1)[1])]
    listing, files = fs.listFiles(where, True), []
    while listing.hasNext():
        files.append(listing.next().getPath().toString())
    own = [(f, f[len(root) :].lstrip("/")) for f in files]
    out = [x for end in (".csv", ".parquet") for x in sorted(own, key=lambda x: x[1]) if x[1].endswith(end)]
    if not out:
        raise FileNotFoundError(f"no CSV or Parquet under {path}")
    return out


def header(spark: SparkSession, uri: str) -> list[str]:
    """Column names of one file; a byte-order mark is dropped and repeated names are refused."""
    if uri.endswith(".parquet"):
        return spark.read.parquet(uri).columns
    first = spark.read.text(uri).first()
    names = spark.createDataFrame([(first[0].lstrip("﻿") if first else "",)], "h string").select(F.from_csv("h", ", ".join(f"c{i} string" for i in range((first[0] if first else "").count(",") + 1)))).first()[0]
    out = [x or "" for x in names]
    if len(set(out)) < len(out):
        raise ValueError(f"{uri}: repeated column names")
    return out


def read_csv(spark: SparkSession, uri: str, tokens: bool = True) -> DataFrame:
    """With tokens every column is the raw string, and empty fields stay empty strings."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    if not tokens:
        return reader.option("inferSchema", True).csv(uri)
    names = header(spark, uri)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return reader.schema(schema).option("nullValue", "\x00null").option("emptyValue", "").option("enforceSchema", True).csv(uri).select(*(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names))


def read_file(spark: SparkSession, uri: str, number: int, source_id: str) -> DataFrame:
    """One file with its identity columns.

    The row in the file is Parquet's own row index.  A CSV file has none, so its rows are numbered
    by (partition, place in it), counted partition by partition.
    """
    if uri.endswith(".parquet"):
        plain = spark.read.parquet(uri)
        row = plain.select("*", F.col("_metadata.row_index").alias(FILE_ROW))
    else:
        row = number_rows(read_csv(spark, uri, recognised(header(spark, uri))), FILE_ROW)
    return row.select(F.lit(number).alias(FILE_NO), F.lit(source_id).alias(SOURCE_ID), "*")


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """0-based places in reading order, without a window over all rows.

    monotonically_increasing_id holds the partition and the place in it; the rows before a
    partition come from a table with one row for each partition.
    """
    spread = df.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright("_mid", 33)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = spread.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid", "_part", "_before")


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    """All files with identity columns; columns are the union of the headers.

    Files of the flow contract and others can't be mixed.
    """
    files = resolve(spark, path)
    kinds = {recognised(header(spark, uri)) for uri, _ in files}
    if len(kinds) > 1:
        raise ValueError("files with and without the flow signature can't be mixed")
    parts = [read_file(spark, uri, i, name) for i, (uri, name) in enumerate(files)]
    if len(parts) > 1:  # the widest type that all share, else strings
        kinds_of: dict[str, set[str]] = {}
        for p in parts:
            for name, kind in p.dtypes:
                kinds_of.setdefault(name, set()).add(kind)
        mixed = {n: "double" if k <= {"double", "float", "int", "bigint", "smallint", "tinyint"} else "string" for n, k in kinds_of.items() if len(k) > 1}
        parts = [p.withColumns({n: F.col(f"`{n}`").cast(k) for n, k in mixed.items() if n in p.columns}) if mixed else p for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_position(df: DataFrame, name: str = "orig_pos") -> DataFrame:
    """The row's place over all files, gaps kept: its file's offset and its row in the file."""
    sizes = df.groupBy(FILE_NO).agg((F.max(FILE_ROW) + 1).alias("_n"))
    offsets = sizes.select(FILE_NO, F.coalesce(F.sum("_n").over(Window.orderBy(FILE_NO).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return df.join(F.broadcast(offsets), FILE_NO).withColumn(name, F.col("_offset") + F.col(FILE_ROW)).drop("_offset")


def with_eligible_position(kept: DataFrame, position: str = "orig_pos", name: str = "elig_pos", block: int = 1 << 20) -> DataFrame:
    """Dense places of the rows left after quarantine: rows of earlier blocks, then within a block."""
    rows = kept.withColumn("_block", F.floor(F.col(position) / block))
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(position)) - 1
    return rows.join(F.broadcast(before), "_block").withColumn(name, F.col("_before") + inside).drop("_block", "_before")


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows that depend on the seed and the key only."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def synthetic(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """A made-up flow table of 21 columns and n rows; every value is a hash of (seed, row).

    It has the columns of the debugging table but, on purpose, not the counters that the strict
    feature policy asks for.
    """

    def draw(name: str, size: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(size))

    def pick(name: str, *values: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (draw(name, len(values)) + 1).cast("int"))

    def unit(name: str) -> Column:
        return (draw(name, 1_000_000) + 0.5) / 1_000_000

    def skewed(name: str, scale: float) -> Column:
        return -F.log(unit(name)) * scale

    attack = draw("label", 10) < 4
    rows = spark.range(n).select(
        "id",
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 60_000_000).alias("timestamp"),
        F.lit("synthetic_debug").alias("dataset_id"),
        F.concat(F.lit("10.0.0."), draw("src", 20).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.1."), draw("dst", 20).cast("string")).alias("dst_ip"),
        (draw("sport", 64511) + 1024).alias("src_port"),
        pick("dport", "53", "80", "443", "22").cast("bigint").alias("dst_port"),
        pick("proto", "tcp", "udp", "icmp").alias("proto"),
        pick("service", "http", "dns", "ssl", "-").alias("service"),
        F.when(attack, pick("state", "S0", "REJ", "SF")).otherwise("SF").alias("conn_state"),
        pick("flags", "S", "SA", "FA", "R").alias("tcp_flags"),
        skewed("duration", 2.0).alias("duration"),
        F.floor(F.when(attack, skewed("sb", 4000.0)).otherwise(skewed("sb", 800.0))).cast("bigint").alias("src_bytes"),
        F.floor(skewed("db", 1500.0)).cast("bigint").alias("dst_bytes"),
        (F.floor(F.when(attack, skewed("sp", 30.0)).otherwise(skewed("sp", 8.0))) + 1).cast("bigint").alias("src_pkts"),
        (F.floor(skewed("dp", 8.0)) + 1).cast("bigint").alias("dst_pkts"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("flow_id"),
        F.sha1(F.concat_ws(":", F.lit(seed), "id")).alias("uid"),
        attack.cast("bigint").alias("label"),
        F.when(attack, pick("kind", "ddos", "scanning", "injection")).otherwise("normal").alias("type"),
    )
    ratio = lambda a, b: F.col(a) / (F.col(b) + 1)
    return rows.drop("id").withColumn("byte_ratio", ratio("src_bytes", "dst_bytes")).withColumn("pkt_ratio", ratio("src_pkts", "dst_pkts"))
