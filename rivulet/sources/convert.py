"""CSV to Parquet with one schema for all partitions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.contract import recognised
from rivulet.functions import scalar as S
from rivulet.operators.normalize import normalize
from rivulet.sources.readers import header, read_csv, resolve
from rivulet.sources.sinks import write_json, write_table

_ORDER = ("bigint", "double", "string")


def families(df: DataFrame) -> dict[str, str]:
    """The narrowest of bigint, double and string that holds each column's tokens, in one pass."""
    checks = []
    for c in df.columns:
        x, col = S.number(F.col(f"`{c}`"), "string"), F.col(f"`{c}`")
        empty = col.isNull() | (col == "")
        checks += [F.coalesce(F.bool_and(empty | x.isNotNull()), F.lit(True)), F.coalesce(F.bool_and(empty | F.coalesce((x % 1 == 0) & (F.abs(x) <= 2**53), F.lit(False))), F.lit(True)), F.coalesce(F.bool_and(empty), F.lit(True))]
    row = df.agg(*checks).first()
    return {c: "string" if not row[3 * i] or row[3 * i + 2] else "bigint" if row[3 * i + 1] else "double" for i, c in enumerate(df.columns)}


def common(schemas: list[dict[str, str]]) -> dict[str, str]:
    """Union of the columns; of several families the widest: string over double over bigint."""
    out: dict[str, str] = {}
    for s in schemas:
        for name, kind in s.items():
            out[name] = max(out.get(name, kind), kind, key=_ORDER.index)
    return out


def align(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Missing columns become null, the order is the schema's, values are coerced."""
    return df.select(*(F.col(f"`{c}`").try_cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in schema.items()))


def convert(spark: SparkSession, source: str, target: str, compression: str = "zstd", overwrite: bool = False) -> dict:
    """One Parquet table for each CSV, a .schema.json beside it, and _conversion_manifest.json.

    Files of the flow contract are normalised strictly: an invalid token fails the conversion.
    Others share the narrowest common schema.
    """
    files = [(uri, name) for uri, name in resolve(spark, source) if name.endswith(".csv")]
    if not files:
        raise FileNotFoundError(f"no CSV under {source}")
    out, strict = Path(target), {recognised(header(spark, uri)) for uri, _ in files}
    if len(strict) > 1:
        raise ValueError("files with and without the flow signature can't be mixed")
    frames = {name: read_csv(spark, uri) for uri, name in files}
    shared = None if strict == {True} else common([families(f) for f in frames.values()])
    manifest = {"compression": compression, "files": []}
    for name, frame in frames.items():
        path = out / name.replace(".csv", ".parquet")
        if path.exists() and not overwrite:
            raise FileExistsError(path)
        done = normalize(frame)[0] if shared is None else align(frame.select(*(F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in frame.columns)), shared)
        write_table(done, str(path), compression)
        write_json(f"{path}.schema.json", dict(done.dtypes))
        manifest["files"].append({"source": name, "target": path.name, "rows": spark.read.parquet(str(path)).count(), "columns": len(done.columns)})
    write_json(out / "_conversion_manifest.json", manifest)
    return manifest
