"""Session-level helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most bytes and rows of an Arrow batch sent to Python; bounds a worker's memory.
ARROW_BYTES = 4 << 20
ARROW_ROWS = 4096


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, and let its Python workers import this package."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; the session's own setting wins.

    Without a setting only a local session gets a folder of its own: other machines could not see it.
    """
    jsc = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if found is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rivulet-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that written() has made and that are still there.
_made: dict[str, SparkSession] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a wide table as Parquet in the shared folder and read it again.

    Unlike checkpoint() the files are compressed and columns can be pruned.  They are removed by
    settle(), or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rivulet-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def made() -> frozenset[str]:
    """The folders of written() that are there now."""
    return frozenset(_made)


def settle(before: frozenset[str]) -> None:
    """Remove the tables written since then, but for the last one."""
    _remove([p for p in _made if p not in before][:-1])


def _remove(paths: list[str]) -> None:
    for path in paths:
        spark = _made.pop(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    try:
        _remove(list(_made))
    except Exception:  # the JVM may be gone already
        return


class Rows:
    """A table as one struct column ``row``, so that no column name of its own can clash.

    Names are matched exactly, the first if there are several, and may differ in case only.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        plain = docs.toDF(*(f"c{i}" for i in range(len(self.names))))
        self.frame = plain.select(F.struct(*plain.columns).alias("row"))

    def place(self, name: str) -> int:
        return self.names.index(name)

    def column(self, name: str) -> Column:
        return F.col(f"row.c{self.place(name)}")

    def select(self, *names: str) -> DataFrame:
        """These columns alone."""
        return self.frame.select(*(self.column(n).alias(n) for n in names))

    def schema(self, more: str = "") -> StructType:
        """That of ``row`` and further columns."""
        out = StructType([self.frame.schema["row"]])
        return StructType(out.fields + (StructType.fromDDL(more).fields if more else []))

    def unpacked(self, df: DataFrame, **more: Column) -> DataFrame:
        """The table's columns again, and further ones; where a name is taken the table's own column
        gets underscores at its end."""
        used = {n.lower() for n in (*self.names, *more)}
        own = []
        for i, n in enumerate(self.names):
            if n.lower() in {m.lower() for m in more}:
                while n.lower() in used:
                    n += "_"
                used.add(n.lower())
            own.append(F.col(f"row.c{i}").alias(n))
        return df.select(*own, *(c.alias(n) for n, c in more.items()))


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """These columns of a table, whatever else it has."""
    return Rows(docs).select(*names)


def few(df: DataFrame, most: int) -> DataFrame:
    """Broadcast if at most so many rows are counted, else joined by shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.fill_null("").cast(pa.large_string())
    n = len(flat)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + n + 1]
    raw = flat.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's UTF-8 bytes."""
    data, at = buffers(column)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        yield data[lo:hi]


def packs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes (or of one row)."""
    _, at = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
