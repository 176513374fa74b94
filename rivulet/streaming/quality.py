"""Quarantine and schema checks over a stream of flow files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rivulet.operators import audit, quality


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive; the schema is given, as a stream can't infer it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def eligible(stream: DataFrame) -> DataFrame:
    """The stream without the known corruption: a stateless filter."""
    return quality.eligible(stream)


def target_windows(stream: DataFrame, time: str, target: str, width: str, late: str) -> DataFrame:
    """Eligible rows by event-time window and target; rows later than the watermark drop out."""
    kept = quality.eligible(stream) if "src_bytes" in stream.columns else stream
    return kept.withWatermark(time, late).groupBy(F.window(time, width), F.col(target)).agg(F.count("*").alias("count"))


def audit_batches(stream: DataFrame, columns: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Write the column audit of every micro-batch, once, under batch=<id>.

    A batch that is repeated after a failure replaces its own folder, so results stay exactly-once.
    """

    def write(batch: DataFrame, number: int) -> None:
        audit.by_column(batch, columns).withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
