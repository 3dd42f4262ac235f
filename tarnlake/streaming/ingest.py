"""Incremental loads: files are taken up once each, by a stream that stops when it has them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, transform: Callable[[DataFrame], DataFrame] | None = None, form: str = "parquet") -> int:
    """Append what is new in a folder to a target; the checkpoint knows what was taken. Returns the rows taken."""
    stream = spark.readStream.schema(schema).format(form).load(source)
    rows = transform(stream) if transform else stream
    q = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    q.awaitTermination()
    return sum(int(p["numInputRows"]) for p in q.recentProgress)


def upsert_batches(spark: SparkSession, source: str, checkpoint: str, schema: str, apply: Callable[[DataFrame, int], None], form: str = "parquet") -> None:
    """Hand each batch of new files to a function, which may be called again for a batch after a failure."""
    stream = spark.readStream.schema(schema).format(form).load(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
