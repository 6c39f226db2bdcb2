"""Scoring of arriving samples with saved models.

Every transform of this library that depends on fitted numbers only is row-local, so the same
call works on a streaming DataFrame: no state, no watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import ensure_checkpoint_dir


def sample_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None,
                  files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream of a Parquet table, which is one file or a folder of files."""
    # a pattern: the stream takes a plain path for a folder
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{{{name}}}")


def score_stream(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chain fitted transforms: preprocessing first, the model last."""
    for step in steps:
        stream = step(stream)
    return stream


def write_scores(scored: DataFrame, path: str, name: str, available_now: bool = False,
                 every: str = "30 seconds") -> StreamingQuery:
    """Append scores to Parquet; progress is kept in the shared checkpoint folder, so a restarted
    query goes on where it stopped and each sample is written once."""
    checkpoint = f"{ensure_checkpoint_dir(scored.sparkSession).rstrip('/')}/stream-{name}"
    writer = scored.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start(path)
