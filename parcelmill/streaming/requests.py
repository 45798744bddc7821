"""Scoring of what-if houses as they arrive (each request is scored on its own, no state)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from parcelmill.plans.serving import score_requests


def request_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def score_stream(model: PipelineModel, requests: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write predictions of all requests that have arrived, then stop."""
    return (
        score_requests(model, requests)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
