"""Scoring an unbounded table with a saved bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foldline.sources.bundle import Bundle, score_batch


def score_stream(bundle: Bundle, stream: DataFrame) -> DataFrame:
    """The batch scoring on a streaming table; stateless, so no watermark is needed."""
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming table")
    return score_batch(bundle, stream)


def write_available(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Score what has arrived, append it as Parquet and stop; a rerun goes on where it ended."""
    return (
        scored.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
