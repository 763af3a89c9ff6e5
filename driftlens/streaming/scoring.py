"""Model outputs that arrive as files, scored as they come.

Fitted row-wise scorers are stateless projections, so the stream needs no watermark or state; the
checkpoint and the file sink make each output row appear once, also after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftlens.operators.detectors.base import Scorer


def score_stream(outputs: DataFrame, scorer: Scorer, path: str, checkpoint: str) -> StreamingQuery:
    """Append the scores of a streaming frame to a Parquet table; stops once the available input is done."""
    return (
        scorer.transform(outputs)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
