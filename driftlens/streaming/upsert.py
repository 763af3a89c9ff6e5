"""Streams into record tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftlens.sources.bucketed import BUCKETS, BucketedRecords


def upsert_stream(rows: DataFrame, root: str, keys: Sequence[str], checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Upsert a streaming frame into bucketed records, one merge per micro-batch; stops once the available input is done.

    A micro-batch that runs again after a restart has its old number and is merged once. The checkpoint belongs to the records: a new
    one over the same records would begin to number anew, and raises.
    """

    def merge(batch: DataFrame, number: int) -> None:
        BucketedRecords(batch.sparkSession, root, buckets).merge(batch, keys, number)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
