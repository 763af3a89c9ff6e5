"""Records in hash buckets, so that a merge reads and writes only buckets with new keys.

A merge writes its buckets to a folder of its own and names them in a commit, which is written last: readers take each bucket from its latest
commit. A merge that was cut off has no commit and leaves no trace; one that is repeated under its number is done once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.session import materialize
from driftlens.sources.records import merge_records

BUCKETS = 64


class BucketedRecords:
    """A record table at `root`. `buckets` is fixed by the first merge; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _commits(self) -> list:
        """(batch, bucket, buckets of the table), bounded by merges and buckets."""
        try:
            return self.spark.read.parquet(f"{self.root}/commits").select("batch", "bucket", "buckets").collect()
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []

    def current(self) -> dict[int, int]:
        """The batch that holds each bucket."""
        found: dict[int, int] = {}
        for row in self._commits():
            if row.bucket is not None:
                found[row.bucket] = max(row.batch, found.get(row.bucket, -1))
        return found

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """All records, or those of some buckets; None where there are none."""
        held = {b: batch for b, batch in self.current().items() if buckets is None or b in buckets}
        if not held:
            return None
        paths = [f"{self.root}/data/batch={batch}/bucket={b}" for b, batch in sorted(held.items())]
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    def merge(self, new: DataFrame, keys: Sequence[str], batch: int | None = None) -> bool:
        """Upsert by keys; a new row replaces the old one as a whole, columns that only the old ones have stay.

        Of new rows with the same key the greatest one is taken. Batch numbers ascend (None: the next one); a number that is committed
        already is not done again, and the answer is False.
        """
        commits = self._commits()
        done = {row.batch for row in commits}
        batch = max(done, default=-1) + 1 if batch is None else batch
        if batch in done:
            return False
        if done and batch < max(done):
            raise ValueError(f"batch {batch} comes after {max(done)}")
        buckets = commits[0].buckets if commits else self.buckets
        values = [c for c in new.columns if c not in keys]
        one = new.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_row")).select(*keys, "_row.*") if values else new.distinct()
        # Keys are bucketed as text, as the same key may be an int here and a long there.
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")
        one = materialize(one)
        touched = [r[0] for r in one.select(bucket).distinct().collect()]
        old = self.read(touched)
        merged = one if old is None else merge_records(old, one, *keys)
        merged = merged.withColumn("bucket", bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/batch={batch}")
        rows = [(b, buckets) for b in touched] or [(None, buckets)]
        commit = self.spark.createDataFrame(rows, "bucket int, buckets int").coalesce(1)
        commit.write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch}")
        return True
