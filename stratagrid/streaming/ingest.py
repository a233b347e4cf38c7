"""Incremental ingest of probe rows. An extension: the batch operators need none of it.

New rows are appended to a table unless the same (collection, digest) is on record, so a stream that is started again, or
a batch that is run twice, adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sampling import resume


def append_new(batch: DataFrame, path: str) -> None:
    """Append the rows of a batch whose (collection_id, digest) the table at path does not have."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["collection_id", "digest"])
    try:
        done = spark.read.schema(batch.schema).parquet(path).select("collection_id", "digest")
    except Exception as e:  # the table's first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    (fresh if done is None else resume(fresh, done)).write.mode("append").parquet(path)


def ingest(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str) -> StreamingQuery:
    """Read JSON lines with collection_id and digest as they arrive in source, and append the new ones to path."""
    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.foreachBatch(lambda batch, _: append_new(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
