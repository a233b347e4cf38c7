"""How scattered a file's chunk index is: gaps and islands over logs of block reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .facts import ID

BLOCK = 1 << 20


def locality(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """(collection_id, granule_id, n_blocks, n_fetches, runs, leading, span) of (collection_id, granule_id, block_idx,
    file_bytes), a row for each read. Leading is the share of blocks in the first twentieth of the file, one at least."""
    keys = [ID, "granule_id"]
    seen = log.groupBy(*keys, "block_idx").agg(F.count("*").alias("reads"), F.max("file_bytes").alias("file_bytes"))
    before = F.lag("block_idx").over(Window.partitionBy(*keys).orderBy("block_idx"))
    total = F.greatest(F.floor(F.col("file_bytes") / block), F.lit(1)).cast("long")
    head = F.greatest(F.floor(total * 0.05), F.lit(1)).cast("long")
    seen = seen.withColumn("starts", F.coalesce(F.col("block_idx") != before + 1, F.lit(True)))
    out = seen.groupBy(*keys).agg(
        F.count("*").alias("n_blocks"), F.sum("reads").alias("n_fetches"), F.count_if("starts").alias("runs"),
        F.count_if(F.col("block_idx") < head).alias("early"), (F.max("block_idx") - F.min("block_idx") + 1).alias("reach"), F.max(total).alias("total"),
    )
    return out.select(*keys, "n_blocks", "n_fetches", "runs", (F.col("early") / F.col("n_blocks")).alias("leading"), (F.col("reach") / F.col("total")).alias("span"))
