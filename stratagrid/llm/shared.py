"""Session helpers of the text operators."""

from __future__ import annotations

import math
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key of a text: 128 bits, so that copies of a text and repeated rows share their results.
KEY = ["k1", "k2"]
#: Rows in an Arrow batch; with whole documents the usual 10,000 would be hundreds of megabytes.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; where that is unset, a temporary one if all is one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: this cuts the lineage and outlives executors.

    files: for tables of few small rows, so that they are not dealt over a file for each of many partitions.
    """
    path = new_folder(df.sparkSession, name)
    (df.repartition(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Before Python runs on executors: small Arrow batches, and this package's source where they can import it."""
    sc = spark.sparkContext
    if not getattr(sc, "_package_sent", False):
        root = pathlib.Path(__file__).resolve().parents[1]
        path = f"{tempfile.mkdtemp(prefix='package-')}/{root.name}-{os.getpid()}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in root.rglob("*.py"):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(path)
        sc._package_sent = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("key"), text).alias("k2")]


#: Rows that a key has in one task, and keys that are dealt over several tasks, at most.
HOT_ROWS, HOT_KEYS, HOT_WAYS = 1000, 1000, 4096


def hot_keys(counted: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, ways) of the HOT_KEYS keys with the most rows, over HOT_ROWS each, from (keys, n); None if there are none.

    At most HOT_KEYS rows, whatever the table: any other key has under a thousandth of all rows.
    """
    top = counted.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), *keys).limit(HOT_KEYS).select(*keys, F.least(F.ceil(F.col("n") / HOT_ROWS), F.lit(HOT_WAYS)).cast("int").alias("ways"))
    found = materialise(top, "hot-keys")
    return found if found.head(1) else None


def join_spread(rows: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "left") -> DataFrame:
    """rows.join(small, keys, how), with rows of a hot key dealt over its ways and small's rows of it repeated for each."""
    if hot is None:
        return rows.join(small, keys, how)
    few = F.broadcast(hot)  # at most HOT_KEYS rows
    left = rows.join(few, keys, "left").withColumn("_way", F.coalesce(F.floor(F.rand(7) * F.col("ways")).cast("int"), F.lit(0))).drop("ways")
    right = small.join(few, keys, "left").withColumn("_way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")
    return left.join(right, [*keys, "_way"], how).drop("_way")


def hot_texts(keyed: DataFrame) -> DataFrame | None:
    """hot_keys of the texts in a table that has their KEY."""
    return hot_keys(keyed.groupBy(*KEY).agg(F.count("*").alias("n")), KEY)


def text_bytes(docs: DataFrame, text: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(text).cast("long"))).head()[0] or 0)


def parts(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
