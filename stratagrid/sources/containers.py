"""Files as tables: container signatures, cache sizes, and a table written and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s

HEAD = 8


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        heads = []
        for path in b.column("path").to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                heads.append(f.read(HEAD))
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(heads, pa.binary())], ["path", "length", "head"])


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, container) of each file under path. Of a file HEAD bytes are read, whatever its size; empty files
    are not listed."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")  # contents are not read
    f = listed.mapInArrow(_heads, "path string, length bigint, head binary")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), s.sniff(F.col("head")).alias("container"))


def cache_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes under path; contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def intact(ranges: DataFrame) -> DataFrame:
    """Cached ranges (url_key, start, size, data) whose data is whole; a torn one is a miss."""
    return ranges.where(F.octet_length("data") == F.col("size"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all machines share; a temporary one where none is set and all is one machine (tests)."""
    shared, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not shared and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    shared = shared or "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again: for tables that many branches of a plan read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def round_trip(df: DataFrame, by: str) -> DataFrame:
    """df as it comes back from a table partitioned by a column."""
    path = scratch(df.sparkSession, "roundtrip")
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
