"""Writing results: ranked tables, JSON by collection, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports


def ranked_csv(df: DataFrame, path: str, *order) -> None:
    """One ordered file with a header; for results of one row for each collection."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def json_by(df: DataFrame, path: str, key: str) -> None:
    """A folder of JSON lines for each value of key. Rows are dealt out by key first, so each folder has one file."""
    df.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).json(path)


def markdown(df: DataFrame, path: str, columns: list[str]) -> None:
    """A table as text: head, rule, rows in df's order. For tables that people read, which one task can hold."""
    spark = df.sparkSession
    head = spark.createDataFrame([(i - 2, x) for i, x in enumerate(reports.markdown_head(columns))], "place bigint, line string")
    rows = reports.markdown_rows(df, columns).withColumn("place", F.monotonically_increasing_id())
    head.unionByName(rows.select("place", "line")).orderBy("place").select("line").coalesce(1).write.mode("overwrite").text(path)
