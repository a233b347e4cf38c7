"""End to end: probe files to a ranked, graded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnosis, facts, grading
from ..operators.criteria import Archive
from ..sources import records
from ..sources.containers import settled


def archive_of(docs: DataFrame) -> Archive:
    """The tables of probe documents; optional ones are made only of what granules recorded."""
    g = records.granules(docs)
    return Archive(
        g, records.arrays(g), coords=records.coordinates(g), tiffs=records.tiles(g), locality=records.block_statistics(g),
        levels=docs.select(F.col("short_name").alias("collection_id"), "level").distinct(), attributes=records.grid_attributes(g), materialised=records.stores(g),
    )


def assess(docs: DataFrame) -> DataFrame:
    """collection_id, a struct (status, note) by criterion, grade, blocker. Facts are stored in the shared folder first."""
    return grading.grade(grading.wide(grading.verdicts(archive_of(docs).settle(settled), settled)))


def score(spark: SparkSession, probes: str, inventory: str, diagnoses: str | None = None) -> DataFrame:
    """The ranking. A probed collection that the inventory lacks is an error, raised when the plan runs."""
    docs = records.probes(spark, probes)
    graded = assess(docs)
    if diagnoses is not None:
        graded = grading.starred(graded, diagnosis.reader_gaps(records.diagnoses(spark, diagnoses)))
    catalog = records.inventory(spark, inventory).withColumnRenamed("short_name", facts.ID)
    joined = graded.join(catalog, facts.ID, "left")
    known = F.when(F.col("sensor").isNull(), F.raise_error(F.concat(F.lit("no inventory row for "), facts.ID))).otherwise(F.col("sensor"))
    return grading.ranking(joined.withColumn("sensor", known), "sensor", facts.ID)
