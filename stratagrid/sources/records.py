"""Probe, diagnosis and inventory files as tables with fixed schemas: a missing field has the meaning that its default says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s

VAR = (
    "struct<name: string, overview: boolean, shape: array<bigint>, chunks: array<bigint>, dtype: string, codecs: array<string>, dims: array<string>, "
    "n_chunks: bigint, chunk_bytes_median: double, chunk_bytes_max: double, cf: map<string, string>, grid: map<string, string>>"
)
OUTCOME = "struct<ok: boolean, error: string>"
PROBE = (
    "struct<granule_ur: string, url: string, begin_time: string, orbit: string, revision_date: string, ok: boolean, attempted: boolean, error_type: string, error: string, "
    "container: string, file_bytes: bigint, dmrpp: boolean, seconds: double, "
    "locality: struct<n_blocks: bigint, n_fetches: bigint, contiguous_runs: bigint, leading_fraction: double, span_fraction: double>, "
    f"vars: array<{VAR}>, root_attrs: map<string, string>, tiff_grid: struct<crs: string, tiepoint: array<double>, pixel_scale: array<double>>, "
    "coords: map<string, struct<n: bigint, first: double, step: double, last: double, error: string>>, "
    f"materialize: struct<dataset: {OUTCOME}, datatree: {OUTCOME}>>"
)
PROBES = f"sensor string, version string, level string, format string, daac string, short_name string, sample_digest string, probes array<{PROBE}>"
INVENTORY = "sensor string, short_name string, version string, level string, format string, daac string, s3_bucket string, s3_region string, instrument string, granules bigint, time_begin date, time_end string, entry_title string"
FINDINGS = (
    "struct<unencodable_fill_values: array<struct<dataset: string, dtype: string, reason: string>>, multi_scale_axes: array<struct<dataset: string, axis: bigint, n_scales: bigint>>, "
    "unfixed_dtypes: array<struct<dataset: string, dtype: string>>, filters: map<string, bigint>, n_datasets: bigint, "
    "scientific_data_tags: struct<contiguous: bigint, extension_types: map<string, bigint>, chunked_elements: struct<total_chunks: bigint, codecs: map<string, bigint>>, "
    "compressed_elements: struct<codecs: map<string, bigint>>>, all_stored: boolean>"
)
DIAGNOSES = f"short_name string, format string, diagnoses array<struct<url: string, error_type: string, error: string, n_like_this: bigint, container: string, findings: {FINDINGS}>>"


def inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=INVENTORY, dateFormat="yyyy-MM-dd")


def written_on(spark: SparkSession, path: str) -> DataFrame:
    """(written_on): the day on which the newest file under path was written, in the session's time zone."""
    return spark.read.format("binaryFile").load(path).agg(F.date_format(F.max("modificationTime"), "yyyy-MM-dd").alias("written_on"))


def probes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each collection's file; path may be a folder or a glob."""
    return spark.read.schema(PROBES).option("multiLine", True).json(path)


def granules(docs: DataFrame) -> DataFrame:
    """A row for each granule: collection_id, level, gi, granule_id and the probe's fields; attempted defaults to true, ok to
    false, error and its type to empty text."""
    rows = docs.select(F.col("short_name").alias("collection_id"), "level", F.posexplode("probes").alias("gi", "p"))
    kept = [f for f in docs.schema["probes"].dataType.elementType.names if f not in ("ok", "attempted", "error_type", "error")]
    return rows.select(
        "collection_id", "level", F.col("gi").cast("long").alias("gi"), F.concat_ws("#", "collection_id", "gi").alias("granule_id"), *(F.col(f"p.{f}") for f in kept),
        s.opened(F.col("p.ok")).alias("ok"), s.attempted(F.col("p.attempted")).alias("attempted"), F.coalesce("p.error_type", F.lit("")).alias("error_type"), F.coalesce("p.error", F.lit("")).alias("error"),
    )


def arrays(g: DataFrame) -> DataFrame:
    """A row for each array of opened granules."""
    return g.where("ok").select("collection_id", "granule_id", "gi", F.posexplode("vars").alias("vi", "v")).select("collection_id", "granule_id", "gi", F.col("vi").cast("long").alias("vi"), "v.*")


def coordinates(g: DataFrame) -> DataFrame:
    each = g.where("ok").select("collection_id", "granule_id", "gi", F.explode("coords").alias("name", "c"))
    return each.select("collection_id", "granule_id", "gi", "name", F.col("c.first").alias("first_v"), F.col("c.step").alias("step_v"), F.col("c.n").alias("n"))


def tiles(g: DataFrame) -> DataFrame:
    t = g.where("ok AND tiff_grid IS NOT NULL")
    tied = F.size("tiff_grid.tiepoint") >= 5
    at = lambda i: F.when(tied, F.get("tiff_grid.tiepoint", F.lit(i)))
    return t.select("collection_id", "granule_id", "gi", F.col("tiff_grid.crs").alias("crs"), at(3).alias("x0"), at(4).alias("y0"), F.get("tiff_grid.pixel_scale", F.lit(0)).alias("px"), F.col("tiff_grid.pixel_scale").alias("scale"))


def block_statistics(g: DataFrame) -> DataFrame:
    """What each granule's reader recorded, for granules that failed too."""
    return g.where("locality IS NOT NULL").select("collection_id", "granule_id", F.col("locality.n_blocks").alias("n_blocks"), F.col("locality.contiguous_runs").alias("runs"), F.col("locality.leading_fraction").alias("leading"))


def grid_attributes(g: DataFrame) -> DataFrame:
    own = arrays(g).select("collection_id", F.explode("grid").alias("key", "value"))
    return own.unionByName(g.where("ok").select("collection_id", F.explode("root_attrs").alias("key", "value")))


def stores(g: DataFrame) -> DataFrame:
    m = g.where("ok AND materialize IS NOT NULL")
    return m.select("collection_id", "gi", F.col("materialize.dataset.ok").alias("dataset_ok"), F.col("materialize.datatree.ok").alias("datatree_ok"), F.col("materialize.dataset.error").alias("error"))


def diagnoses(spark: SparkSession, path: str) -> DataFrame:
    """Diagnosis files as the table that diagnosis.reader_gaps takes."""
    d = spark.read.schema(DIAGNOSES).option("multiLine", True).json(path).select(F.col("short_name").alias("collection_id"), F.posexplode("diagnoses").alias("pos", "d"))
    f, sd = F.col("d.findings"), F.col("d.findings.scientific_data_tags")
    n = lambda x: F.greatest(F.size(x), F.lit(0))
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    compressed = F.aggregate(F.coalesce(F.map_values(sd["compressed_elements"]["codecs"]), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(
        "collection_id", "pos", F.col("d.container").alias("container"), f.isNotNull().alias("has_findings"), f["n_datasets"].alias("n_datasets"), n(f["unencodable_fill_values"]).alias("n_bad_fills"),
        n(f["multi_scale_axes"]).alias("n_multi_scale"), n(f["unfixed_dtypes"]).alias("n_unfixed"), keys(f["filters"]).alias("filters"), F.array_union(keys(sd["chunked_elements"]["codecs"]), keys(sd["compressed_elements"]["codecs"])).alias("codecs"),
        F.coalesce(sd["chunked_elements"]["total_chunks"], F.lit(0)).alias("n_chunks"), compressed.alias("n_compressed"), F.coalesce(sd["contiguous"], F.lit(0)).alias("n_contiguous"), keys(sd["extension_types"]).alias("extensions"), f["all_stored"].alias("all_stored"),
    )
