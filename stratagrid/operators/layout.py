"""Layout records from nested descriptions: groups, pages, coordinates, attributes, datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from .facts import ID

# Attributes that a probe keeps, containers and their readers, and how many coordinates it reads.
KEPT_ATTRIBUTES = ["scale_factor", "add_offset", "_FillValue", "units", "missing_value", "calendar"]
READERS = {"hdf5": "hdf", "netcdf3": "netcdf3", "tiff": "tiff", "hdf4": "hdf4"}
NO_READER = "ASCII HGT SHAPEFILE CSV PDF PNG JPEG KML KMZ BINARY".split()
COORDINATES_READ, COORDINATE_GRANULES = 6, 2


def flatten_groups(nodes: DataFrame) -> DataFrame:
    """(file, path) of arrays from nodes (file, id, parent, name, is_array): names from the root on, joined by slashes.

    One join by level; groups nest a few levels deep. A node whose parent is missing is left out, as is a root.
    """
    level = nodes.where("parent IS NULL").select("file", "id", F.lit("").alias("path"))
    out = level.limit(0).select("file", "path")
    while level.head(1):
        below = nodes.join(level.select("file", F.col("id").alias("parent"), F.col("path").alias("up")), ["file", "parent"])
        below = below.select("file", "id", "is_array", F.when(F.col("up") == "", F.col("name")).otherwise(F.concat_ws("/", "up", "name")).alias("path"))
        out = out.unionByName(below.where("is_array").select("file", "path"))
        level = below.where("NOT is_array").select("file", "id", "path")
    return out


def page_names(place: Column) -> Column:
    """The first page is the band, the others are overviews."""
    return F.when(place == 0, "band").otherwise(F.concat(F.lit("overview"), place.cast("string")))


def kept_attributes(attributes: Column) -> Column:
    return F.map_filter(attributes, lambda k, _: k.isin(KEPT_ATTRIBUTES))


def reader_for(container: Column, declared: Column) -> Column:
    """The reader of a container; none where the declared format rules it out or the container is not known."""
    out = F.lit("none")
    for kind, reader in READERS.items():
        out = F.when(container == kind, reader).otherwise(out)
    return F.when(F.upper(declared).isin(NO_READER), "none").otherwise(out)


def coordinate_granules(granules: DataFrame) -> DataFrame:
    """The first and last of each sample: those whose coordinate values are read."""
    ends = granules.groupBy(ID).agg(F.min("gi").alias("lo"), F.max("gi").alias("hi"))
    return granules.join(ends, ID).where("gi = lo OR gi = hi").drop("lo", "hi")


def read_coordinates(values: DataFrame) -> DataFrame:
    """(collection_id, granule_id, name, n, first_v, step_v, last_v) of values (collection_id, granule_id, vi, name, x): one
    axis of two values or more, at most one group deep, named as a coordinate; the first six of a granule."""
    n = F.size("x")
    fit = values.where((n >= 2) & s.leaf(F.col("name")).isin(s.PROBED_COORDINATES) & (F.size(F.split("name", "/")) <= 2))
    first = fit.groupBy(ID, "granule_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("vi", "name", "x"))), 1, COORDINATES_READ).alias("c")).select(ID, "granule_id", F.explode("c").alias("c"))
    x = F.col("c.x")
    return first.select(ID, "granule_id", "c.name", F.size(x).cast("long").alias("n"), x[0].alias("first_v"), (x[1] - x[0]).alias("step_v"), F.element_at(x, -1).alias("last_v"))


def dataset_census(datasets: DataFrame, key: str) -> DataFrame:
    """key, n_datasets, n_bad_fills, n_multi_scale, n_unfixed, filters (sorted names and counts) of (key, fill_kind, max_scales,
    dtype_kind, filters): what a chunk manifest cannot express in a file's arrays."""
    counts = datasets.groupBy(key).agg(F.count("*").alias("n_datasets"), F.count_if(F.col("fill_kind").isin("text", "array")).alias("n_bad_fills"), F.count_if(F.col("max_scales") > 1).alias("n_multi_scale"), F.count_if(F.col("dtype_kind").isin("object", "compound")).alias("n_unfixed"))
    used = datasets.select(key, F.explode("filters").alias("f")).groupBy(key, "f").agg(F.count("*").alias("n"))
    names = used.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat("f", F.lit(":"), F.col("n").cast("string")))), ",").alias("filters"))
    return counts.join(names, key, "left").withColumn("filters", F.coalesce("filters", F.lit("")))


def codec_histogram(elements: DataFrame, key: str, place: str, samples: int = 4) -> DataFrame:
    """(key, codec, n, first): elements by codec, and the places of the first few of each."""
    ranked = elements.where("codec IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy(key, "codec").orderBy(place)))
    first = ranked.where(F.col("_r") <= samples).groupBy(key, "codec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", place))), lambda x: x[place].cast("string")), ",").alias("first"))
    return elements.where("codec IS NOT NULL").groupBy(key, "codec").agg(F.count("*").alias("n")).join(first, [key, "codec"])


def tag_census(elements: DataFrame, key: str) -> DataFrame:
    """key, contiguous, chunks, codecs, extensions of (key, extended, extension, n_chunks, codec): how blocks are addressed."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return elements.groupBy(key).agg(F.count_if(~F.col("extended")).alias("contiguous"), F.sum(F.coalesce("n_chunks", F.lit(0))).alias("chunks"), listed("codec").alias("codecs"), listed(F.when(F.col("extended"), F.col("extension"))).alias("extensions"))
