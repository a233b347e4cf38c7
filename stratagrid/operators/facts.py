"""Facts about arrays: which ones carry data, in which order, and over how many granules.

Tables: granules (collection_id, granule_id, gi, ok, attempted, error_type, error, ...) and arrays (collection_id,
granule_id, gi, vi, name, overview, shape, chunks, dtype, codecs, dims, cf, ...). gi and vi are places in the sample and
in the granule; wherever a result depends on what was seen first, it is the least (gi, vi).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s

ID = "collection_id"


def described(arrays: DataFrame) -> DataFrame:
    """arrays with bytes, chunk, and science: whether a record can carry a cube, so no overview, coordinate, metadata group
    or unsized type."""
    if "science" in arrays.columns:
        return arrays
    sized = arrays.withColumn("bytes", s.array_bytes(F.col("shape"), F.col("dtype"))).withColumn("chunk", s.chunks_of(F.col("chunks"), F.col("shape")))
    overview = F.coalesce(F.col("overview"), F.lit(False)) if "overview" in arrays.columns else F.lit(False)
    science = F.col("bytes").isNotNull() & ~overview & ~s.is_coordinate(F.col("name")) & ~s.is_metadata(F.col("name"))
    return sized.withColumn("science", F.coalesce(science, F.lit(False)))


def science_records(arrays: DataFrame) -> DataFrame:
    return described(arrays).where("science").drop("science")


def place() -> Column:
    """A record's (gi, vi) as one long, so that the first one is found by hash and needs no sort; a granule has under 2^24 arrays."""
    return F.shiftleft(F.col("gi").cast("long"), 24) + F.col("vi")


def summed(records: DataFrame, properties: dict[str, Column]) -> DataFrame:
    """(collection_id, name, bytes, n_records, rank, lo, hi, dims, whole, n, differs) of each array, in one pass.

    n and differs are structs by property: records that say something, and whether they say two things or more. Values are
    told apart by 128 bits of hash, whose least and greatest are of fixed size, so an array's sums are too, and map-side.
    rank goes by size, then name; lo, hi and dims are least and most axes of shapes and most of chunks.
    """
    said = records.select(ID, "name", "bytes", F.size("shape").alias("axes"), F.size("chunk").alias("chunk_axes"), (F.col("chunk") == F.col("shape")).alias("is_whole"), *(p.alias(f"p{i}") for i, p in enumerate(properties.values())))
    keys = [F.when(F.col(f"p{i}").isNotNull(), F.xxhash64(F.lit(seed), F.col(f"p{i}"))).alias(f"h{i}_{seed}") for i in range(len(properties)) for seed in (1, 2)]
    hashed = said.select(ID, "name", "bytes", "axes", "chunk_axes", "is_whole", *keys)
    sums = [F.max("bytes").alias("bytes"), F.count("*").alias("n_records"), F.min("axes").alias("lo"), F.max("axes").alias("hi"), F.max("chunk_axes").alias("dims"), F.bool_and("is_whole").alias("whole")]
    two = lambda h: F.coalesce(F.min(h) != F.max(h), F.lit(False))
    n = F.struct(*(F.count(f"h{i}_1").alias(p) for i, p in enumerate(properties)))
    differs = F.struct(*((two(f"h{i}_1") | two(f"h{i}_2")).alias(p) for i, p in enumerate(properties)))
    order = Window.partitionBy(ID).orderBy(F.desc("bytes"), "name")
    return hashed.groupBy(ID, "name").agg(*sums, n.alias("n"), differs.alias("differs")).withColumn("rank", F.row_number().over(order).cast("long"))


def first_differing(sums: DataFrame, properties: list[str]) -> DataFrame:
    """(collection_id, name, rank, property): for each property the comparable array of least rank whose records differ."""
    off = sums.where("n_records >= 2").groupBy(ID).agg(*(F.min(F.when(F.col("differs")[p], F.struct("rank", "name"))).alias(f"w{i}") for i, p in enumerate(properties)))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col(f"w{i}").alias("w")) for i, p in enumerate(properties))))
    return off.select(ID, each.alias("e")).where("e.w IS NOT NULL").select(ID, "e.w.name", "e.w.rank", "e.property")


def values_of(records: DataFrame, picks: DataFrame, properties: dict[str, Column]) -> DataFrame:
    """(collection_id, name, rank, property, values) of picks: an array's distinct values in the order in which they were
    first seen. A null says nothing.

    Only the arrays that a note names are read for it. Sums are before the shuffle: their key has the name inside a struct, so
    the join's own partitions, among them that of a very common array, do not serve.
    """
    value = F.coalesce(*(F.when(F.col("property") == name, p) for name, p in properties.items()))
    dealt = records.join(picks, [ID, "name"]).select(ID, "property", F.struct("rank", "name").alias("at"), value.alias("value"), place().alias("seen")).where("value IS NOT NULL")
    first = dealt.groupBy(ID, "property", "at", "value").agg(F.min("seen").alias("seen"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("seen", "value"))), lambda x: x["value"])
    return first.groupBy(ID, "property", "at").agg(in_order.alias("values")).select(ID, "at.name", "at.rank", "property", "values")


def shape_kinds(records: DataFrame) -> DataFrame:
    """(collection_id, name, shape, chunk, n, seen): an array's kinds of shape and chunk, with their records and first place."""
    return records.groupBy(ID, "name", "shape", "chunk").agg(F.count("*").alias("n"), F.min(place()).alias("seen"))


def comparable(ranks: DataFrame) -> DataFrame:
    return ranks.where("n_records >= 2")


def opened_counts(granules: DataFrame) -> DataFrame:
    return granules.groupBy(ID).agg(F.count_if(s.opened(F.col("ok"))).alias("n_opened"), F.count("*").alias("n_sampled"), F.count_if(s.attempted(F.col("attempted"))).alias("n_attempted"))


def universal(ranks: DataFrame, granules: DataFrame) -> DataFrame:
    return ranks.join(opened_counts(granules), ID).where("n_records = n_opened").select(*ranks.columns)


def principal(ranks: DataFrame) -> DataFrame:
    """(collection_id, principal): the first comparable array, else the first."""
    order = F.struct(F.when(F.col("n_records") >= 2, 0).otherwise(1), "rank")
    return ranks.groupBy(ID).agg(F.min_by("name", order).alias("principal"))


def distinct_in_order(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, values: the distinct values as an array, in the order in which they were first seen."""
    first = values.groupBy(*keys, value).agg(F.min(F.struct("gi", "vi")).alias("seen"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", F.col(value).alias("value")))), lambda x: x["value"]).alias("values"))
