"""Refusals: representatives, buckets, and what a diagnosis says of the bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from .facts import ID

# What a chunk manifest's codecs can express.
ZARR_CODECS = ["DEFLATE", "NONE"]
ZARR_FILTERS = ["gzip", "shuffle", "fletcher32", "zstd", "blosc"]


def representatives(refusals: DataFrame, order: str) -> DataFrame:
    """The first of each collection's refusals with one error, and n_like_this; errors are compared by 200 characters."""
    keys = [ID, F.coalesce("error_type", F.lit("no arrays returned")), F.substring("error", 1, 200)]
    return refusals.groupBy(*keys).agg(F.min_by(F.struct(*refusals.columns), order).alias("_first"), F.count("*").alias("n_like_this")).select("_first.*", "n_like_this")


#: Buckets by condition over error_type and error; the survey's own taxonomy is a table like this, so users pass theirs.
BUCKETS: list[tuple[str, str]] = [
    ("DIMENSION_SCALES", "error LIKE '%dimension scales%'"),
    ("FILL_VALUE", "error LIKE '%fill_value%'"),
    ("DECODING", "error_type = 'UnicodeDecodeError'"),
]


def bucketed(refusals: DataFrame, rules: list[tuple[str, str]] = BUCKETS) -> DataFrame:
    """Refusals that are a reader's, with their bucket; what no rule takes is OTHER."""
    bucket = F.lit("OTHER")
    for name, rule in reversed(rules):
        bucket = F.when(F.expr(rule), name).otherwise(bucket)
    return refusals.where(~s.ours(F.col("error_type"), F.col("error"))).withColumn("bucket", bucket)


def bucket_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("bucket").agg(F.count_distinct(ID).alias("n_collections"), F.count("*").alias("n_granules"))


def bucket_labels(found: DataFrame, order: str) -> DataFrame:
    """(collection_id, buckets sorted and joined, n_refused, example: its first refusal's type, error and bucket)."""
    example = F.min_by(F.struct("error_type", F.substring("error", 1, 200).alias("error"), "bucket"), order)
    return found.groupBy(ID).agg(F.array_join(F.array_sort(F.collect_set("bucket")), ", ").alias("buckets"), F.count("*").alias("n_refused"), example.alias("example"))


def unnamed_classes(found: DataFrame) -> DataFrame:
    """As unnamed, with the collections' ids sorted: those with most granules first."""
    key = F.concat(F.col("error_type"), F.lit(": "), s.collapse(F.col("error")))
    each = found.where("bucket = 'OTHER'").groupBy(key.alias("error"), ID).agg(F.count("*").alias("n"))
    return each.groupBy("error").agg(F.sum("n").alias("n_granules"), F.array_sort(F.collect_list(ID)).alias("collections")).orderBy(F.desc("n_granules"), "error")


def bucket_report(found: DataFrame, order: str) -> DataFrame:
    """One row with the whole document as JSON: labels by collection, buckets by their number of collections, unnamed classes.

    It has a line for each refused collection, as its readers expect, and so is one row: for surveys, not for granules."""
    labels = bucket_labels(found, order).agg(F.array_sort(F.collect_list(F.struct(ID, "buckets", "n_refused", "example"))).alias("collections"))
    ranked = bucket_counts(found).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_collections")).alias("n"), "bucket"))), lambda x: F.struct(x["bucket"].alias("bucket"), (-x["n"]).alias("n_collections"))).alias("collections_per_bucket"))
    rest = unnamed_classes(found).agg(F.array_sort(F.collect_list(F.struct((-F.col("n_granules")).alias("n"), "error", "collections"))).alias("u"))
    rest = rest.select(F.transform("u", lambda x: F.struct(x["error"].alias("error"), (-x["n"]).alias("n_granules"), x["collections"].alias("collections"))).alias("unnamed"))
    return labels.crossJoin(ranked).crossJoin(rest).select(F.to_json(F.struct("collections", "collections_per_bucket", "unnamed")).alias("document"))  # of one row each


def unnamed(found: DataFrame) -> DataFrame:
    """Classes of refusal without a bucket: text with its numbers collapsed, granules, collections."""
    key = F.concat(F.col("error_type"), F.lit(": "), s.collapse(F.col("error")))
    return found.where("bucket = 'OTHER'").groupBy(key.alias("error")).agg(F.count("*").alias("n_granules"), F.count_distinct(ID).alias("n_collections"))


def reader_gaps(diagnoses: DataFrame) -> DataFrame:
    """(collection_id, reader_gap, file_blocker, open_question): texts, null where they do not hold.

    diagnoses: (collection_id, pos, container, has_findings, n_datasets, n_bad_fills, n_multi_scale, n_unfixed, filters,
    codecs, n_chunks, n_compressed, n_contiguous, extensions, all_stored). The bytes are addressable only if every
    diagnosis of a collection says so; one without findings settles that they are not known to be.
    """
    c = F.col
    only = lambda col, allowed: F.size(F.array_except(col, F.array(*map(F.lit, allowed)))) == 0
    counted = c("n_chunks") + c("n_compressed") + c("n_contiguous")
    hdf5, hdf4, zipped, text = (c("container") == x for x in ("hdf5", "hdf4", "zip", "text"))
    good = (
        F.when(hdf5, (c("n_bad_fills") + c("n_multi_scale") + c("n_unfixed") == 0) & only("filters", ZARR_FILTERS))
        .when(hdf4, only("codecs", ZARR_CODECS) & (counted > 0))
        .when(zipped, c("all_stored"))
        .otherwise(F.lit(False))
    )
    good = F.coalesce(c("has_findings") & good, F.lit(False))
    gap = F.when(hdf5, F.concat(c("n_datasets").cast("string"), F.lit(" arrays under expressible filters"))).when(hdf4, F.concat(counted.cast("string"), F.lit(" addressable blocks"))).otherwise("members are stored")
    parts = F.array_compact(F.array(
        F.when(hdf5 & (c("n_bad_fills") > 0), F.concat(c("n_bad_fills").cast("string"), F.lit(" of "), c("n_datasets").cast("string"), F.lit(" arrays have fill values that do not encode"))),
        F.when(hdf5 & (c("n_multi_scale") > 0), F.concat(c("n_multi_scale").cast("string"), F.lit(" of "), c("n_datasets").cast("string"), F.lit(" arrays have axes with several scales"))),
        F.when(hdf5 & (c("n_unfixed") > 0), F.concat(c("n_unfixed").cast("string"), F.lit(" of "), c("n_datasets").cast("string"), F.lit(" arrays have types without a width"))),
        F.when(hdf4 & ~only("codecs", ZARR_CODECS), F.concat(F.lit("codecs without a decoder: "), F.array_join(F.array_sort(F.array_except("codecs", F.array(*map(F.lit, ZARR_CODECS)))), ", "))),
        F.when(zipped & ~c("all_stored"), F.lit("members are deflated")),
        F.when(text, F.lit("text has no byte offsets")),
    ))
    open_ = hdf4 & (counted == 0) & (F.size("codecs") == 0) & (F.size("extensions") > 0)
    d = diagnoses.select(ID, "pos", good.alias("good"), F.when(good, gap).alias("gap"), F.when(c("has_findings"), parts).otherwise(F.array().cast("array<string>")).alias("parts"), F.when(c("has_findings") & open_, F.concat(F.lit("blocks behind "), F.array_join(F.array_sort("extensions"), " or "))).alias("open"))
    listed = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("pos", v))), lambda x: x[v])
    out = d.groupBy(ID).agg(F.bool_and("good").alias("all"), listed("gap").alias("gaps"), F.flatten(listed("parts")).alias("parts"), F.min_by("open", F.when(c("open").isNotNull(), c("pos"))).alias("open_question"))
    text_of = lambda v: F.array_join(F.array_distinct(v), "; ")
    return out.select(ID, F.when(c("all"), F.concat(F.lit("reader gap: "), text_of("gaps"))).alias("reader_gap"), F.when(F.size("parts") > 0, text_of("parts")).alias("file_blocker"), "open_question")


def text_census(texts: DataFrame, key: str, text: str, lines: int = 12) -> DataFrame:
    """key, n_lines, min_width, max_width, fixed_width of the first lines of each text; widths are in bytes."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n$", "")
    head = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(body, "\n"), 1, lines))
    widths = F.transform("head", lambda x: F.octet_length(F.rtrim(x, F.lit("\r"))))
    rows = texts.select(key, head.alias("head")).withColumn("w", widths)
    return rows.select(key, F.size("head").cast("long").alias("n_lines"), F.array_min("w").cast("long").alias("min_width"), F.array_max("w").cast("long").alias("max_width"), (F.size(F.array_distinct("w")) == 1).alias("fixed_width"))


def zip_census(members: DataFrame, key: str, place: str, stored: str, n: int = 32) -> DataFrame:
    """key, n_members, all_stored over the first members of each archive."""
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(place))).where(F.col("_r") <= n)
    return first.groupBy(key).agg(F.count("*").alias("n_members"), F.bool_and(stored).alias("all_stored"))


def blocking_arrays(findings: DataFrame) -> DataFrame:
    """(collection_id, arrays): datasets that findings name, each once, in order; findings: (collection_id, pos, datasets)."""
    each = findings.select(ID, "pos", F.posexplode("datasets").alias("at", "dataset")).where("dataset IS NOT NULL")
    first = each.groupBy(ID, "dataset").agg(F.min(F.struct("pos", "at")).alias("seen"))
    return first.groupBy(ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "dataset"))), lambda x: x["dataset"]).alias("arrays"))
