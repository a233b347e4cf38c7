"""What a report says of a graded archive: counts with the names they stand for, each from its own verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .facts import ID
from .grading import GRADES, grade_order

# How an HDF4-generation container is named, and the kinds of refusal told apart among its readers.
HDF4_FAMILY = r"HDF4|HDF-EOS2|^HDF-EOS$"
HDF4_KINDS = r"(data-block references unreadable|wrong number of dimension names|UTF-8)"


def named(name: Column, condition: Column) -> Column:
    """The names for which a condition holds, sorted and joined by commas: one for each collection at most."""
    return F.array_join(F.array_sort(F.collect_list(F.when(condition, name))), ", ")


def is_(criterion: str, status: str) -> Column:
    return F.coalesce(F.col(f"`{criterion}`.status") == status, F.lit(False))


def status_notes(graded: DataFrame, name: str) -> DataFrame:
    """One row: how many change data types or codecs (H4, H5) or miss arrays (V), and which; control_names are those that a
    control for H4 or H5 would be run on."""
    n = F.col(name)
    return graded.agg(
        F.count_if(is_("H4", "no")).alias("n_dtype"), named(n, is_("H4", "no")).alias("dtype_names"), F.count_if(is_("H5", "no")).alias("n_codec"), named(n, is_("H5", "no")).alias("codec_names"),
        F.count_if(is_("V", "partial")).alias("n_missing"), F.count_if(is_("V", "no")).alias("n_disjoint"), named(n, is_("V", "no")).alias("disjoint_names"),
        named(n, is_("H4", "no") | is_("H5", "no")).alias("control_names"),
    )


def store_notes(verdicts: DataFrame) -> DataFrame:
    """One row: stores that open as flat datasets, in part or as trees, not at all, and those not recorded."""
    st = F.col("status")
    return verdicts.agg(F.count_if(st == "yes").alias("flat"), F.count_if(st == "partial").alias("trees"), F.count_if(st == "no").alias("neither"), F.count_if(~F.coalesce(st, F.lit("")).isin("yes", "partial", "no")).alias("unrecorded"))


def container_note(graded: DataFrame, name: str, form: str, blocker: str) -> DataFrame:
    """One row about collections in HDF4-generation containers: how many are read, refused on every granule (and in how many
    ways), and opened without any array (and which)."""
    b = F.coalesce(F.col(blocker), F.lit(""))
    empty = b.contains("without arrays")
    refused = b.contains("refused: ") & ~empty
    kind = F.regexp_extract(b, HDF4_KINDS, 1)
    family = graded.where(F.coalesce(F.col(form), F.lit("")).rlike(HDF4_FAMILY))
    counts = family.agg(F.count("*").alias("family"), F.count_if(refused).alias("refused"), F.count_if(empty).alias("empty"), F.count_distinct(F.when(refused & (kind != ""), kind)).alias("kinds"), named(F.col(name), empty).alias("empty_names"))
    return counts.select("family", (F.col("family") - F.col("refused") - F.col("empty")).alias("read"), "refused", "kinds", "empty", "empty_names")


def principal_note(rows: DataFrame, name: str, largest: str, headline: str) -> DataFrame:
    """The first collection by name whose largest array is not the one its granules share, with both; no row without one."""
    differ = (F.coalesce(F.col(largest), F.lit("")) != "") & F.col(headline).isNotNull() & (F.col(largest) != F.col(headline))
    return rows.where(differ).select(name, largest, headline).orderBy(name, largest, headline).limit(1)


def partial_example(graded: DataFrame, name: str, criterion: str = "H2") -> DataFrame:
    """The first collection by name whose criterion holds in part, with its evidence; no row without one."""
    return graded.where(is_(criterion, "partial")).select(name, F.col(f"`{criterion}`.note").alias("note")).orderBy(name).limit(1)


def empty_grades(graded: DataFrame) -> DataFrame:
    """Grades that no collection has, in their order."""
    every = graded.sparkSession.createDataFrame([(g,) for g in GRADES], "grade string")
    return every.join(graded.select("grade").distinct(), "grade", "left_anti").orderBy(grade_order())


def coverage(granules: DataFrame) -> DataFrame:
    """Collections of which not every sampled granule opened: n_probed, n_attempted, n_sampled and the reasons, each once."""
    counts = granules.groupBy(ID).agg(F.count_if(s.opened(F.col("ok"))).alias("n_probed"), F.count_if(s.attempted(F.col("attempted"))).alias("n_attempted"), F.count("*").alias("n_sampled"))
    return counts.where("n_probed < n_sampled").join(unopened_reasons(granules), ID)


def unopened_reasons(granules: DataFrame) -> DataFrame:
    """(collection_id, reasons): why granules did not open, each reason once, by the granule that has it first."""
    ok, tried, kind, error = (F.col(x) for x in ("ok", "attempted", "error_type", "error"))
    why = F.when(~s.attempted(tried), "not attempted: an earlier granule used up the budget").when(s.transport_failure(ok, kind, error), "failed in transport").otherwise(s.classify_refusal(kind, error))
    first = granules.where(~s.opened(ok)).select(ID, "gi", why.alias("why")).groupBy(ID, "why").agg(F.min("gi").alias("gi"))
    return first.groupBy(ID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gi", "why"))), lambda x: x["why"]), "; ").alias("reasons"))


def bucket_section(counts: DataFrame) -> DataFrame:
    """The named buckets by name, from (bucket, n_collections): what is not OTHER."""
    return counts.where("bucket <> 'OTHER'").select("bucket", "n_collections").orderBy("bucket")
