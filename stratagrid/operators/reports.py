"""Rollups over a graded archive, and their rows as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .grading import CRITERIA, GRADES, grade_order


def criterion_rollup(graded: DataFrame) -> DataFrame:
    """criterion, held, partial, failed, unsettled; graded has a struct with a status by criterion."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("criterion"), F.col(f"`{n}`.status").alias("status")) for i, n in enumerate(CRITERIA)))).alias("c")
    st = F.col("status")
    counts = graded.select(each).select("c.*").groupBy("place", "criterion").agg(F.count_if(st == "yes").alias("held"), F.count_if(st == "partial").alias("partial"), F.count_if(st == "no").alias("failed"), F.count_if(~F.coalesce(st, F.lit("")).isin("yes", "partial", "no")).alias("unsettled"))
    return counts.orderBy("place").drop("place")


def center_rollup(graded: DataFrame, center: str) -> DataFrame:
    """Grades by data center, those with most collections first."""
    g = F.col("grade")
    return graded.groupBy(F.col(center).alias("center")).agg(F.count("*").alias("collections"), *(F.count_if(g == x).alias(x) for x in "ABCD"), F.count_if(g.isin("F", "F*", "U")).alias("unread")).orderBy(F.desc("collections"), "center")


def grade_counts(graded: DataFrame) -> DataFrame:
    """Every grade in order, with its collections; those without any count 0."""
    grades = graded.sparkSession.createDataFrame([(g,) for g in GRADES], "grade string")
    return grades.join(graded.groupBy("grade").agg(F.count("*").alias("n")), "grade", "left").select("grade", F.coalesce("n", F.lit(0)).alias("n")).orderBy(grade_order())


def sampling_histogram(counts: DataFrame) -> DataFrame:
    """n_sampled, collections, granules, abandoned (sampled, not attempted)."""
    return counts.groupBy("n_sampled").agg(F.count("*").alias("collections"), F.sum("n_sampled").alias("granules"), F.sum(F.col("n_sampled") - F.col("n_attempted")).alias("abandoned"))


def revision_epochs(granules: DataFrame, graded: DataFrame, revision: str, key: str = "collection_id") -> DataFrame:
    """epochs (spans, single or unknown), collections, top (of grade A): does a sample span more than a day of revisions?"""
    days = granules.groupBy(key).agg(F.count_distinct(F.to_date(revision)).alias("days"))
    kind = F.when(F.col("days") > 1, "spans").when(F.col("days") == 1, "single").otherwise("unknown")
    return days.join(graded.select(key, "grade"), key, "left").groupBy(kind.alias("epochs")).agg(F.count("*").alias("collections"), F.count_if(F.col("grade") == "A").alias("top"))


def cell(value: Column) -> Column:
    """A table cell: a dash for nothing, bars escaped."""
    text = F.replace(value.cast("string"), F.lit("|"), F.lit("\\|"))
    return F.when(value.isNull() | (text == "") | (text == "NaN"), s.DASH).otherwise(text)


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.col(c)) for c in columns)), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "|".join(["---"] * len(columns)) + "|"]
