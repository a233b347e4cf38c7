"""Controls: pick what a check needs, and compare what two ways of reading give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from . import reports
from .facts import ID

SECTION = "heading string, completed boolean, lines array<string>"

# What a refusal says if a criterion's claim is right.
EXPECTED = {"H3": ["not evenly divisible", "partial chunk"], "H2": ["inconsistent chunk shapes"], "G": ["do not line up", "conflicting sizes", "cannot align"]}


def largest_array(arrays: DataFrame) -> DataFrame:
    """(collection_id, name, elements): the largest chunked array by elements; of equals the first seen."""
    a = arrays.where((F.size("chunks") > 0) & (F.size("shape") >= 1) & ~F.coalesce("overview", F.lit(False))).withColumn("elements", s.product(F.col("shape")))
    return a.groupBy(ID).agg(F.min(F.struct((-F.col("elements")).alias("n"), "gi", "vi", "name")).alias("x")).select(ID, "x.name", (-F.col("x.n")).alias("elements"))


def modal_chunk(arrays: DataFrame) -> DataFrame:
    """(collection_id, name, chunks, n): the chunk shape that most granules of an array have; of equals the first seen."""
    per = arrays.groupBy(ID, "name", "chunks").agg(F.count("*").alias("n"), F.min(F.struct("gi", "vi")).alias("seen"))
    best = per.groupBy(ID, "name").agg(F.min(F.struct((-F.col("n")).alias("n"), "seen", "chunks")).alias("x"))
    return best.select(ID, "name", "x.chunks", (-F.col("x.n")).alias("n"))


def varying_axis(arrays: DataFrame) -> DataFrame:
    """(collection_id, name, axis): the first axis (from 0) whose length varies; null if none does or ranks differ."""
    ranks = arrays.groupBy(ID, "name").agg(F.count_distinct(F.size("shape")).alias("ranks"))
    lens = arrays.select(ID, "name", F.posexplode("shape").alias("axis", "len")).groupBy(ID, "name", "axis").agg(F.count_distinct("len").alias("lens"))
    first = lens.where("lens > 1").groupBy(ID, "name").agg(F.min("axis").alias("axis"))
    return ranks.join(first, [ID, "name"], "left").select(ID, "name", F.when(F.col("ranks") == 1, F.col("axis")).cast("long").alias("axis"))


def chunk_only_pairs(arrays: DataFrame) -> DataFrame:
    """(collection_id, gi_a, gi_b, name, elements): pairs of granules that agree on the shape of every array they share, but
    not on every chunk; the largest differing array. Samples are of a dozen granules, so a collection has few pairs.

    A granule is one row with its arrays, and a pair is judged in its row: pairs are neither made by array nor summed again.
    """
    one = arrays.where(F.col(ID).isNotNull() & F.col("gi").isNotNull() & F.col("name").isNotNull())
    g = one.groupBy(ID, "gi").agg(F.collect_list(F.struct("name", F.col("shape").alias("s"), F.col("chunks").alias("c"))).alias("v"))
    both = g.select(ID, F.col("gi").alias("gi_a"), F.col("v").alias("va")).join(g.select(ID, F.col("gi").alias("gi_b"), F.col("v").alias("vb")), ID).where("gi_a < gi_b")
    named = lambda x: F.filter("vb", lambda y: y["name"] == x["name"])
    differs = lambda x, y: (F.size(x["c"]) > 0) & (F.size(y["c"]) > 0) & (x["c"] != y["c"])
    other = F.exists("va", lambda x: F.exists(named(x), lambda y: F.coalesce(x["s"] != y["s"], F.lit(False))))
    equal = F.exists("va", lambda x: F.exists(named(x), lambda y: F.coalesce(x["s"] == y["s"], F.lit(False))))
    off = F.filter("va", lambda x: F.exists(named(x), lambda y: F.coalesce(differs(x, y), F.lit(False))))
    best = F.array_min(F.transform(off, lambda x: F.struct((-s.product(x["s"])).alias("n"), x["name"].alias("name"))))
    found = both.where(F.exists("va", lambda x: F.exists("vb", lambda y: (x["name"] == y["name"]) & F.coalesce(differs(x, y), F.lit(False)))))
    found = found.where(~other & equal).select(ID, "gi_a", "gi_b", best.alias("x"))
    return found.select(ID, "gi_a", "gi_b", "x.name", (-F.col("x.n")).alias("elements"))


def refusal_confirms(refusals: DataFrame, criterion: str, message: str) -> DataFrame:
    """Adds confirmed: the message has one of the criterion's phrases."""
    said = F.lit(False)
    for name, phrases in EXPECTED.items():
        for p in phrases:
            said = said | ((F.col(criterion) == name) & F.contains(F.lower(F.col(message)), F.lit(p)))
    return refusals.withColumn("confirmed", F.coalesce(said, F.lit(False)))


def pick(rows: DataFrame, grades: list[str], criterion: str | None = None, order: str = ID) -> DataFrame:
    """The first graded row with two granules opened, one of the grades and, if named, the deciding criterion."""
    fit = rows.where(F.col("grade").isin(grades) & (F.col("n_opened") >= 2))
    if criterion is not None:
        fit = fit.where(s.criterion_of(F.col("blocker")) == criterion)
    return fit.orderBy(order).limit(1)


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(only_left, only_right): rows of one side that the other has not, counting repeats; both 0 if the tables are equal."""
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return count(left.exceptAll(right), "only_left").crossJoin(count(right.exceptAll(left), "only_right"))


def drift(live: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """key, recorded, live, drift of two counts; a key on one side only counts 0 on the other."""
    j = live.select(key, F.col("n").alias("live")).join(recorded.select(key, F.col("n").alias("recorded")), key, "full_outer")
    return j.select(key, F.coalesce("recorded", F.lit(0)).alias("recorded"), F.coalesce("live", F.lit(0)).alias("live")).withColumn("drift", F.col("live") - F.col("recorded"))


def chunk_bytes(arrays: DataFrame) -> DataFrame:
    """Adds decoded_bytes: what a chunk must decode to."""
    return arrays.withColumn("decoded_bytes", s.product(F.col("chunks")) * s.dtype_width(F.col("dtype")))


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Limited by keys before it is shuffled."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def consistent(arrays: DataFrame, n: int) -> DataFrame:
    """(collection_id, name, gi, place): the first n granules that have an array's commonest chunk shape."""
    same = arrays.join(modal_chunk(arrays).select(ID, "name", F.col("chunks").alias("_chunks")), [ID, "name"]).where(F.col("chunks").eqNullSafe(F.col("_chunks")))
    return first_n(same, [ID, "name"], ["gi", "vi"], n).select(ID, "name", "gi")


def best_pair(pairs: DataFrame) -> DataFrame:
    """The pair with the most elements; of equals the first."""
    return pairs.orderBy(F.desc("elements"), ID, "gi_a", "gi_b").limit(1)


def section(spark: SparkSession, heading: str, check: Callable[[], DataFrame]) -> DataFrame:
    """(heading, completed, lines): a check's rows as Markdown lines, or what it failed with. A check is a few rows."""
    try:
        found = check()
        lines = [r.line for r in reports.markdown_rows(found, found.columns).collect()]
        return spark.createDataFrame([(heading, True, [*reports.markdown_head(found.columns), *lines])], SECTION)
    except Exception as e:  # a failed check is a row of the report
        return spark.createDataFrame([(heading, False, [f"{type(e).__name__}: {e}"[-1200:]])], SECTION)


def report(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """A section for each check, numbered in order."""
    out = None
    for i, (name, check) in enumerate(checks.items(), 1):
        part = section(spark, f"{i}. {name}", check)
        out = part if out is None else out.unionByName(part)
    return out
