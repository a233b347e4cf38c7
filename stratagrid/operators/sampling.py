"""Choosing comparable granules, without chance: ends, revisions, interior windows, orbits, assets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from .facts import ID

# How many granules each draw takes.
PER_END, INTERIOR, PER_REVISION, ORBIT_SCAN = 2, 4, 1, 40


def first_and_last(granules: DataFrame, by: str, n: int) -> DataFrame:
    """The n first and n last granules of each collection by a column, then id; a short collection's rows come once."""
    # each end is limited before it is shuffled, so a collection with very many granules sends a few of each task
    end = lambda first: granules.withColumn("_r", F.row_number().over(Window.partitionBy(ID).orderBy(first, "granule_id"))).where(F.col("_r") <= n).drop("_r")
    return end(F.asc(by)).unionByName(end(F.desc(by))).dropDuplicates([ID, "granule_id"])


def windows(spans: DataFrame, n: int = INTERIOR) -> DataFrame:
    """(collection_id, slice, lo, hi) of spans (collection_id, t0, t1): n slices of the record's interior, as dates.

    A slice is the span's days / (n + 1), its edges rounded half to even; spans of n + 1 days or fewer have none.
    """
    days = F.datediff("t1", "t0")
    edge = lambda k: F.date_add(F.col("t0"), F.rint(days * k / (n + 1)).cast("int"))
    cut = spans.where(days > n + 1).withColumn("slice", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return cut.select(ID, "slice", edge(F.col("slice")).alias("lo"), edge(F.col("slice") + 1).alias("hi"))


def interior(granules: DataFrame, n: int = INTERIOR) -> DataFrame:
    """The earliest granule in each interior slice, by collection.

    The slices of a collection are few and fixed, so each granule finds its own among them in its row: no range join.
    """
    spans = granules.groupBy(ID).agg(F.min(F.to_date("begin_time")).alias("t0"), F.max(F.to_date("begin_time")).alias("t1"))
    per = windows(spans, n).groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("slice", "lo", "hi"))).alias("w"))
    day = F.to_date("begin_time")
    placed = granules.join(per, ID).withColumn("slice", F.explode(F.transform(F.filter("w", lambda x: (day >= x["lo"]) & (day < x["hi"])), lambda x: x["slice"])))
    return placed.withColumn("_r", F.row_number().over(Window.partitionBy(ID, "slice").orderBy("begin_time", "granule_id"))).where("_r = 1").drop("_r", "w")


def opposite_orbit(granules: DataFrame, picked: DataFrame) -> DataFrame:
    """Up to two granules of the other direction among the first ones, where those picked have one direction only."""
    one = picked.where("orbit <> ''").groupBy(ID).agg(F.count_distinct("orbit").alias("n"), F.min("orbit").alias("seen")).where("n = 1")
    order = Window.partitionBy(ID).orderBy("begin_time", "granule_id")
    early = granules.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= ORBIT_SCAN)
    other = early.join(one.select(ID, "seen"), ID).where("orbit <> '' AND orbit <> seen")
    return other.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= PER_END).drop("_r", "_k", "seen")


def sample(granules: DataFrame, revision: str = "revision_date", write: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """All draws of a collection without a partition, each granule once, with its place gi in (begin_time, id) order.

    write(table, name) stores a table: granules and what was picked are read several times, and each reading is else a dozen
    sorts more that one task of the last stage holds side by side.
    """
    kept = write or (lambda df, _: df)
    granules = kept(granules, "granules")
    cols = granules.columns
    ends = first_and_last(granules, "begin_time", PER_END).select(cols)
    picked = ends.unionByName(interior(granules).select(cols)).unionByName(first_and_last(granules, revision, PER_REVISION).select(cols)).dropDuplicates([ID, "granule_id"])
    picked = kept(picked, "picked")
    every = picked.unionByName(opposite_orbit(granules, picked).select(cols)).dropDuplicates([ID, "granule_id"])
    return every.withColumn("place", F.row_number().over(Window.partitionBy(ID).orderBy("begin_time", "granule_id")).cast("long"))


def with_asset_keys(candidates: DataFrame) -> DataFrame:
    """Adds keys: for each of urls, its content tokens that not all have, sorted and joined by +; a single url's is empty.

    Token sets and what they share are columns of their own, so each is computed once for a row.
    """
    sets = candidates.withColumn("_sets", F.transform("urls", s.content_tokens))
    shared = sets.withColumn("_shared", F.aggregate(F.slice("_sets", F.lit(2), F.greatest(F.size("_sets") - 1, F.lit(0))), F.get("_sets", F.lit(0)), lambda a, x: F.array_intersect(a, x)))
    own = F.transform("_sets", lambda x: F.array_join(F.sort_array(F.array_except(x, "_shared")), "+"))
    return shared.withColumn("keys", F.when(F.size("urls") > 1, own).otherwise(F.transform("urls", lambda _: F.lit("")))).drop("_sets", "_shared")


def pin_asset(candidates: DataFrame, write: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(collection_id, granule_id, key, url) from (collection_id, granule_id, urls): the asset that most granules offer.

    Ties go to the lesser key; a granule without it keeps its first candidate and has a null key. Keys are read twice:
    write(table, name) stores them, so that names are split once.
    """
    keyed = (write or (lambda df, _: df))(with_asset_keys(candidates), "keyed")
    offers = keyed.select(ID, "granule_id", F.explode(F.array_distinct("keys")).alias("key")).groupBy(ID, "key").agg(F.count("*").alias("n"))
    best = offers.groupBy(ID).agg(F.min(F.struct((-F.col("n")).alias("n"), "key")).alias("b")).select(ID, F.col("b.key").alias("best"))
    place = F.array_position("keys", F.col("best"))
    last = F.size("keys") - F.array_position(F.reverse("keys"), F.col("best")) + 1  # of equal keys the last one counts
    url = F.when(place > 0, F.element_at("urls", last.cast("int"))).otherwise(F.get("urls", F.lit(0)))
    return keyed.join(best, ID).select(ID, "granule_id", F.when(place > 0, F.col("best")).alias("key"), url.alias("url"))


def abandoned(granules: DataFrame) -> DataFrame:
    """attempted_now: false for granules after the first of their collection that ran out of budget."""
    first = granules.where("error_type = 'ProbeTimeout'").groupBy(ID).agg(F.min("gi").alias("_first"))
    return granules.join(first, ID, "left").withColumn("attempted_now", F.coalesce(F.col("gi") <= F.col("_first"), F.lit(True))).drop("_first")


def resume(todo: DataFrame, done: DataFrame) -> DataFrame:
    """Entries whose digest differs from the one on record; null digests are never on record."""
    return todo.join(done, [ID, "digest"], "left_anti")


def merge(old: DataFrame, new: DataFrame, key: str = ID) -> DataFrame:
    """new in place of old for the keys it has."""
    return old.join(new, key, "left_anti").unionByName(new)


def matching(granules: DataFrame, pattern, by: str, n: int) -> DataFrame:
    """The first n granules of each collection whose name fits a glob pattern (a Column), by a column, then name."""
    fits = granules.where(F.col("granule_name").like(pattern) if isinstance(pattern, str) else F.expr("granule_name LIKE _pattern"))
    return fits.withColumn("_r", F.row_number().over(Window.partitionBy(ID).orderBy(by, "granule_name"))).where(F.col("_r") <= n).drop("_r")


def latest(catalog: DataFrame, name: str, version: str) -> DataFrame:
    """The last version of each name, versions compared as text; of equal ones the row that is least as a whole."""
    last = F.max(F.coalesce(version, F.lit("")))
    tops = catalog.groupBy(name).agg(last.alias("_last"))
    return catalog.join(tops, name).where(F.coalesce(version, F.lit("")) == F.col("_last")).groupBy(name).agg(F.min(F.struct(*catalog.columns)).alias("_row")).select("_row.*")


def resolve(requests: DataFrame, catalog: DataFrame, name: str, version: str) -> DataFrame:
    """requests with their catalog row: that of the version asked for, or of the last one where none is; null if unknown.

    requests has name and version. Of equal catalog rows the least as a whole counts."""
    rest = [x for x in catalog.columns if x not in (name, version)]
    exact = catalog.groupBy(name, version).agg(F.min(F.struct(version, *rest)).alias("_exact"))
    last = latest(catalog, name, version).select(name, F.struct(version, *rest).alias("_latest"))
    found = requests.join(exact, [name, version], "left").join(last, name, "left").withColumn("_row", F.when(F.col(version).isNull(), F.col("_latest")).otherwise(F.col("_exact")))
    return found.select(name, F.col(version).alias("asked"), F.col(f"_row.{version}").alias("found"), *(F.col(f"_row.{x}") for x in rest))


def required(rows: DataFrame, known: DataFrame, key: str, what: str) -> DataFrame:
    """rows with the columns of known; a row whose key is not known is an error, raised when the plan runs."""
    found = rows.join(known.withColumn("_known", F.lit(True)), key, "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit(f"no {what} for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col(key))
    return found.withColumn(key, checked).drop("_known")


def backfill(sample: DataFrame, dates: DataFrame, column: str = "revision_date") -> DataFrame:
    """sample with one column anew from dates (granule_id, column), empty where they have none; all else stays."""
    new = dates.select("granule_id", F.col(column).cast("string").alias("_new"))
    return sample.join(new, "granule_id", "left").withColumn(column, F.coalesce("_new", F.lit(""))).drop("_new")


def recall(rows: DataFrame, memo: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with flag from a memo and remembered: a false that is on record is not the same as no record."""
    return rows.join(memo.select(key, flag, F.lit(True).alias("remembered")), key, "left").withColumn("remembered", F.coalesce("remembered", F.lit(False)))
