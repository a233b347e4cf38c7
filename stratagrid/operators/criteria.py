"""The criteria: each is a DataFrame (collection_id, status, note) with a row for every collection.

status is yes, no, partial, unknown or unmeasured; note is the evidence. An Archive holds the tables and the facts that
several criteria share, so Spark reuses their shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from . import facts
from .facts import ID

NOT_OPENED, NOT_TWICE = "no granule opened", "no data array appears in two opened granules"


def say(*parts: Column | str) -> Column:
    """Text of the parts; null if one of them is."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


CF_KEYS = ["scale_factor", "add_offset", "_FillValue", "units"]


def properties() -> dict[str, Column]:
    """What an array's records are compared by, as text; a null says nothing."""
    chunk = F.col("chunk")
    return {
        "chunk shape": say("[", F.array_join(chunk.cast("array<string>"), ", "), "]"),
        "dtype": F.col("dtype"),
        "codec chain": F.when(F.size(s.codecs_of(F.col("codecs"))) > 0, F.array_join("codecs", "+")),
        **{key: s.cf_value(F.element_at("cf", key), key) for key in CF_KEYS},
    }


@dataclass
class Archive:
    """granules and arrays as in facts; the others only for the criteria that need them.

    coords: (collection_id, granule_id, gi, name, first_v, step_v, n); tiffs: (collection_id, granule_id, gi, crs, x0, y0,
    px), x0 null without a tiepoint; locality: (collection_id, granule_id, n_blocks, runs, leading); levels: (collection_id,
    level); attributes: (collection_id, key, value) of grid attributes; materialised: (collection_id, gi, dataset_ok,
    datatree_ok, error). arrays_of makes arrays of granules, where those are read to make them.
    """

    granules: DataFrame
    arrays: DataFrame
    coords: DataFrame | None = None
    tiffs: DataFrame | None = None
    locality: DataFrame | None = None
    levels: DataFrame | None = None
    attributes: DataFrame | None = None
    materialised: DataFrame | None = None
    arrays_of: Callable[[DataFrame], DataFrame] | None = None

    @cached_property
    def counts(self) -> DataFrame:
        return facts.opened_counts(self.granules)

    @cached_property
    def records(self) -> DataFrame:
        return facts.science_records(self.arrays)

    def said(self) -> dict[str, Column]:
        """properties, as stored with the arrays where they are."""
        return {p: F.col(f"said{i}") if f"said{i}" in self.arrays.columns else v for i, (p, v) in enumerate(properties().items())}

    @cached_property
    def sums(self) -> DataFrame:
        """facts.summed over all properties, and over shapes."""
        return facts.summed(self.records, self.said() | {"shape": F.col("shape")})

    @cached_property
    def ranks(self) -> DataFrame:
        return self.sums.select(ID, "name", "bytes", "n_records", "rank")

    @cached_property
    def comparable(self) -> DataFrame:
        return facts.comparable(self.ranks)

    @cached_property
    def kinds(self) -> DataFrame:
        return facts.shape_kinds(self.records)

    def values_of(self, *names: str) -> DataFrame:
        """facts.values_of the named properties, where they first differ: the stored ones, or made of nothing else."""
        if "values" in self.__dict__:
            return self.__dict__["values"].where(F.col("property").isin(*names))
        every = self.said()
        return facts.values_of(self.records, facts.first_differing(self.sums, list(names)), {n: every[n] for n in names})

    def settle(self, write: Callable[[DataFrame, str], DataFrame]) -> Archive:
        """Facts that many criteria read, each computed once: write(table, name) stores a table and returns it as stored.

        Arrays lie by collection, one of very many records in several parts, so that sums before a shuffle leave little of them.
        They hold each property as flat text, made once, in place of the attributes.
        """
        self.granules = write(self.granules, "granules")
        arrays = self.arrays if self.arrays_of is None else self.arrays_of(self.granules)
        flat = facts.described(arrays).withColumns({f"said{i}": p for i, p in enumerate(properties().values())} | {"units": F.element_at("cf", "units")})
        self.arrays = write(flat.drop("cf", "chunks", "overview", "grid").hint("rebalance", ID), "arrays")
        for name in ("counts", "sums", "kinds"):
            self.__dict__[name] = write(getattr(self, name), name)
        self.__dict__["values"] = write(self.values_of(*properties()), "values")
        return self

    def every(self, found: DataFrame, status: Column, note: Column) -> DataFrame:
        return self.counts.join(found, ID, "left").select(ID, status.alias("status"), note.alias("note"))


def h0_parse(a: Archive) -> DataFrame:
    """Did every granule that was really tried open, with arrays?"""
    g = a.granules.withColumn("opened", s.opened(F.col("ok")))
    g = g.withColumn("refused", ~F.col("opened") & ~s.unmeasured(F.col("ok"), F.col("attempted"), F.col("error_type"), F.col("error")))
    filled = a.arrays.select(ID, "granule_id").distinct().withColumn("filled", F.lit(True))
    found = g.join(filled, [ID, "granule_id"], "left").groupBy(ID).agg(
        F.count_if("opened").alias("good"),
        F.count_if("refused").alias("bad"),
        F.count_if(F.col("opened") & F.coalesce("filled", F.lit(False))).alias("full"),
        F.count_if(s.budget_exhausted(F.col("ok"), F.col("attempted"), F.col("error_type"))).alias("spent"),
        F.min_by(F.when(F.col("refused"), s.classify_refusal(F.col("error_type"), F.col("error"))), F.when(F.col("refused"), F.col("gi"))).alias("why"),
    )
    n = F.col("good") + F.col("bad")
    status = F.when(n == 0, "unmeasured").when((F.col("good") == 0) | (F.col("full") == 0), "no").when(F.col("bad") == 0, "yes").otherwise("partial")
    note = (
        F.when(n == 0, say("no layout read, ", F.col("spent"), " out of budget"))
        .when(F.col("good") == 0, say("all ", n, " refused: ", F.col("why")))
        .when(F.col("full") == 0, say(F.col("good"), " opened without arrays"))
        .when(F.col("bad") == 0, say(F.col("good"), "/", n, " opened"))
        .otherwise(say(F.col("good"), "/", n, " opened; ", F.col("why")))
    )
    return a.every(found, status, note)


def _agreement(a: Archive, what: str, empty: str, least: int = 1) -> DataFrame:
    n, off = F.col("n")[what], F.col("differs")[what]
    sums = a.sums.where("n_records >= 2").groupBy(ID).agg(F.count("*").alias("twice"), F.count_if(n >= least).alias("m"), F.count_if((n >= least) & off).alias("k"), F.min(F.when(n >= least, F.struct("rank", off.alias("off")))).alias("lead"))
    worst = a.values_of(what).select(ID, say(F.col("name"), " ", F.array_join("values", " vs ")).alias("worst"))
    shown = say(f"{what} differs in ", F.col("k"), " of ", F.col("m"), " variables: ", F.col("worst"))
    found = sums.join(worst, ID, "left").select(ID, "twice", F.when(F.col("m") > 0, F.col("m")).alias("m"), "k", F.col("lead.off").alias("first_differs"), shown.alias("note"))
    k, m = F.col("k"), F.col("m")
    status = F.when((F.col("n_opened") == 0) | m.isNull(), "unmeasured").when(k == 0, "yes").when(F.col("first_differs"), "no").otherwise("partial")
    note = F.when(F.col("n_opened") == 0, NOT_OPENED).when(F.col("twice").isNull(), NOT_TWICE).when(m.isNull(), empty).when(k == 0, say(f"one {what} in each of ", m, " variables")).otherwise(F.col("note"))
    return a.every(found, status, note)


def h2_chunks(a: Archive, grid: DataFrame | None = None) -> DataFrame:
    """Is each array's chunk shape the same in all granules? One whole-array chunk needs a shared grid besides."""
    base = _agreement(a, "chunk shape", NOT_TWICE)
    if grid is None:
        return base
    lead = a.sums.where("n_records >= 2 AND whole IS NOT NULL").groupBy(ID).agg(F.min(F.struct("rank", "whole")).alias("lead")).select(ID, F.col("lead.whole").alias("whole"))
    both = base.join(lead, ID, "left").join(grid.select(ID, F.col("status").alias("grid")), ID, "left")
    unsafe = (F.col("status") == "yes") & F.coalesce("whole", F.lit(False)) & (F.coalesce("grid", F.lit("unmeasured")) != "yes")
    why = F.when(F.col("grid") == "no", "without a grid their length may vary").otherwise("whether a grid fixes their length is not known")
    return both.select(ID, F.when(unsafe, "partial").otherwise(F.col("status")).alias("status"), F.when(unsafe, say(F.col("note"), "; each granule is one chunk, and ", why)).otherwise(F.col("note")).alias("note"))


def h4_dtypes(a: Archive) -> DataFrame:
    return _agreement(a, "dtype", NOT_TWICE)


def h5_codecs(a: Archive) -> DataFrame:
    """Chains that were not recorded say nothing: an array needs two recorded ones."""
    return _agreement(a, "codec chain", "no codec chain in two granules of one array", least=2)


def h3_concat(a: Archive) -> DataFrame:
    """Can granules be laid end to end without a partial chunk inside?"""
    stable = a.sums.where(F.expr("n_records >= 2 AND lo > 0 AND lo = hi AND dims = lo AND differs.shape") & ~F.col("differs")["chunk shape"]).select(ID, "name", "rank")
    cells = a.kinds.select(ID, "name", "chunk", "n", "seen", F.posexplode("shape").alias("axis", "len")).select(ID, "name", "axis", "len", F.get("chunk", F.col("axis")).alias("size"), "n", "seen")
    lens = cells.groupBy(ID, "name", "axis", "len", "size").agg(F.sum("n").alias("n"), F.min("seen").alias("seen")).join(stable, [ID, "name"])
    off = F.coalesce(F.try_mod("len", "size") != 0, F.lit(False))
    axes = lens.groupBy(ID, "name", "rank", "axis").agg(F.count("*").alias("lens"), F.sum(F.when(off, F.col("n")).otherwise(0)).alias("off"), F.min(F.when(off, F.struct("seen", "len", "size"))).alias("first"))
    moving = F.col("lens") > 1
    names = axes.groupBy(ID, "name", "rank").agg(F.count_if(moving).alias("vary"), F.max(F.when(moving, F.col("off"))).alias("off"), F.min(F.when(moving, F.struct("axis", "first"))).alias("at"))
    kind = F.when(F.col("vary") >= 2, 1).when((F.col("vary") == 1) & (F.col("off") >= 2), 2).when((F.col("vary") == 1) & (F.col("off") == 1), 3)
    found = names.groupBy(ID).agg(F.count_if(F.col("vary") > 0).alias("varying"), F.count(kind).alias("n_off"), F.min(F.struct(kind.alias("kind"), "rank", "name", "at")).alias("any"), F.min(F.when(kind.isNotNull(), F.struct(kind.alias("kind"), "rank", "name", "at"))).alias("worst"))
    m = a.comparable.groupBy(ID).agg(F.count("*").alias("m"))
    w, part = F.col("worst.kind"), F.col("worst.at.first")
    of = say(" (", F.col("n_off"), " of ", F.col("m"), " variables): ", F.col("worst.name"))
    status = F.when((F.col("n_opened") == 0) | F.col("m").isNull(), "unmeasured").when(w <= 2, "no").when(w == 3, "partial").otherwise("yes")
    at = say(of, " axis ", F.col("worst.at.axis") + 1, ", ", part["len"], " in chunks of ", part["size"])
    note = (
        F.when(F.col("n_opened") == 0, NOT_OPENED)
        .when(F.col("m").isNull(), NOT_TWICE)
        .when(w == 1, say("extents differ on several axes", of))
        .when(w == 2, say("partial chunk inside", at))
        .when(w == 3, say("one length is no multiple, which only the last may be", at))
        .when(F.col("varying") > 0, "lengths that vary are multiples of the chunk")
        .otherwise("shapes are identical")
    )
    return a.every(m.join(found, ID, "left"), status, note)


def v_coverage(a: Archive) -> DataFrame:
    """Does every opened granule have every array?"""
    with_n = a.ranks.join(a.counts.select(ID, "n_opened"), ID)
    full = F.col("n_records") == F.col("n_opened")
    found = with_n.groupBy(ID).agg(F.count("*").alias("n"), F.count_if(full).alias("uni"), F.min(F.when(~full, F.struct("rank", "name", "n_records"))).alias("worst"), F.min(F.when(full, F.struct("rank", "name"))).alias("span"))
    n, uni = F.col("n"), F.col("uni")
    status = F.when((F.col("n_opened") < 2) | n.isNull(), "unmeasured").when(uni == n, "yes").when(uni == 0, "no").otherwise("partial")
    missing = say(n - uni, " of ", n, " arrays are absent somewhere: ", F.col("worst.name"), " is in ", F.col("worst.n_records"), " of ", F.col("n_opened"))
    note = F.when(F.col("n_opened") < 2, "fewer than two granules opened").when(n.isNull(), "no data array recorded").when(uni == n, say("all ", n, " arrays are in each of ", F.col("n_opened"), " granules")).when(uni == 0, missing).otherwise(say(missing, "; ", F.col("span.name"), " spans the sample"))
    return a.every(found, status, note)


def s1_cf(a: Archive) -> DataFrame:
    """Do the attributes agree that decide what a decoder computes, or at least what it is called?"""
    values = a.values_of(*CF_KEYS).where(F.size("values") > 1).withColumn("k", F.array_position(F.array(*map(F.lit, CF_KEYS)), F.col("property")) - 1)
    first = F.struct("rank", "k", say(F.col("name"), ".", F.col("property"), ": ", F.array_join("values", " vs ")).alias("text"))
    found = values.groupBy(ID).agg(F.min(F.when(F.col("k") < 3, first)).alias("decoding"), F.min(F.when(F.col("k") == 3, first)).alias("labelling"))
    units = F.col("units") if "units" in a.arrays.columns else F.element_at("cf", "units")
    clock = a.arrays.where(s.time_named(s.leaf(F.col("name"))) & ~s.is_metadata(F.col("name"))).withColumn("units", units).where("units IS NOT NULL")
    epochs = clock.groupBy(ID, "name").agg(F.count_distinct("units").alias("n"), F.min("units").alias("lo"), F.max("units").alias("hi")).where("n > 1").groupBy(ID).agg(F.min(F.struct("name", "n", "lo", "hi")).alias("epoch"))
    m = a.comparable.groupBy(ID).agg(F.count("*").alias("m"))
    all_ = m.join(found, ID, "left").join(epochs, ID, "left")
    d, e, u = F.col("decoding"), F.col("epoch"), F.col("labelling")
    status = F.when((F.col("n_opened") == 0) | F.col("m").isNull(), "unmeasured").when(d.isNotNull() | e.isNotNull(), "no").when(u.isNotNull(), "partial").otherwise("yes")
    note = (
        F.when(F.col("n_opened") == 0, NOT_OPENED)
        .when(F.col("m").isNull(), NOT_TWICE)
        .when(d.isNotNull(), say("decoded values differ: ", d["text"]))
        .when(e.isNotNull(), say("epochs differ: ", e["name"], ".units, ", e["n"], " from ", e["lo"], " to ", e["hi"]))
        .when(u.isNotNull(), say("only labels differ: ", u["text"]))
        .otherwise(say("attributes agree over ", F.col("m"), " variables"))
    )
    return a.every(all_, status, note)


def shared_dims(a: Archive) -> DataFrame:
    """(collection_id, dim, n_arrays): how many differently named arrays declare a dimension."""
    dims = a.arrays.select(ID, "name", F.explode("dims").alias("dim")).select(ID, "name", F.lower("dim").alias("dim"))
    return dims.groupBy(ID, "dim").agg(F.count_distinct("name").alias("n_arrays"))


def t_time(a: Archive) -> DataFrame:
    """Is time a dimension that arrays share?"""
    dims = shared_dims(a)
    named = a.arrays.groupBy(ID, "name").agg(F.count("dims").alias("n"))
    declared = named.groupBy(ID).agg(F.sum("n").alias("n_dimmed"), F.min(F.when(s.time_named(F.col("name")), F.lower("name"))).alias("variable"))
    timed = s.time_named(F.col("dim"))
    found = dims.join(declared.select(ID, "n_dimmed"), ID).groupBy(ID).agg(
        F.min(F.when(timed & ((F.col("n_arrays") >= 2) | (F.col("n_dimmed") <= 1)), F.col("dim"))).alias("shared"),
        F.min(F.when(timed & s.canonical_time(F.col("dim")), F.col("dim"))).alias("own"),
        F.min(F.when(timed, F.col("dim"))).alias("lone"),
        F.count("*").alias("n_dims"),
    )
    all_ = declared.join(found, ID, "left")
    c = F.col
    status = F.when(c("n_opened") == 0, "unmeasured").when(c("shared").isNotNull(), "yes").when(c("own").isNotNull(), "partial").when(c("lone").isNotNull(), "no").when(c("variable").isNotNull(), "partial").otherwise("no")
    note = (
        F.when(c("n_opened") == 0, NOT_OPENED)
        .when(c("shared").isNotNull(), say("dimension ", c("shared")))
        .when(c("own").isNotNull(), say(c("own"), " is a coordinate of no other array"))
        .when(c("lone").isNotNull(), say(c("lone"), " belongs to one array"))
        .when(c("variable").isNotNull(), say("variable ", c("variable"), " without a dimension"))
        .when(c("n_dims").isNull(), "no dimension names")
        .otherwise("no time dimension")
    )
    return a.every(all_, status, note)


def pmd_locality(a: Archive) -> DataFrame:
    """Can the chunk index be read in a few ranges? Granules that failed count too."""
    found = a.locality.where("n_blocks > 0").groupBy(ID).agg(F.median("n_blocks").alias("blocks"), F.median("runs").alias("runs"), F.median(F.coalesce("leading", F.lit(0.0))).alias("lead"))
    b, r = F.col("blocks"), F.col("runs")
    status = F.when(b.isNull(), "unmeasured").when(F.col("n_opened") == 0, "no").when((r <= 2) & (b <= 4), "yes").when(r <= 8, "partial").otherwise("no")
    text = say("median ", F.rint(b).cast("long"), " blocks in ", F.rint(r).cast("long"), " runs, ", F.rint(100 * F.col("lead")).cast("long"), "% leading")
    return a.every(found, status, F.when(b.isNull(), "no block log").when(F.col("n_opened") == 0, say(text, "; never opened")).otherwise(text))


def principal_chunks(a: Archive) -> DataFrame:
    """(collection_id, principal, chunk, stored, n_chunks): the principal array's first chunk and medians over its records."""
    own = a.records.join(facts.principal(a.ranks), ID).where("name = principal")
    kept = s.stored_bytes(F.col("chunk_bytes_median"), F.col("chunk"), F.col("dtype"), F.col("codecs"))
    return own.groupBy(ID, "principal").agg(F.min_by("chunk", F.struct("gi", "vi")).alias("chunk"), F.median(kept).alias("stored"), F.median(F.coalesce("n_chunks", F.lit(1))).alias("n_chunks"))


def psz_chunks(a: Archive) -> DataFrame:
    """Is a request worth its latency?"""
    m, n = F.col("stored"), F.col("n_chunks")
    status = F.when((F.col("n_opened") == 0) | m.isNull(), "unmeasured").when(m >= 500_000, "yes").when(m >= 50_000, "partial").when(n <= 4, "yes").otherwise("no")
    text = say(F.col("principal"), ": median chunk ", F.rint(m / 1e6 * 1000) / 1000, " MB in ", F.rint(n).cast("long"), " chunks")
    note = F.when(F.col("n_opened") == 0, NOT_OPENED).when(F.col("principal").isNull(), "no data array recorded").when(m.isNull(), say(F.col("principal"), ": no possible chunk length")).when(m >= 50_000, text).when(n <= 4, say(text, "; a few requests read it whole")).otherwise(say(text, "; bound by latency"))
    return a.every(principal_chunks(a), status, note)


def m_materialises(a: Archive) -> DataFrame:
    """Do stores open as flat datasets, or as trees? Beside the grade."""
    recorded = a.materialised
    ds, dt = s.opened(F.col("dataset_ok")), s.opened(F.col("datatree_ok"))
    found = recorded.groupBy(ID).agg(F.count("*").alias("n"), F.count_if(ds).alias("ds"), F.count_if(dt).alias("dt"))
    n = F.col("n")
    status = F.when((F.col("n_opened") == 0) | n.isNull(), "unmeasured").when(F.col("ds") == n, "yes").when(F.col("dt") == n, "partial").when((F.col("ds") == 0) & (F.col("dt") == 0), "no").otherwise("partial")
    note = F.when(F.col("n_opened") == 0, NOT_OPENED).when(n.isNull(), "not recorded").otherwise(say(F.col("ds"), " of ", n, " open as datasets, ", F.col("dt"), " as trees"))
    return a.every(found, status, note)
