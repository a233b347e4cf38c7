"""From verdicts to a grade, its reasons and a ranking."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import criteria as c
from .criteria import Archive
from .facts import ID
from .grid import grid_verdict

#: Criteria in the order of rollups.
CRITERIA = ["H0", "H2", "H3", "H4", "H5", "V", "S1", "P-md", "P-sz", "G", "T"]
GRADES = ["A", "B", "C", "D", "F*", "F", "U"]


def verdicts(a: Archive, write: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Each criterion's (collection_id, status, note); M too where it is recorded. H2 waits for the grid.

    write(table, name) stores a table: each criterion is then a job of its own, a few at a time, and what grading reads are
    a dozen small tables. One plan of all of them is planned anew whenever one of its many stages ends.
    """
    kept = write or (lambda df, _: df)
    todo = {"G": grid_verdict, "H0": c.h0_parse, "H3": c.h3_concat, "H4": c.h4_dtypes, "H5": c.h5_codecs, "V": c.v_coverage, "S1": c.s1_cf, "P-sz": c.psz_chunks, "T": c.t_time}
    if a.locality is not None:
        todo["P-md"] = c.pmd_locality
    if a.materialised is not None:
        todo["M"] = c.m_materialises
    with ThreadPoolExecutor(8) as pool:
        jobs = {n: pool.submit(kept, f(a), f"verdict-{n}") for n, f in todo.items()}
        done = {"G": jobs["G"].result()}
        jobs["H2"] = pool.submit(kept, c.h2_chunks(a, done["G"]), "verdict-H2")
        done |= {n: job.result() for n, job in jobs.items()}
    return {n: done[n] for n in [*CRITERIA, "M"] if n in done}


def wide(found: dict[str, DataFrame]) -> DataFrame:
    """One row for each collection with a struct (status, note) by criterion: one shuffle by collection, then a pivot by max."""
    rows = None
    for name, df in found.items():
        part = df.select(ID, F.lit(name).alias("criterion"), F.struct("status", "note").alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(ID).agg(*(F.max(F.when(F.col("criterion") == n, F.col("v"))).alias(n) for n in [*CRITERIA, "M"]))


#: Reasons of a B in their order: criterion and the statuses that are reasons.
REASONS = [
    ("H2", ["partial"]), ("H4", ["partial"]), ("H5", ["partial"]), ("V", ["no", "partial"]),
    ("H2", ["unmeasured"]), ("H3", ["unmeasured"]), ("H4", ["unmeasured"]), ("H5", ["unmeasured"]), ("V", ["unmeasured"]),
    ("P-sz", ["unmeasured"]), ("P-md", ["unmeasured"]), ("G", ["partial", "unknown", "unmeasured"]),
    ("T", ["no", "partial", "unknown", "unmeasured"]), ("P-md", ["no"]), ("P-sz", ["no"]), ("S1", ["partial"]),
]


def grade(verdict_row: DataFrame) -> DataFrame:
    """Adds grade and blocker to a row of structs by criterion; a criterion without a struct is unmeasured."""
    st = lambda n: F.coalesce(F.col(f"`{n}`.status"), F.lit("unmeasured"))
    said = lambda n: F.concat(F.lit(f"{n}: "), F.coalesce(F.col(f"`{n}`.note"), F.lit("not recorded")))
    ladder = [("U", "H0", "unmeasured"), ("F", "H0", "no"), *(("D", n, "no") for n in ("H2", "H4", "H5", "H3")), ("C", "S1", "no"), ("C", "H3", "partial"), ("C", "H0", "partial")]
    letter = note = None
    for g, n, status in ladder:
        hit = st(n) == status
        letter = F.when(hit, g) if letter is None else letter.when(hit, g)
        note = F.when(hit, said(n)) if note is None else note.when(hit, said(n))
    holds = st("P-md").isin("yes", "partial") & st("P-sz").isin("yes", "partial")
    for n in ("G", "T", "H2", "H4", "H5", "V", "S1"):
        holds = holds & (st(n) == "yes")
    reasons = F.concat_ws("; ", *(F.when(st(n).isin(statuses), said(n)) for n, statuses in REASONS))
    return verdict_row.withColumn("grade", letter.when(holds, "A").otherwise("B")).withColumn("blocker", note.when(holds, "no blocker").otherwise(F.when(reasons == "", said("G")).otherwise(reasons)))


def starred(graded: DataFrame, gaps: DataFrame) -> DataFrame:
    """gaps: (collection_id, reader_gap, file_blocker, open_question). An F whose bytes are addressable becomes F*."""
    g = graded.join(gaps, ID, "left")
    f, gap = F.col("grade") == "F", F.col("reader_gap")
    more = F.coalesce(gap, F.col("file_blocker"), F.col("open_question"))
    return g.withColumn("blocker", F.when(f, F.concat_ws("; ", "blocker", more)).otherwise(F.col("blocker"))).withColumn("grade", F.when(f & gap.isNotNull(), "F*").otherwise(F.col("grade"))).drop("reader_gap", "file_blocker", "open_question")


def grade_order(col: str = "grade"):
    return F.array_position(F.array(*(F.lit(g) for g in GRADES)), F.col(col))


def ranking(graded: DataFrame, *by: str) -> DataFrame:
    return graded.orderBy(grade_order(), *by)
