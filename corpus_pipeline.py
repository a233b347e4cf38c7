"""From raw documents to packed training sequences, in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, and each stage's result
is written before the next one reads it. All but the last return the columns of their docs, whatever those are: a row
travels as one struct, so further columns may have any names. Null and empty texts are no fault in themselves: no
stage removes them, and packing gives each its end id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.llm import decontaminate, near_dedup, packing, shared, substring_dedup, toxicity


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model, fitted on the labelled ones among docs, calls toxic.

    Null and empty texts have no features and stay where most labelled texts are harmless; without labels all stay.
    Repeated rows are judged alike; ties at the limit stay."""
    labels = shared.table(spark, sf_dir, "labels").select("doc_id", toxicity.grade(F.col("toxic"), F.col("quality")).alias("grade"))
    model = toxicity.fit(docs, labels)
    return toxicity.score(_rows(docs), model, carry=["row"]).where("NOT toxic").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (four fifths of their five-word shingles): the least doc_id's, and of its repeated rows one. Texts without words stay.

    Of rows with equal ids and other texts in one group the one with the least key of text stays; null ids come first."""
    found = near_dedup.near_duplicates(docs, percent=80)
    keep = found.where("n_shingles > 0 AND kept").groupBy("group_key").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("row")).select("row.*")
    at = ["i", "z", *shared.KEY]
    number = lambda i: (F.coalesce(i, F.lit(0)).cast("long").alias("i"), i.isNull().alias("z"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *number(F.col("doc_id")), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("filled"), *shared.text_key(F.col("text")))
    hot = shared.hot_keys(found.where("n_shingles > 0").groupBy(*number(F.col("doc_id")), *shared.KEY).agg(F.count("*").alias("n")), at)
    chosen = shared.join_spread(rows.where("filled"), keep.select(*number(F.col("doc_id")), *shared.KEY), at, hot, "left_semi").dropDuplicates(at)
    return chosen.select("row.*").unionByName(rows.where("NOT filled").select("row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that occur elsewhere too; a text of which nothing stays goes.

    Null and short texts stay as they are; repeated rows are repeats of one another."""
    cut = substring_dedup.substring_dedup(_rows(docs), carry=["row"], want_text=True)
    left = cut.where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.when(changed, F.char_length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return left.select(*((new[c] if new.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten successive words of a benchmark item, or all of a shorter one.

    Null and empty texts hold none and stay, as all do where the benchmark is empty; repeated rows are judged alike."""
    return decontaminate.decontaminate(_rows(docs), shared.table(spark, sf_dir, "benchmark"), carry=["row"]).where("NOT contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens. Null and empty texts are their end id alone; repeated rows are
    packed as often as they come; no documents make no pieces."""
    return packing.pack(docs, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The fitted model cannot be said in SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
