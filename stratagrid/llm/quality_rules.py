"""A ledger of quality rules: every rule is evaluated once for each text, policies and ablations are bitwise.

The ledger holds measurements and a bitmask of failed rules. A policy is a mask: a text passes if it fails none of the
policy's rules. Changing a policy, or asking what each rule alone removes, reads the ledger and not the texts.
Everything is built of SQL functions, and no text leaves its row: there is no shuffle but for the ablation's sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rule by bit: name and the condition, over measurements, under which a text fails.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 10"),
    ("repeated_phrases", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("short_mean_word", "word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 30 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Versions stay as they were published; a new policy is a new entry.
POLICIES: dict[str, int] = {
    "base": mask("too_few_words", "repeated_phrases"),
    "v1": mask(*BIT),
}


def measured(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """carry, and the measurements of each text as bigint columns. A null text is an empty one: all are 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*carry).alias("carry"), t.alias("t"))
    rows = rows.select("carry", "t", F.filter(F.split("t", BLANK), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("l"))
    rows = rows.select("carry", "t", "l", F.size("w").alias("n"), F.expr("CASE WHEN size(w) >= 5 THEN transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) ELSE array() END").cast("array<bigint>").alias("g"))
    # windows that come again, in order of place: sort (hash, place), keep those with an equal neighbour
    rows = rows.select("carry", "t", "l", "n", F.expr("CASE WHEN size(g) > size(array_distinct(g)) THEN array_sort(transform(g, (h, i) -> struct(h AS h, i AS i))) ELSE array() END").alias("s"))
    again = """CASE WHEN size(s) = 0 THEN array() ELSE array_sort(array_compact(zip_with(
        zip_with(s, concat(array(CAST(NULL AS STRUCT<h: BIGINT, i: INT>)), slice(s, 1, size(s) - 1)), (x, y) -> struct(x.h AS h, x.i AS i, coalesce(x.h = y.h, false) AS d)),
        slice(s, 2, size(s)), (x, y) -> CASE WHEN x.d OR coalesce(x.h = y.h, false) THEN x.i END))) END"""
    rows = rows.select("carry", "t", "l", "n", F.expr(again).cast("array<int>").alias("r"))
    # a window that starts d words after the one before it adds at most 5 words and at most d
    covered = "aggregate(r, struct(0L AS total, -5 AS last), (a, i) -> struct(a.total + least(5, i - a.last) AS total, i AS last), a -> a.total)"
    bare = F.translate("t", " \t\n\x0b\x0c\r", "")
    return rows.select(
        "carry",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry (default doc_id), the measurements and failures (bigint bitmask), a row for each of docs.

    Null and empty texts have measurements of 0 and so too few words. Each row is judged by itself: repeated rows and ties
    come as often as they are there, and an empty table has none. Columns not in carry are not read.
    """
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text, carry or ["doc_id"]).select("carry.*", *MEASURES, bits.alias("failures"))


def passes(policy: str | int, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(POLICIES[policy] if isinstance(policy, str) else policy).cast("long")) == 0


def ablation(held: DataFrame, policy: str | int = "v1") -> DataFrame:
    """For each rule of the policy: rule, texts, failed (by it), only (by no other), kept_without (if it went)."""
    m = POLICIES[policy] if isinstance(policy, str) else policy
    bad = held.groupBy(F.col("failures").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in BIT)), F.array(*(F.lit(v).cast("long") for v in BIT.values())))).alias("rule", "bit")
    each = bad.select("bits", "n", rules).where(F.col("bit").bitwiseAND(F.lit(m).cast("long")) != 0)
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(F.sum("n").alias("texts"), total(has)("failed"), total(alone)("only"), total(alone | (F.col("bits") == 0))("kept_without"))
