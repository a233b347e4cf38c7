"""Benchmark decontamination over a positional inverted index.

1. Test items are cut into windows of `window` words (an item of fewer is one window); equal windows are one.
2. Every benchmark word's occurrences in the whole corpus are counted, and each window names its two rarest places.
3. The index: postings (word, text, place) of the words so named, one for all copies of a text.
4. Intersection, rarest first: a posting minus the word's offset in a window is a start; starts that both lists share
   are candidates for the phrase. Starts that differ by at most `slop` are proximity matches.
5. Candidates meet their text once more, where the whole window is compared by 128 bits: exact phrase matches.

The tables about the benchmark (windows, words) are broadcast while they have at most `broadcast_rows` rows and
BROADCAST_BYTES bytes; beyond that Spark joins them by shuffling. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BROADCAST_BYTES = 64 << 20
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased. Null has none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.filter(F.split(low, BREAK), lambda w: w != "")


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(w, items): each distinct window's words and the items that have it, as sorted strings."""
    cut = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    each = cut.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("at"))
    return each.select("item", F.slice("w", F.col("at"), window).alias("w")).groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))


def postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, k1, k2, pos) of each occurrence of the given words; rows has k1, k2, w."""
    return rows.select("k1", "k2", F.posexplode("w").alias("pos", "term")).join(terms, "term", "left_semi")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, slop: int = 3, broadcast_rows: int = 200_000, carry: list[str] | None = None) -> DataFrame:
    """A row for each of docs: the columns in carry (default doc_id), n_words, n_hit (words inside matches of a window),
    n_items, items (their ids as sorted strings), n_near (proximity matches that are no exact ones), contaminated.

    Null and empty texts have no words and no hits; items without words are never met; items with a null id count as
    matched words but are in no list. Equal texts and repeated rows share their matches. n_near: starts of windows at
    which their two rarest words stand up to `slop` places nearer or farther than in the item, and which are no matches;
    of equally rare words the lesser counts as the rarer. items is held once for each window, so a window's items
    should fit a row.
    """
    spark = docs.sparkSession
    files = shared.parts(items.count(), 5_000, least=2)  # of the tables about the benchmark
    w = shared.materialise(benchmark_windows(items, item_id, item_text, window).withColumn("wid", F.xxhash64(F.array_join("w", " "))).withColumn("wid2", F.xxhash64(F.lit("window"), F.array_join("w", " "))), "windows", files)
    places = w.select("wid", F.posexplode("w").alias("off", "term"))
    n_places, n_bytes = w.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)), F.coalesce(F.sum(F.size("w") * F.lit(48) + F.octet_length(F.array_join("w", " ")) + F.octet_length(F.array_join("items", "  "))), F.lit(0))).head()
    small = F.broadcast if n_places <= broadcast_rows and n_bytes <= BROADCAST_BYTES else (lambda x: x)
    rows = docs.select(*shared.text_key(F.col(text)), words(F.col(text)).alias("w"))
    counts = rows.select(F.explode("w").alias("term")).join(small(places.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    # a word that no text has makes its window impossible; it is its rarest, with no postings
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "off")))
    named = places.join(counts, "term", "left").groupBy("wid").agg(order.alias("p")).select("wid", F.col("p")[0].alias("first"), F.get("p", F.lit(1)).alias("second"))
    named = shared.materialise(named.where("first.n > 0"), "rarest", files)
    terms = named.select(F.col("first.term").alias("term")).union(named.select("second.term").where("second IS NOT NULL")).distinct()
    index = shared.materialise(postings(rows, small(terms)).distinct(), "postings")

    def starts(place: str) -> DataFrame:
        lists = named.where(f"{place} IS NOT NULL").select("wid", F.col(f"{place}.term").alias("term"), F.col(f"{place}.off").alias("off"), F.col("second").isNull().alias("single"))
        return index.join(small(lists), "term").select("wid", "single", "k1", "k2", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")

    first = starts("first").select("wid", "single", "k1", "k2", "start", F.explode(F.when(F.col("single"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(-slop), F.lit(slop)))).alias("apart")).withColumn("at", F.col("start") + F.col("apart"))
    second = starts("second").select("wid", "k1", "k2", F.col("start").alias("at")).distinct()
    both = first.where("NOT single").join(second, ["wid", "k1", "k2", "at"], "left_semi").unionByName(first.where("single"))
    phrase = both.select("k1", "k2", "wid", "start", "apart").distinct()
    met = phrase.join(small(w.select("wid", "wid2", F.size("w").alias("size"), "items")), "wid").groupBy("k1", "k2").agg(
        F.collect_list(F.when(F.col("apart") == 0, F.struct("start", "size", "wid", "wid2"))).alias("phrases"),
        F.collect_set(F.when(F.col("apart") == 0, F.struct("wid", "items"))).alias("names"),
        F.collect_set(F.when(F.col("apart") != 0, F.struct("start", "wid"))).alias("near"),
    )
    whole = docs.select(F.struct(*(carry or [doc_id])).alias("carry"), *shared.text_key(F.col(text)), F.col(text).alias("text"))
    joined = shared.join_spread(whole, met, shared.KEY, shared.hot_texts(whole.select(*shared.KEY))).select("carry", "phrases", "names", "near", words(F.col("text")).alias("w"))
    at = "array_join(slice(w, p.start + 1, p.size), ' ')"
    hits = joined.select("carry", "names", "near", F.size("w").alias("n"), F.expr(f"filter(coalesce(phrases, array()), p -> xxhash64({at}) = p.wid AND xxhash64('window', {at}) = p.wid2)").alias("hits"))
    covered = "size(array_distinct(flatten(transform(hits, h -> sequence(h.start, h.start + h.size - 1)))))"
    named = "array_sort(array_distinct(flatten(transform(filter(coalesce(names, array()), x -> exists(hits, h -> h.wid = x.wid)), x -> x.items))))"
    # a start that is an exact match is not counted as a proximity match
    near = "size(array_except(coalesce(near, array()), transform(hits, h -> struct(h.start, h.wid))))"
    out = hits.select("carry", "n", F.expr(covered).alias("n_hit"), F.expr(named).alias("items"), F.expr(near).alias("n_near"))
    return out.select("carry.*", F.col("n").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("n_near").cast("long").alias("n_near"), (F.col("n_hit") > 0).alias("contaminated"))
