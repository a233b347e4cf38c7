"""The pipeline on a fixture, against a plain version of each stage."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stratagrid.llm import encoding, toxicity

from . import helpers as h
from .test_decontaminate import words
from .test_near_dedup import brute as near
from .test_substring_dedup import brute as cut
from .test_toxicity import labelled


def fixture(spark, tmp_path):
    rows = list(dict(h.corpus(12)).items())
    marked = [(5000 + i, t, g) for i, t, g in labelled(5, 300)]
    item = h.prose(__import__("random").Random(8), 20)
    rows += [(i, t) for i, t, _ in marked] + [(700, "so " + " ".join(item.split()[4:15]) + " there"), (701, "clean and short")]
    h.table(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(g > 0)) for i, _, g in marked], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, marked, item


def test_stages_equal_plain_versions(spark, tmp_path):
    rows, marked, item = fixture(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
    # toxicity: what the severity model says, which the labels confirm
    left = {i for i, _ in texts_of(seen["toxicity"])}
    assert sum(i in left for i, _, g in marked if g == 0) >= 0.98 * sum(g == 0 for *_, g in marked)
    assert sum(i in left for i, _, g in marked if g) <= 0.1 * sum(g > 0 for *_, g in marked)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").select("doc_id", toxicity.grade(F.col("toxic"), F.col("quality")).alias("grade"))
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    verdict = {r.doc_id: r.toxic for r in toxicity.score(spark.read.parquet(f"{tmp_path}/documents.parquet"), model).collect()}
    assert left == {i for i, _ in rows if not verdict[i]}
    # near duplicates: the least of each group; texts without words stay
    before = texts_of(seen["toxicity"])
    keep = {i for i, n, _, kept in near(before, 80) if kept or not n}
    assert {i for i, _ in texts_of(seen["near_dedup"])} == keep and {400, 401, 402, 408} <= keep
    # repeated passages
    before = texts_of(seen["near_dedup"])
    want = {i: (n, gone, sha) for i, n, gone, sha in cut(before, 35) if not gone or gone < n}
    assert {i for i, _ in texts_of(seen["substring_dedup"])} == set(want)
    assert {r.doc_id: r.n_chars for r in seen["substring_dedup"] if r.text} == {r.doc_id: len(r.text) for r in seen["substring_dedup"] if r.text}
    # decontamination
    grams = {tuple(words(item)[k : k + 10]) for k in range(len(words(item)) - 9)}
    clean = [(i, t) for i, t in texts_of(seen["substring_dedup"]) if not grams & {tuple(words(t)[k : k + 10]) for k in range(len(words(t)))}]
    assert sorted(texts_of(seen["decontamination"]), key=str) == sorted(clean, key=str)
    assert 700 not in {r.doc_id for r in seen["decontamination"]} and 701 in {r.doc_id for r in seen["decontamination"]}
    direct = Tokenizer.from_file(encoding.default_tokenizer())
    want = {i: np.array([*direct.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in clean}
    assert len(want) == len(clean) and sum(r.length for r in seen["packing"]) == sum(len(x) for x in want.values())
    for r in seen["packing"]:
        assert (r.doc_tokens, r.ids_crc32) == (len(want[r.doc_id]), zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()))


def texts_of(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_repeated_and_empty_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "p q r s t u v"), (None, "p q r s t u v"), (None, "other words in here now ok"), (2, None), (2, None), (3, "")]
    got = corpus_pipeline.drop_near_copies(spark, h.table(spark, rows), "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted([("1", "a b c d e f g"), ("None", "p q r s t u v"), ("None", "other words in here now ok"), ("2", "None"), ("2", "None"), ("3", "")])
    assert got[0].row == 7
    assert corpus_pipeline.drop_near_copies(spark, h.table(spark, []), "").collect() == []
    assert corpus_pipeline.cut_repeats(spark, h.table(spark, rows), "").columns == h.table(spark, []).columns


def test_stages_on_awkward_rows(spark, tmp_path):
    rows = [(1, None), (1, None), (2, ""), (None, "some words"), (3, " \n"), (3, "some words"), (4, "x" * 100_000 + " y" * 50_000)]
    docs = h.table(spark, rows).withColumn("severity", F.lit(1)).withColumn("contaminated", F.lit(True))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "not in there")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "decontamination"):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(texts_of(out.collect()), key=str) == sorted(rows, key=str)
    assert len({(r.doc_id, r.sequence_id, r.offset) for r in stages["packing"](spark, docs, "").collect()}) >= len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name


def test_run_returns_the_stages_pieces(spark, tmp_path):
    fixture(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "start", "length", "ids_crc32"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    total = lambda df: sorted((r.doc_id, r.doc_tokens, r.n) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect())
    assert total(got) == total(docs) and total(got)


def test_run_on_empty_tables(spark, tmp_path):
    h.table(spark, [], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
