"""Notes of a report, rules over files and catalogs, and pixel sizes as whole vectors."""

import pytest
from pyspark.sql import functions as F

from stratagrid.functions import scalars as s
from stratagrid.operators import diagnosis, grid, notes, sampling, verification
from stratagrid.sources import containers

from .builders import archive, documents, probe, pvar, refusal, statuses


def test_pixel_sizes_are_compared_whole(spark):
    tile = lambda scale: probe(pvar("v"), tiff_grid={"crs": "EPSG:32610", "tiepoint": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0], "pixel_scale": scale})
    cases = {"same": [tile([30.0, 30.0])] * 2, "tall": [tile([30.0, 30.0]), tile([30.0, 60.0])], "missing": [tile([30.0, 30.0]), tile(None)], "none": [tile(None), tile(None)]}
    got = statuses(grid.tiff_lattice(archive(spark, cases).tiffs))
    assert {k: got[k] == "no" for k in cases} == {"same": False, "tall": True, "missing": True, "none": False}


def test_reasons_why_granules_did_not_open(spark):
    g = archive(spark, {"c": [probe(pvar("v")), refusal("ProbeTimeout", "slow " * 5000), refusal("", "", attempted=False), refusal("", "", attempted=False)], "d": [probe(pvar("v"))]}).granules
    got = {r.collection_id: r for r in notes.coverage(g).collect()}
    assert set(got) == {"c"} and (got["c"].n_probed, got["c"].n_attempted, got["c"].n_sampled) == (1, 2, 4)
    first, second = got["c"].reasons.rsplit("; ", 1)
    assert first.endswith("slow " * 5000) and second.startswith("not attempted")  # messages are whole


def test_empty_tables_and_grades(spark):
    graded = spark.createDataFrame([("x", "A"), ("y", "F*")], "name string, grade string")
    assert [r.grade for r in notes.empty_grades(graded).collect()] == ["B", "C", "D", "F", "U"]
    assert [r[0] for r in graded.select(s.shown_grade(F.col("grade"))).collect()] == ["A ⭐", "F\\*"]
    none = spark.createDataFrame([], "name string, format string, blocker string")
    assert notes.container_note(none, "name", "format", "blocker").head() == (0, 0, 0, 0, 0, "")


def test_a_row_that_is_not_known_is_an_error(spark):
    rows, known = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("a", 9)], "k string, w int")
    assert [tuple(r) for r in sampling.required(rows.where("k = 'a'"), known, "k", "row").select("k", "v", "w").collect()] == [("a", 1, 9)]
    with pytest.raises(Exception, match="no row for b"):
        sampling.required(rows, known, "k", "row").collect()


def test_resolve_and_recall(spark):
    catalog = spark.createDataFrame([("a", "9", 1), ("a", "10", 2), ("a", "9", 0), ("b", None, 3)], "n string, v string, x int")
    asked = spark.createDataFrame([("a", None), ("a", "10"), ("a", "7"), ("b", None), ("z", "1")], "n string, v string")
    got = {(r.n, r.asked): (r.found, r.x) for r in sampling.resolve(asked, catalog, "n", "v").collect()}
    assert got == {("a", None): ("9", 0), ("a", "10"): ("10", 2), ("a", "7"): (None, None), ("b", None): (None, 3), ("z", "1"): (None, None)}
    memo = spark.createDataFrame([("u", False), ("w", True)], "url string, dmrpp boolean")
    got = {r.url: (r.dmrpp, r.remembered) for r in sampling.recall(spark.createDataFrame([("u",), ("v",), ("w",)], "url string"), memo, "url", "dmrpp").collect()}
    assert got == {"u": (False, True), "v": (None, False), "w": (True, True)}


def test_sections_and_buckets(spark):
    ok = spark.createDataFrame([(1, "a|b")], "n int, t string")
    got = verification.report(spark, {"Fine": lambda: ok, "Broken": lambda: ok.select("absent")}).collect()
    assert [(r.heading, r.completed) for r in got] == [("1. Fine", True), ("2. Broken", False)]
    assert got[0].lines[2:] == ["| 1 | a\\|b |"] and len(got[1].lines[0]) <= 1200
    none = spark.createDataFrame([], "collection_id string, error_type string, error string, at int")
    assert diagnosis.bucket_report(diagnosis.bucketed(none), "at").head().document == '{"collections":[],"collections_per_bucket":[],"unnamed":[]}'


def test_heads_of_files(spark, tmp_path):
    (tmp_path / "a.h5").write_bytes(bytes.fromhex("894844460D0A1A0A") + b"x" * 1000)
    (tmp_path / "b.txt").write_bytes(b"\x89")
    got = {r.file: (r.bytes, r.container) for r in containers.sniff_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.h5": (1008, "hdf5"), "b.txt": (1, "unknown")}


def test_probe_documents_to_notes(spark):
    docs = documents(spark, {"c": [probe(pvar("v")), probe(pvar("v", dtype="int16"))]})
    from stratagrid.plans import assessment

    row = notes.status_notes(assessment.assess(docs), "collection_id").head()
    assert (row.n_dtype, row.dtype_names, row.control_names, row.n_codec) == (1, "c", "c", 0)
