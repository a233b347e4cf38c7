"""Sampling, diagnosis, rollups, verification, readers and sinks."""

import datetime as dt
import json
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratagrid.operators import diagnosis, reports, sampling, verification
from stratagrid.operators.locality import locality
from stratagrid.plans import assessment
from stratagrid.sources import binding, containers, records, sinks
from stratagrid.streaming import ingest

from .builders import probe, pvar


def granules(spark, rows):
    """(collection, id, day, orbit, revision day)"""
    day = dt.datetime(2020, 1, 1)
    return spark.createDataFrame([(c, g, day + dt.timedelta(days=d), o, day + dt.timedelta(days=r)) for c, g, d, o, r in rows], "collection_id string, granule_id bigint, begin_time timestamp, orbit string, revision_date timestamp")


def ids(df):
    return sorted(r.granule_id for r in df.collect())


def test_ends_windows_and_union(spark):
    g = granules(spark, [("c", i, i * 10, "A", 100 - i) for i in range(20)])
    assert ids(sampling.first_and_last(g, "begin_time", 2)) == [0, 1, 18, 19]
    assert ids(sampling.first_and_last(g, "revision_date", 1)) == [0, 19]
    short = granules(spark, [("s", 1, 0, "", 0), ("s", 2, 4, "", 0)])
    assert ids(sampling.first_and_last(short, "begin_time", 2)) == [1, 2] and ids(sampling.interior(short)) == []
    span = spark.createDataFrame([("c", dt.date(2020, 1, 1), dt.date(2020, 1, 1) + dt.timedelta(days=190))], "collection_id string, t0 date, t1 date")
    assert [(r.lo - dt.date(2020, 1, 1)).days for r in sampling.windows(span).orderBy("slice").collect()] == [38, 76, 114, 152]
    half = spark.createDataFrame([("c", dt.date(2020, 1, 1), dt.date(2020, 1, 1) + dt.timedelta(days=29))], "collection_id string, t0 date, t1 date")
    assert [(r.lo - dt.date(2020, 1, 1)).days for r in sampling.windows(half, 1).collect()] == [14]  # 14.5 to even
    assert ids(sampling.interior(g)) == [4, 8, 12, 16]
    got = sampling.sample(g).orderBy("place").collect()
    assert [r.granule_id for r in got] == [0, 1, 4, 8, 12, 16, 18, 19] and [r.place for r in got] == list(range(1, 9))


def test_opposite_orbit(spark):
    rows = [("c", i, i, "D" if i in (5, 7, 9) else "A", i) for i in range(60)] + [("late", 100 + i, i, "D" if i == 45 else "A", i) for i in range(60)] + [("none", 200 + i, i, "", i) for i in range(9)]
    g = granules(spark, rows)
    picked = g.where("granule_id % 100 < 2")
    assert ids(sampling.opposite_orbit(g, picked)) == [5, 7]


def test_assets(spark):
    rows = [("c", 1, ["u/S_B02.tif", "u/S_B03.tif"]), ("c", 2, ["u/T_B03.tif", "u/T_B04.tif"]), ("c", 3, ["u/U_B02.tif", "u/U_B09.tif"]), ("c", 4, ["u/only.tif"])]
    got = {r.granule_id: (r.key, r.url) for r in sampling.pin_asset(spark.createDataFrame(rows, "collection_id string, granule_id bigint, urls array<string>")).collect()}
    assert got == {1: ("B02", "u/S_B02.tif"), 2: (None, "u/T_B03.tif"), 3: ("B02", "u/U_B02.tif"), 4: (None, "u/only.tif")}


def test_names_of_assets_are_split_once(spark):
    rows = spark.createDataFrame([("c", 1, ["u/S_B02.tif", "u/S_B03.tif"]), ("c", 2, ["u/T_B03.tif", "u/2020-01-02_123456_B04.tif?x=1"])], "collection_id string, granule_id bigint, urls array<string>")
    pinned = sampling.pin_asset(rows, containers.settled)
    assert "array_except" not in pinned._jdf.queryExecution().optimizedPlan().toString()
    assert {r.granule_id: (r.key, r.url) for r in pinned.collect()} == {1: (None, "u/S_B02.tif"), 2: ("#+B04", "u/2020-01-02_123456_B04.tif?x=1")}


def test_resume_merge_abandon_latest(spark):
    todo = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "collection_id string, digest string")
    done = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None)], "collection_id string, digest string")
    assert sorted(r.collection_id for r in sampling.resume(todo, done).collect()) == ["b", "c"]
    assert sorted(map(tuple, sampling.merge(todo.na.fill("x"), spark.createDataFrame([("a", "n")], "collection_id string, digest string")).collect())) == [("a", "n"), ("b", "2"), ("c", "x")]
    g = spark.createDataFrame([("c", i, t) for i, t in enumerate(["", "ProbeTimeout", "", "ProbeTimeout"])] + [("d", 0, None), ("d", 1, "")], "collection_id string, gi int, error_type string")
    assert [r.attempted_now for r in sampling.abandoned(g).orderBy("collection_id", "gi").collect()] == [True, True, False, False, True, True]
    assert {r.n: r.v for r in sampling.latest(spark.createDataFrame([("a", "9"), ("a", "10"), ("b", None)], "n string, v string"), "n", "v").collect()} == {"a": "9", "b": None}


def test_locality(spark):
    mib = 1 << 20
    log = [("c", 1, b, 100 * mib) for b in (3, 1, 2, 2, 9)] + [("c", 2, 0, 10), ("c", 3, 50, 10 * mib)]
    got = {r.granule_id: tuple(r)[2:] for r in locality(spark.createDataFrame(log, "collection_id string, granule_id bigint, block_idx bigint, file_bytes bigint")).collect()}
    assert got == {1: (4, 5, 2, 0.75, 0.09), 2: (1, 1, 1, 1.0, 1.0), 3: (1, 1, 1, 0.0, 0.1)}


def test_representatives_and_buckets(spark):
    rows = [("a", 1, "E", "x 1"), ("a", 2, "E", "x 1"), ("a", 3, "E", "x 2"), ("a", 4, None, None), ("b", 5, "E", "x 1"), ("b", 6, "ProbeTimeout", "t"), ("b", 7, "UnicodeDecodeError", "u")]
    r = spark.createDataFrame(rows, "collection_id string, at int, error_type string, error string")
    assert sorted((x["at"], x.n_like_this) for x in diagnosis.representatives(r, "at").collect()) == [(1, 2), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)]
    b = diagnosis.bucketed(r.where("error IS NOT NULL"))
    assert {x.bucket: (x.n_collections, x.n_granules) for x in diagnosis.bucket_counts(b).collect()} == {"OTHER": (2, 4), "DECODING": (1, 1)}
    assert [tuple(x) for x in diagnosis.unnamed(b).collect()] == [("E: x N", 4, 2)]


def test_reader_gaps(spark):
    schema = "collection_id string, pos int, container string, has_findings boolean, n_datasets int, n_bad_fills int, n_multi_scale int, n_unfixed int, filters array<string>, codecs array<string>, n_chunks int, n_compressed int, n_contiguous int, extensions array<string>, all_stored boolean"
    h5 = lambda c, p, fills=0, filters=("gzip",): (c, p, "hdf5", True, 5, fills, 0, 0, list(filters), [], 0, 0, 0, [], None)
    h4 = lambda c, p, codecs=(), chunks=0: (c, p, "hdf4", True, 0, 0, 0, 0, [], list(codecs), chunks, 0, 0, ["LINKED"], None)
    z = lambda c, p, stored: (c, p, "zip", True, 0, 0, 0, 0, [], [], 0, 0, 0, [], stored)
    rows = [h5("ok", 0), h5("ok", 1), h5("fills", 0, 2), h5("lzf", 0, 0, ["lzf"]), h4("h4", 0, ["DEFLATE"], 7), h4("szip", 0, ["SZIP"], 7), h4("open", 0), z("z", 0, True), z("zz", 0, False), h5("part", 0), (*h5("part", 1)[:3], False, *h5("part", 1)[4:]), ("t", 0, "text", True, 0, 0, 0, 0, [], [], 0, 0, 0, [], None)]
    got = {r.collection_id: tuple(r)[1:] for r in diagnosis.reader_gaps(spark.createDataFrame(rows, schema)).collect()}
    assert {k for k, v in got.items() if v[0]} == {"ok", "h4", "z"} and got["ok"][0] == "reader gap: 5 arrays under expressible filters"
    assert got["fills"][1].startswith("2 of 5 arrays") and got["szip"][1].endswith("SZIP") and got["zz"][1] and got["t"][1] and got["lzf"] == (None, None, None)
    assert got["open"][2] == "blocks behind LINKED" and got["part"] == (None, None, None)


def test_text_and_zip_census(spark):
    texts = spark.createDataFrame([(1, "ab\ncd\n"), (2, "a\r\nbcd"), (3, ""), (4, None), (5, "x\n" * 20)], "i int, t string")
    assert [tuple(r)[1:] for r in diagnosis.text_census(texts, "i", "t").orderBy("i").collect()] == [(2, 2, 2, True), (2, 1, 3, False), (0, None, None, False), (0, None, None, False), (12, 1, 1, True)]
    members = spark.createDataFrame([("z", i, i != 40) for i in range(50)], "k string, p int, s boolean")
    assert [tuple(r) for r in diagnosis.zip_census(members, "k", "p", "s").collect()] == [("z", 32, True)]
    found = spark.createDataFrame([("c", 1, ["b", "a"]), ("c", 0, ["b", None, "x"]), ("d", 0, [])], "collection_id string, pos int, datasets array<string>")
    assert [tuple(r) for r in diagnosis.blocking_arrays(found).collect()] == [("c", ["b", "x", "a"])]


def arrays(spark, rows):
    return spark.createDataFrame(rows, "collection_id string, gi int, vi int, name string, overview boolean, shape array<bigint>, chunks array<bigint>")


def test_verification(spark):
    a = arrays(spark, [("c", 0, 0, "v", False, [4, 4], [2, 2]), ("c", 1, 0, "v", False, [4, 4], [4, 4]), ("c", 2, 0, "v", False, [4, 4], [4, 4]), ("c", 0, 1, "o", True, [99, 99], [9, 9]), ("c", 0, 2, "flat", False, [50, 50], []), ("c", 1, 3, "w", False, [4, 6], [2, 2]), ("c", 3, 3, "w", False, [4, 8], [1, 1])])
    assert [tuple(r) for r in verification.largest_array(a).collect()] == [("c", "w", 32)]
    assert {r.name: (r.chunks, r.n) for r in verification.modal_chunk(a).collect()}["v"] == ([4, 4], 2)
    assert {r.name: r.axis for r in verification.varying_axis(a).collect()} == {"v": None, "o": None, "flat": None, "w": 1}
    assert sorted(tuple(r) for r in verification.chunk_only_pairs(a).collect()) == [("c", 0, 1, "v", 16), ("c", 0, 2, "v", 16)]
    x, y = spark.range(5), spark.range(1, 5).union(spark.range(1))
    assert tuple(verification.same_rows(x, y).head()) == (0, 0) and tuple(verification.same_rows(x, spark.range(2).union(spark.range(1))).head()) == (3, 1)
    n = lambda *r: spark.createDataFrame(r, "k string, n bigint")
    assert sorted(map(tuple, verification.drift(n(("a", 5), ("b", 1)), n(("a", 3), ("c", 2)), "k").collect())) == [("a", 3, 5, 2), ("b", 0, 1, 1), ("c", 2, 0, -2)]
    said = spark.createDataFrame([("H2", "Inconsistent chunk shapes!"), ("H3", "inconsistent chunk shapes"), ("G", "they do not line up"), ("H2", None)], "c string, m string")
    assert [r.confirmed for r in verification.refusal_confirms(said, "c", "m").collect()] == [True, False, True, False]


def test_rollups_and_markdown(spark, tmp_path):
    g = spark.createDataFrame([("a", "A", "x|y"), ("b", "F*", ""), ("c", "A", None)], "daac string, grade string, note string")
    assert [tuple(r) for r in reports.center_rollup(g.withColumn("daac", F.lit("d")), "daac").collect()] == [("d", 3, 2, 0, 0, 0, 1)]
    assert [tuple(r) for r in reports.grade_counts(g).collect()] == [("A", 2), ("B", 0), ("C", 0), ("D", 0), ("F*", 1), ("F", 0), ("U", 0)]
    sinks.markdown(g.orderBy("daac"), f"{tmp_path}/md", ["daac", "note"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text.splitlines() == ["| daac | note |", "|---|---|", "| a | x\\|y |", "| b | — |", "| c | — |"]
    sinks.ranked_csv(g, f"{tmp_path}/csv", F.desc("daac"))
    assert [r.daac for r in spark.read.csv(f"{tmp_path}/csv", header=True).collect()] == ["c", "b", "a"]
    sinks.json_by(g, f"{tmp_path}/json", "daac")
    assert spark.read.json(f"{tmp_path}/json").count() == 3 and (tmp_path / "json/daac=a").exists()


def test_files_to_ranking(spark, tmp_path):
    good = probe(pvar("v"), locality={"n_blocks": 1, "contiguous_runs": 1, "leading_fraction": 1.0})
    for name, probes in {"one": [good, good], "two": [{"ok": False, "error_type": "E", "error": "m"}]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"short_name": name, "level": "L3", "probes": probes}, indent=1))
    (tmp_path / "inv.csv").write_text("sensor,short_name,version,level,format,daac,s3_bucket,s3_region,instrument,granules,time_begin,time_end,entry_title\nS,two,1,L3,F,D,,,,5,2001-01-01,present,\"T, x\"\nS,one,1,L3,F,D,,,,5,2001-01-01,present,T\n")
    (tmp_path / "diag").mkdir()
    (tmp_path / "diag/two.json").write_text(json.dumps({"short_name": "two", "diagnoses": [{"container": "zip", "findings": {"all_stored": True}}]}))
    got = assessment.score(spark, f"{tmp_path}/*.json", f"{tmp_path}/inv.csv", f"{tmp_path}/diag/*.json").collect()
    assert [(r.collection_id, r.grade) for r in got] == [("one", "B"), ("two", "F*")] and got[1].entry_title == "T, x" and "reader gap: members are stored" in got[1].blocker
    g = records.granules(records.probes(spark, f"{tmp_path}/*.json"))
    assert g.where("collection_id = 'two'").head().attempted is True
    (tmp_path / "short.csv").write_text((tmp_path / "inv.csv").read_text().rsplit("\n", 2)[0] + "\n")
    with pytest.raises(Exception, match="no inventory row for one"):
        assessment.score(spark, f"{tmp_path}/*.json", f"{tmp_path}/short.csv").collect()


def test_containers(spark, tmp_path):
    (tmp_path / "a.h5").write_bytes(b"\x89HDF\r\n\x1a\n" + b"0" * 20)
    (tmp_path / "b.bin").write_bytes(b"PK")
    assert {r.file: (r.bytes, r.container) for r in containers.sniff_files(spark, f"{tmp_path}/*").collect()} == {"a.h5": (28, "hdf5"), "b.bin": (2, "unknown")}
    assert tuple(containers.cache_bytes(spark, f"{tmp_path}/*").head()) == (2, 30)
    torn = spark.createDataFrame([("k", 0, 3, bytearray(b"abc")), ("k", 3, 3, bytearray(b"ab")), ("k", 6, 1, None)], "url_key string, start int, size int, data binary")
    assert containers.intact(torn).count() == 1


def test_streaming_ingest_adds_once(spark, tmp_path):
    source, table = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    schema = "collection_id string, digest string, v int"
    put = lambda n, rows: (source / n).write_text("\n".join(json.dumps(dict(zip(("collection_id", "digest", "v"), r, strict=True))) for r in rows))
    put("1.json", [("a", "1", 1), ("b", "1", 2)])
    for more in ([("a", "1", 3), ("a", "2", 4), ("a", "2", 4)], None):
        ingest.ingest(spark, str(source), schema, table, f"{tmp_path}/checkpoint").awaitTermination(60)
        if more:
            put("2.json", more)
    assert Counter((r.collection_id, r.digest) for r in spark.read.parquet(table).collect()) == {("a", "1"): 1, ("b", "1"): 1, ("a", "2"): 1}


def test_pairs_are_judged_in_their_row(spark):
    """Neither pairs by array nor a second sum of them: one join of granules, whose rows have their arrays."""
    rows = [("x", gi, 0, name, shape, chunks) for gi, name, shape, chunks in [
        (1, "a", [4, 4], [2, 2]), (1, "b", [8, 4], [2, 2]), (2, "a", [4, 4], [1, 4]), (2, "b", [8, 4], [4, 4]),  # both differ: the larger
        (3, "a", [4, 4], [2, 2]), (3, "b", [9, 4], [4, 4]),  # another shape
        (4, "a", [4, 4], []), (4, "z", [1, 1], [1, 1]),  # a contiguous one says nothing
    ]]
    a = spark.createDataFrame([*rows, (None, 1, 0, "a", [4, 4], [2, 2]), (None, 2, 0, "a", [4, 4], [1, 4])], "collection_id string, gi bigint, vi bigint, name string, shape array<bigint>, chunks array<bigint>")
    found = verification.chunk_only_pairs(a)
    assert [tuple(r) for r in found.collect()] == [("x", 1, 2, "b", 32)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Join") < plan.index("Aggregate")


def test_sample_stores_what_it_reads_again(spark):
    g = spark.range(60).selectExpr("cast(id % 3 as string) AS collection_id", "id AS granule_id", "date_add(date '2020-01-01', cast(id as int)) AS begin_time", "date_add(date '2021-01-01', cast(id * 7 % 60 as int)) AS revision_date", "CASE WHEN id % 3 = 0 AND id BETWEEN 6 AND 9 THEN 'D' ELSE 'A' END AS orbit")
    stored = []

    def write(df, name):
        stored.append(name)
        return spark.createDataFrame(df.collect(), df.schema)

    assert sorted(map(tuple, sampling.sample(g, write=write).collect())) == sorted(map(tuple, sampling.sample(g).collect()))
    assert stored == ["granules", "picked"]


def test_lines_are_sorted_once_for_their_first_and_for_their_granules(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.exists(data):
        pytest.skip("no test tables here")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = binding.arrays(spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(re.findall(r"Sort \[l_orderkey", plan)) == 1
