"""Each criterion, branch by branch, over small archives. One archive holds a criterion's cases, so one job runs them all."""

import duckdb

from stratagrid.operators import criteria, facts, grading, grid
from stratagrid.plans import assessment

from .builders import archive, documents, notes, probe, pvar, refusal, statuses


def test_ranking_and_principal(spark):
    small = [pvar("small"), pvar("lat", shape=[1000, 1000]), pvar("metadata/orbit", shape=[999, 999]), pvar("ov", overview=True, shape=[900, 900]), pvar("text", dtype="StringDType()", shape=[900, 900])]
    a = archive(spark, {"one": [probe(pvar("big", shape=[100, 100]), *small)], "two": [probe(pvar("shared", shape=[100, 100])), probe(pvar("shared", shape=[100, 100]), pvar("only_a", shape=[200, 200]))], "ties": [probe(pvar("b"), pvar("a"), pvar("a"))]})
    names = {}
    for r in a.ranks.orderBy("rank").collect():
        names.setdefault(r.collection_id, []).append(r.name)
    assert names == {"one": ["big", "small"], "two": ["only_a", "shared"], "ties": ["a", "b"]}
    assert dict(map(tuple, facts.principal(a.ranks).collect())) == {"one": "big", "two": "shared", "ties": "a"}
    assert {(r.collection_id, r.name) for r in facts.universal(a.ranks, a.granules).collect()} == {("one", "big"), ("one", "small"), ("two", "shared"), ("ties", "b")}


def test_h0(spark):
    v = pvar("v")
    cases = {
        "yes": [probe(v)], "no": [refusal("E", "m")], "partial": [probe(v), refusal("ValueError", "fill_value got list")], "empty": [probe()], "net": [probe(v), refusal("ConnectionError", "x")],
        "budget": [refusal("ProbeTimeout", "t"), refusal("ProbeTimeout", "not attempted", attempted=False)], "copy": [refusal("E", "over the copy-to-disk limit")],
    }
    found = criteria.h0_parse(archive(spark, cases))
    assert statuses(found) == {"yes": "yes", "no": "no", "partial": "partial", "empty": "no", "net": "yes", "budget": "unmeasured", "copy": "unmeasured"}
    assert notes(found)["partial"] == "1/2 opened; array fill value on a number" and "1 out of budget" in notes(found)["budget"]


def test_h2(spark):
    a, b = pvar("v", shape=[10, 20], chunks=[5, 20]), pvar("v", chunks=[4, 20])
    big = pvar("big", shape=[100, 100])
    whole = pvar("v", shape=[10, 20], chunks=[])
    cases = {"same": [probe(a), probe(a)], "differs": [probe(a), probe(b)], "small": [probe(big, a), probe(big, b)], "one": [probe(a)], "closed": [refusal("E", "m")], "whole": [probe(whole), probe(whole)]}
    ar = archive(spark, cases)
    assert statuses(criteria.h2_chunks(ar)) == {"same": "yes", "differs": "no", "small": "partial", "one": "unmeasured", "closed": "unmeasured", "whole": "yes"}
    assert notes(criteria.h2_chunks(ar))["differs"] == "chunk shape differs in 1 of 1 variables: v [5, 20] vs [4, 20]"
    for status, want in (("yes", "yes"), ("unknown", "partial"), ("no", "partial")):
        g = ar.counts.selectExpr("collection_id", f"'{status}' AS status", "'' AS note")
        got = statuses(criteria.h2_chunks(ar, g))
        assert got["whole"] == want and got["same"] == "yes"


def test_first_seen_order_is_the_sample_s(spark):
    rows = [probe(pvar("v", chunks=[k, 20])) for k in (9, 1, 5, 1)]
    assert notes(criteria.h2_chunks(archive(spark, {"c": rows})))["c"].endswith("[9, 20] vs [1, 20] vs [5, 20]")


def test_h3(spark):
    v = lambda n, c=5, m=20: pvar("v", shape=[n, m], chunks=[c, 20])
    cases = {
        "same": [v(10), v(10)], "multiple": [v(10), v(15)], "risk": [v(10), v(12)], "blocked": [v(10), v(12), v(13)], "axes": [v(10), v(15, m=40)], "unstable": [v(10), v(12, 6)],
        "flat": [pvar("v", shape=[], chunks=[]), pvar("v", shape=[], chunks=[])], "rank": [v(10), pvar("v", shape=[12], chunks=[5])],
    }
    found = criteria.h3_concat(archive(spark, {k: [probe(x) for x in xs] for k, xs in cases.items()}))
    assert statuses(found) == {"same": "yes", "multiple": "yes", "risk": "partial", "blocked": "no", "axes": "no", "unstable": "yes", "flat": "unmeasured", "rank": "yes"}
    assert "axis 1, 12 in chunks of 5" in notes(found)["blocked"]


def test_h4_h5(spark):
    cases = {"dtype": [probe(pvar("v")), probe(pvar("v", dtype="int16"))], "order": [probe(pvar("v", dtype=">i2")), probe(pvar("v", dtype="int16"))], "same": [probe(pvar("v")), probe(pvar("v"))]}
    assert statuses(criteria.h4_dtypes(archive(spark, cases))) == {"dtype": "no", "order": "no", "same": "yes"}
    big = pvar("big", shape=[100, 100], codecs=[])
    cases = {
        "codec": [probe(pvar("v", codecs=["Zlib"])), probe(pvar("v", codecs=["Shuffle", "Zlib"]))], "none": [probe(pvar("v", codecs=[])), probe(pvar("v", codecs=None))],
        "measurable": [probe(big, pvar("v", codecs=["a"])), probe(big, pvar("v", codecs=["b"]))], "once": [probe(pvar("v", codecs=["a"])), probe(pvar("v", codecs=[]))],
    }
    assert statuses(criteria.h5_codecs(archive(spark, cases))) == {"codec": "no", "none": "unmeasured", "measurable": "no", "once": "unmeasured"}


def test_v_and_m(spark):
    a, b = pvar("a"), pvar("b")
    cases = {"all": [probe(a, b), probe(a, b)], "late": [probe(a), probe(a, b)], "renamed": [probe(a), probe(b)], "one": [probe(a)], "bare": [probe(), probe()]}
    assert statuses(criteria.v_coverage(archive(spark, cases))) == {"all": "yes", "late": "partial", "renamed": "no", "one": "unmeasured", "bare": "unmeasured"}
    store = lambda ds, dt: probe(a, materialize={"dataset": {"ok": ds, "error": "e"}, "datatree": {"ok": dt, "error": ""}})
    cases = {"flat": [store(True, True)], "tree": [store(True, True), store(False, True)], "mixed": [store(True, False), store(False, True)], "neither": [store(False, False)], "absent": [probe(a)], "closed": [refusal("E", "m")]}
    assert statuses(criteria.m_materialises(archive(spark, cases))) == {"flat": "yes", "tree": "partial", "mixed": "partial", "neither": "no", "absent": "unmeasured", "closed": "unmeasured"}


def test_pmd(spark):
    at = lambda n, r: {"n_blocks": n, "contiguous_runs": r, "leading_fraction": 0.5}
    v = pvar("v")
    cases = {"yes": [probe(v, locality=at(2, 1))], "partial": [probe(v, locality=at(40, 5))], "no": [probe(v, locality=at(300, 40))], "closed": [refusal("ProbeTimeout", "t", locality=at(2, 1))], "none": [probe(v)], "zero": [probe(v, locality=at(0, 0))]}
    found = criteria.pmd_locality(archive(spark, cases))
    assert statuses(found) == {"yes": "yes", "partial": "partial", "no": "no", "closed": "no", "none": "unmeasured", "zero": "unmeasured"}
    assert notes(found)["yes"] == "median 2 blocks in 1 runs, 50% leading"


def test_t(spark):
    t = lambda name, *dims: pvar(name, dims=list(dims) if dims else None)
    cases = {
        "shared": [probe(t("a", "Time", "y"), t("b", "time"))], "alone": [probe(t("a", "time"))], "own": [probe(t("a", "time"), t("b", "y"))], "private": [probe(t("a", "day_view_time_x"), t("b", "y"))],
        "variable": [probe(t("obs_time", "y"), t("b", "y"))], "none": [probe(t("a"), t("b"))], "space": [probe(t("a", "y"), t("b", "y"))], "closed": [refusal("E", "m")],
    }
    assert statuses(criteria.t_time(archive(spark, cases))) == {"shared": "yes", "alone": "yes", "own": "partial", "private": "no", "variable": "partial", "none": "no", "space": "no", "closed": "unmeasured"}


def test_s1(spark):
    two = lambda x, y, name="v": [probe(pvar("v"), pvar(name, cf=x)) if name != "v" else probe(pvar("v", cf=x)), probe(pvar("v"), pvar(name, cf=y)) if name != "v" else probe(pvar("v", cf=y))]
    cases = {
        "numbers": two({"scale_factor": 2}, {"scale_factor": 2.0}), "absent": two({}, {"scale_factor": 1}), "scale": two({"scale_factor": 1}, {"scale_factor": 2}), "fill": two({"_FillValue": "AAAA="}, {"_FillValue": "AAAB="}),
        "units": two({"units": "K"}, {"units": "degC"}), "epoch": two({"units": "days since 2000"}, {"units": "days since 2001"}, "time"), "aside": two({"units": "s since 1"}, {"units": "s since 2"}, "metadata/time"), "calendar": two({"calendar": "a"}, {"calendar": "b"}),
    }
    found = criteria.s1_cf(archive(spark, cases))
    assert statuses(found) == {"numbers": "yes", "absent": "yes", "scale": "no", "fill": "no", "units": "partial", "epoch": "no", "aside": "yes", "calendar": "yes"}
    assert notes(found)["scale"] == "decoded values differ: v.scale_factor: 1.0 vs 2.0"


def test_psz(spark):
    v = lambda **m: [probe(pvar("v", **m))]
    cases = {"large": v(chunk_bytes_median=2e6), "fair": v(chunk_bytes_median=1e5), "few": v(chunk_bytes_median=1e3, n_chunks=3), "many": v(chunk_bytes_median=1e3, n_chunks=500), "impossible": v(chunk_bytes_median=16, shape=[2400, 2400], chunks=[2400, 2400]), "closed": [refusal("E", "m")]}
    assert statuses(criteria.psz_chunks(archive(spark, cases))) == {"large": "yes", "fair": "partial", "few": "yes", "many": "no", "impossible": "unmeasured", "closed": "unmeasured"}


def test_psz_rounds_as_sql_does(spark):
    """0.5015 MB lies below a tie as a double times 1000, 0.5025 on one; DuckDB's round_even says so too."""
    sizes = [501500, 502500, 503500, 505500]
    found = notes(criteria.psz_chunks(archive(spark, {str(n): [probe(pvar("v", chunk_bytes_median=n))] for n in sizes})))
    want = {str(n): f"v: median chunk {duckdb.connect().execute(f'SELECT round_even({n}.0::DOUBLE / 1e6, 3)::DOUBLE').fetchone()[0]} MB in 4 chunks" for n in sizes}
    assert found == want and "0.501 MB" in want["501500"]


def test_grid_from_coordinates_extents_attributes(spark):
    at = lambda first, step=0.25, n=720: probe(pvar("v"), coords={"g/lat": {"n": n, "first": first, "step": step, "last": 0.0}})
    attr = lambda **g: probe(pvar("v", grid=g))
    cases = {
        "equal": [at(-90.0), at(-90.0)], "cells": [at(-90.0), at(-87.5)], "fraction": [at(-90.0), at(-89.9)], "spacing": [at(-90.0), at(-90.0, 0.5)], "length": [at(-90.0), at(-90.0, n=90)], "single": [at(-90.0)],
        "swath": ("L2", [probe(pvar("v"))]), "bare": [probe(pvar("v"))], "coarse": [probe(pvar("v", shape=[100, 100])), probe(pvar("v", shape=[200, 200]))], "longer": [probe(pvar("v", shape=[100, 100])), probe(pvar("v", shape=[150, 100]))],
        "named": [attr(grid_mapping="crs")] * 2, "named2": ("L1B", [attr(grid_mapping="crs")] * 2), "placed": [attr(GeoTransform="1 2")] * 2, "moved": [attr(GeoTransform="1 2"), attr(GeoTransform="1 3")], "root": [probe(pvar("v"), root_attrs={"false_easting": 0})], "closed": [refusal("E", "m")],
    }
    got = statuses(grid.grid_verdict(archive(spark, cases)))
    assert got == {
        "equal": "yes", "cells": "partial", "fraction": "no", "spacing": "no", "length": "no", "single": "unknown", "swath": "no", "bare": "unknown", "coarse": "no", "longer": "unknown",
        "named": "unknown", "named2": "no", "placed": "yes", "moved": "no", "root": "yes", "closed": "unmeasured",
    }


def test_grid_from_tiles(spark):
    tile = lambda x=0.0, y=0.0, crs="EPSG:32610", px=30.0, tied=True: probe(pvar("v"), tiff_grid={"crs": crs, "tiepoint": [0.0, 0.0, 0.0, x, y, 0.0] if tied else None, "pixel_scale": [px, px]})
    cases = {"one": [tile(), tile()], "shifted": [tile(), tile(60)], "off": [tile(), tile(5)], "zones": [tile(), tile(5, crs="EPSG:32611")], "nameless": [tile(crs="")], "loose": [tile(tied=False)], "pixels": [tile(), tile(px=10.0)], "negative": [tile(), tile(-90, -30)]}
    assert statuses(grid.grid_verdict(archive(spark, cases))) == {"one": "yes", "shifted": "partial", "off": "no", "zones": "partial", "nameless": "unknown", "loose": "unknown", "pixels": "no", "negative": "partial"}


def graded(spark, **changed):
    rows = []
    for i, over in enumerate(changed.values()):
        row = {n: ("yes", f"{n} note") for n in [*grading.CRITERIA, "M"]} | {k.replace("_", "-"): (v, f"{k} note") for k, v in over.items()}
        rows.append((list(changed)[i], *(row[n] for n in [*grading.CRITERIA, "M"])))
    schema = "collection_id string, " + ", ".join(f"`{n}` struct<status: string, note: string>" for n in [*grading.CRITERIA, "M"])
    return {r.collection_id: (r.grade, r.blocker) for r in grading.grade(spark.createDataFrame(rows, schema)).collect()}


def test_grade_precedence(spark):
    got = graded(
        spark, a={}, u={"H0": "unmeasured", "H2": "no"}, f={"H0": "no", "H2": "no"}, d2={"H2": "no", "S1": "no"}, d4={"H4": "no"}, d5={"H5": "no"}, d3={"H3": "no"}, c1={"S1": "no"}, c3={"H3": "partial"}, c0={"H0": "partial"},
        costs={"P_md": "partial", "P_sz": "partial"}, b={"H2": "partial", "V": "no", "G": "unknown", "T": "no", "P_md": "no", "S1": "partial"}, unmeasured={"H5": "unmeasured"}, grid={"G": "no"}, m={"M": "no"},
    )
    assert {k: v[0] for k, v in got.items()} == {"a": "A", "u": "U", "f": "F", "d2": "D", "d4": "D", "d5": "D", "d3": "D", "c1": "C", "c3": "C", "c0": "C", "costs": "A", "b": "B", "unmeasured": "B", "grid": "B", "m": "A"}
    assert got["a"][1] == "no blocker" and got["d2"][1] == "H2: H2 note" and got["grid"][1] == "G: G note"
    assert got["b"][1] == "H2: H2 note; V: V note; G: G note; T: T note; P-md: P_md note; S1: S1 note"


def test_end_to_end(spark):
    def granule(**m):
        return probe(pvar("a", dims=["time", "x"], **m), pvar("b", dims=["time", "x"]), locality={"n_blocks": 2, "contiguous_runs": 1, "leading_fraction": 1.0}, coords={"lat": {"n": 3, "first": 0.0, "step": 1.0, "last": 2.0}})

    docs = documents(spark, {"good": [granule(), granule()], "codec": [granule(), granule(codecs=["Blosc"])], "none": [refusal("E", "m")], "late": [refusal("ProbeTimeout", "t")]})
    got = {r.collection_id: r for r in assessment.assess(docs).collect()}
    assert {k: r.grade for k, r in got.items()} == {"good": "A", "codec": "D", "none": "F", "late": "U"}
    assert got["codec"].blocker.startswith("H5: codec chain differs")
    shuffled = {r.collection_id: r for r in assessment.assess(docs.repartition(5)).collect()}
    assert shuffled == got


def test_sums_of_an_array_are_one_row_each(spark):
    """Facts that agree are told from sums of fixed size; texts are made only for the arrays that a note names."""
    a, b, c = pvar("v", dtype="float64"), pvar("v", dtype="float32", codecs=[]), pvar("w", chunks=[4, 20])
    ar = archive(spark, {"x": [probe(a, c), probe(b, pvar("w")), probe(a, c, pvar("once"))], "y": [probe(pvar("v")), probe(pvar("v"))]})
    sums = {(r.collection_id, r.name): r for r in ar.sums.collect()}
    v = sums["x", "v"]
    assert (v.n_records, v.rank, v.n["codec chain"], v.differs["dtype"], v.differs["codec chain"], v.differs["chunk shape"]) == (3, 1, 2, True, False, False)
    assert sums["x", "w"].differs["chunk shape"] and not any(sums["y", "v"].differs)
    got = {(r.collection_id, r.property, r.name): r["values"] for r in ar.values_of(*criteria.properties()).collect()}
    assert got == {("x", "dtype", "v"): ["float64", "float32"], ("x", "chunk shape", "w"): ["[4, 20]", "[5, 20]"]}


def test_stored_arrays_hold_properties_as_flat_text(spark):
    a = archive(spark, {"x": [probe(pvar("v", cf={"scale_factor": "1", "units": "K"})), probe(pvar("v", cf={"units": "degC"}))]})
    wrote = {}
    a.settle(lambda df, name: wrote.setdefault(name, df))
    assert not {"cf", "chunks", "overview"} & set(wrote["arrays"].columns)
    assert sorted((r.said0, r.said3, r.said4, r.said6, r.units) for r in wrote["arrays"].collect()) == [("[5, 20]", "1.0", "0.0", "K", "K"), ("[5, 20]", "1.0", "0.0", "degC", "degC")]
    assert notes(criteria.s1_cf(a)) == {"x": "only labels differ: v.units: K vs degC"}
