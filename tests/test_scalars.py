import pytest
from pyspark.sql import functions as F

from stratagrid.functions import scalars as s


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def values(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", build(F.col("t")).alias("x")).orderBy("i").collect()]


def test_dtype_width(spark):
    cases = {"float32": 4, "Float64": 8, ">f4": 4, "<i2": 2, "|u1": 1, "|S27": 27, "S5": 5, "StringDType()": None, "struct": None, "bool": 1, "complex128": 16, "|b1": 1, "f3": None}
    assert values(spark, cases, s.dtype_width) == list(cases.values())
    assert values(spark, ["|S27", "S1", "float32", None], s.fixed_string) == [True, True, False, False]


def test_array_bytes(spark):
    shape = lambda *x: F.array(*map(F.lit, x)).cast("array<bigint>")
    assert value(spark, s.array_bytes(shape(10, 20), F.lit("float32"))) == 800
    assert value(spark, s.array_bytes(shape(100_000, 100_000), F.lit("f8"))) == 80_000_000_000
    assert value(spark, s.array_bytes(shape(), F.lit("f8"))) is None
    assert value(spark, s.array_bytes(shape(3), F.lit("|S4"))) is None
    assert value(spark, s.array_bytes(shape(3), F.lit("object"))) is None


def test_names(spark):
    assert values(spark, ["a/Lat", "b/XDim", "v", "lat/v"], s.is_coordinate) == [True, True, False, False]
    assert values(spark, ["metadata/x", "a/METADATA/b/c", "a/metadata", "metadatas/x"], s.is_metadata) == [True, True, False, False]
    assert values(spark, ["time", "day_view_time_x", "ntimes2", "sometime", "Times", "n_time"], s.time_named) == [True, True, True, False, True, True]
    assert values(spark, ["time", "day_view_time_x", "ntimes2", "n_time", "TIME1"], s.canonical_time) == [True, False, True, True, True]


def test_stored_bytes(spark):
    shape = F.array(F.lit(2400), F.lit(2400)).cast("array<bigint>")
    stored = lambda b, codec, dtype="int16": value(spark, s.stored_bytes(F.lit(b).cast("long"), shape, F.lit(dtype), F.array(F.lit(codec))))
    assert stored(16, "Zlib") is None and stored(16, "Blosc") == 16 and stored(16, "Zlib", "object") == 16
    assert stored(20_000, "zlib") == 20_000 and stored(0, "Blosc") is None and stored(None, "Blosc") is None


def test_cf_values(spark):
    assert values(spark, ["2", "2.0", "1e3", "1d", "Inf", "K", None], lambda c: s.cf_value(c, "units")) == ["2.0", "2.0", "1000.0", "1d", "Inf", "K", "∅"]
    assert values(spark, [None, "1"], lambda c: s.cf_value(c, "scale_factor")) == ["1.0", "1.0"]


@pytest.mark.parametrize(
    ("kind", "message", "found"),
    [
        ("ProbeTimeout", "x", "budget ran out — x"), ("UnicodeDecodeError", "dimension scales attached", "group name is not UTF-8"), ("KeyError", "'data'", "data-block references unreadable"),
        ("ValueError", "fill_value got list", "array fill value on a number"), ("ValueError", "fill_value", "text fill value on a number"), ("NoParser", "ASCII", "ASCII"),
        ("E", "data type resolution " + "y" * 90, "inexpressible data type — data type resolution " + "y" * 49), ("E", "m" * 100, "E: " + "m" * 90), (None, None, "?: "),
    ],
)
def test_refusals_first_rule_decides(spark, kind, message, found):
    df = spark.createDataFrame([(kind, message)], "k string, m string")
    assert df.select(s.classify_refusal(F.col("k"), F.col("m"))).head()[0] == found


def test_the_three_lines_differ(spark):
    rows = [("NotSupportedError", "x"), ("UnauthenticatedError", "x"), ("E", "lacked valid authentication credentials"), ("E", "copy-to-disk limit"), ("E", "exceeded the probe budget"), ("E", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, m string")
    no, k, m = F.lit(False), F.col("k"), F.col("m")
    got = df.select("i", s.transport_failure(no, k, m), s.ours(k, m), s.is_refusal(no, F.lit(True), F.lit(0), m)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(False, True, True), (True, False, True), (True, False, True), (False, True, False), (False, False, False), (False, False, True)]


def test_tokens(spark):
    url = "https://h/p/PRD_2020-01-02T03-04-05_v02.B04-x.tif?sig=1#f"
    assert values(spark, [url, "https://h/a.nc#frag"], s.filename_of) == ["PRD_2020-01-02T03-04-05_v02.B04-x.tif", "a.nc#frag"]
    assert values(spark, [url], s.name_tokens) == [["PRD", "#", "v02", "B04", "x", "tif"]]
    assert values(spark, ["123456", "a1b2c3d4e5f6", "12", "0x1f", "B04", "#"], s.timestamp_token) == [True, True, True, True, False, False]


def test_globs(spark):
    like = lambda pattern, text: spark.createDataFrame([(pattern, text)], "p string, t string").withColumn("g", s.glob_like(F.col("p"))).selectExpr("t LIKE g").head()[0]
    assert like("A*.nc", "Ax.y.nc") and not like("A*.nc", "Ax.ync") and not like("A_*", "AB") and like("A_*", "A_") and like("50%*", "50% x") and not like("50%*", "500") and like("a\\*", "a\\b")


def test_cells_and_blocks(spark):
    assert values(spark, ["yes", "unknown", None], s.status_cell) == ["yes", "—", "—"]
    cell = lambda *x: value(spark, s.chunk_cell(*map(F.lit, x)))
    assert [cell("no", "yes", "yes"), cell("unmeasured", "no", "yes"), cell("yes", "unmeasured", "yes"), cell("partial", "yes", "partial"), cell("yes", "yes", "unknown")] == ["no", "no", "—", "yes", "—"]
    got = value(spark, s.interior_block(F.array(F.lit(1), F.lit(3), F.lit(100)).cast("array<bigint>")))
    assert [tuple(x) for x in got] == [(0, 1), (0, 3), (48, 52)]
    heads = [b"\x89HDF\r\n\x1a\n", b"\x0e\x03\x13\x01", b"CDF\x01", b"II*\0", b"MM\0*", b"PK\3\4", b""]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(heads)], "i int, b binary")
    assert [r[1] for r in df.select("i", s.sniff(F.col("b"))).orderBy("i").collect()] == ["hdf5", "hdf4", "netcdf3", "tiff", "tiff", "unknown", "unknown"]
    assert [value(spark, s.tiff_crs(F.lit(a), F.lit(b), F.lit(x))) for a, b, x in [(4326, 1, "c"), (32767, 32633, "c"), (32767, None, "c"), (None, None, None)]] == ["EPSG:4326", "EPSG:32633", "c", ""]
