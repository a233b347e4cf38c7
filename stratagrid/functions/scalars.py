"""Row-level expressions over array records, granules, urls and messages. Everything is a Column builder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats' data types, names and limits that decide a verdict.
NAMED_WIDTHS = {
    "int8": 1, "uint8": 1, "bool": 1, "int16": 2, "uint16": 2, "float16": 2, "int32": 4, "uint32": 4, "float32": 4,
    "int64": 8, "uint64": 8, "float64": 8, "complex64": 8, "complex128": 16,
}
CODE_WIDTHS = {"f2": 2, "f4": 4, "f8": 8, "i1": 1, "i2": 2, "i4": 4, "i8": 8, "u1": 1, "u2": 2, "u4": 4, "u8": 8, "b1": 1, "c8": 8, "c16": 16}
COORDINATE_LEAVES = (
    "lat latitude lon longitude x y xdim ydim time delta_time time_bnds time_bounds lat_bnds lon_bnds lat_bounds lon_bounds "
    "latitude_bnds longitude_bnds latitude_bounds longitude_bounds cell_lat cell_lon cell_row cell_column xcoordinates "
    "ycoordinates crs spatial_ref lev level nv bnds vertices wavelength fwhm yearday dayofyear day_of_year doy"
).split()
SPATIAL_LEAVES = "lat latitude lon longitude x y xdim ydim".split()
PROBED_COORDINATES = "lat latitude lon longitude x y time XDim YDim nlat nlon".split()
LOCATING_ATTRIBUTES = "GeoTransform false_easting false_northing standard_parallel latitude_of_projection_origin longitude_of_central_meridian straight_vertical_longitude_from_pole".split()
SWATH_LEVELS = "L1 L1A L1B L2 L2A L2B L2G".split()
TRANSPORT_TYPES = "GenericError ConnectionError TimeoutError PermissionDeniedError UnauthenticatedError".split()
TRANSPORT_TEXTS = ["Generic HTTP error", "error sending request", "lacked valid authentication credentials", "Range request not supported"]
BUDGET_TYPES = ["ProbeTimeout", "ProbeCrash"]
COPY_LIMIT = "copy-to-disk limit"
OURS_TYPES = "ProbeTimeout ProbeCrash GenericError ConnectionError TimeoutError PermissionDeniedError NotSupportedError".split()
OURS_TEXTS = ["copy-to-disk limit", "Range request not supported", "error sending request", "Generic HTTP error"]
DIAGNOSIS_LIMITS = ["probe budget", "copy-to-disk limit", "not attempted", "Range request not supported", "lacked the necessary privileges"]
DEFLATE_BOUND = 1032
SIDECARS = r"(?i)\.(jpg|jpeg|png|gif|xml|txt|met|hdr|cmr\.json)$"
TIMESTAMP_FORMS = [r"\d{4}-\d{2}-\d{2}[Tt]\d{2}-\d{2}-\d{2}", r"\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}", r"\d{4}-\d{2}-\d{2}"]
TIMESTAMP_DIGITS = 6
DASH = "—"


def _map(d: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def dtype_width(dtype: Column) -> Column:
    """Bytes of one element: by name in any case, by code behind a byte-order mark, S<n>; null where it has no fixed width."""
    code = F.regexp_replace(dtype, r"^[><|=]+", "")
    text = F.regexp_extract(code, r"^S(\d+)$", 1)
    return F.coalesce(_map(NAMED_WIDTHS)[F.lower(dtype)], _map(CODE_WIDTHS)[code], F.when(text != "", text.try_cast("int"))).cast("long")


def fixed_string(dtype: Column) -> Column:
    return F.coalesce(dtype.contains("S") & dtype.rlike(r"^[><|=]*S[0-9]+$"), F.lit(False))


def product(values: Column) -> Column:
    """One to three axes are multiplied without a function for each element."""
    at = lambda i: F.get(values, F.lit(i)).cast("long")
    n = F.size(values)
    return F.when(n == 2, at(0) * at(1)).when(n == 3, at(0) * at(1) * at(2)).when(n == 1, at(0)).otherwise(F.aggregate(values, F.lit(1).cast("long"), lambda a, x: a * x.cast("long")))


def array_bytes(shape: Column, dtype: Column) -> Column:
    """Null for an empty shape, text of fixed length, and types without a width."""
    return F.when((F.size(shape) > 0) & ~fixed_string(dtype), product(shape) * dtype_width(dtype))


def leaf(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def is_coordinate(name: Column) -> Column:
    return F.lower(leaf(name)).isin(COORDINATE_LEAVES)


def is_metadata(name: Column) -> Column:
    """A group on the way to the array is named metadata."""
    parts = F.split(F.lower(name), "/")
    return F.lower(name).contains("metadata/") & F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), "metadata")


def chunks_of(chunks: Column, shape: Column) -> Column:
    """A contiguous array is one chunk of its whole shape."""
    return F.when(F.size(chunks) > 0, chunks).otherwise(F.coalesce(shape, F.array().cast("array<bigint>")))


def codecs_of(codecs: Column) -> Column:
    return F.coalesce(codecs, F.array().cast("array<string>"))


def stored_bytes(median: Column, chunk: Column, dtype: Column, codecs: Column) -> Column:
    """The median stored chunk, or null where it is absent, not positive, or less than a deflate stream can be."""
    deflated = F.exists(codecs_of(codecs), lambda c: c.contains("Zlib") | c.contains("Deflate"))
    width = dtype_width(dtype)
    small = deflated & width.isNotNull() & (F.size(chunk) > 0) & (median * DEFLATE_BOUND < product(chunk) * width)
    return F.when((median > 0) & ~F.coalesce(small, F.lit(False)), median)


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CF_DEFAULTS = {"scale_factor": "1.0", "add_offset": "0.0"}
ABSENT = "∅"


def cf_value(raw: Column, key: str) -> Column:
    """Absent attributes take their default, and numbers compare as numbers: 1 and 1.0 are one value."""
    number = F.when(raw.rlike(NUMBER), raw.try_cast("double").cast("string"))
    return F.coalesce(number, raw, F.lit(CF_DEFAULTS.get(key, ABSENT)))


def time_named(name: Column) -> Column:
    return F.lower(name).contains("time") & F.exists(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t.rlike(r"^n?times?\d*$"))


def canonical_time(name: Column) -> Column:
    return F.lower(name).rlike(r"^(n_?)?times?\d*$")


def _any_text(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.coalesce(text.contains(p), F.lit(False))
    return found


def opened(ok: Column) -> Column:
    return F.coalesce(ok, F.lit(False))


def attempted(flag: Column) -> Column:
    """A record that does not say so was attempted."""
    return F.coalesce(flag, F.lit(True))


def transport_failure(ok: Column, error_type: Column, error: Column) -> Column:
    return ~opened(ok) & (F.coalesce(error_type.isin(TRANSPORT_TYPES), F.lit(False)) | _any_text(error, TRANSPORT_TEXTS))


def budget_exhausted(ok: Column, tried: Column, error_type: Column) -> Column:
    return ~opened(ok) & attempted(tried) & F.coalesce(error_type.isin(BUDGET_TYPES), F.lit(False))


def unmeasured(ok: Column, tried: Column, error_type: Column, error: Column) -> Column:
    """Nothing was learnt about the file: network, budget, not attempted, or too large to copy."""
    reasons = transport_failure(ok, error_type, error) | budget_exhausted(ok, tried, error_type) | ~attempted(tried) | _any_text(error, [COPY_LIMIT])
    return ~opened(ok) & reasons


def ours(error_type: Column, error: Column) -> Column:
    """The survey's own limits, as the bucket stage draws the line (unlike transport_failure)."""
    return F.coalesce(error_type.isin(OURS_TYPES), F.lit(False)) | _any_text(error, OURS_TEXTS)


def is_refusal(ok: Column, tried: Column, n_vars: Column, error: Column) -> Column:
    """The diagnosis stage's line: attempted, and either an empty store or a failure that names no limit."""
    return attempted(tried) & F.when(opened(ok), F.coalesce(n_vars, F.lit(0)) == 0).otherwise(~_any_text(error, DIAGNOSIS_LIMITS))


#: Messages that are passed on are passed on whole.
WHOLE = 2**31 - 1
#: (condition on type and message, class, characters of the message to append) in order of precedence.
REFUSALS: list[tuple[str, str, int | None]] = [
    ("type = 'ProbeTimeout'", "budget ran out", WHOLE),
    ("type = 'ProbeCrash'", "reader died", WHOLE),
    ("type = 'UnicodeDecodeError'", "group name is not UTF-8", None),
    ("contains(msg, 'dimension scales attached')", "several dimension scales on one axis", None),
    ("contains(type, 'KeyError') AND contains(msg, 'data')", "data-block references unreadable", None),
    ("contains(msg, 'fill_value') AND contains(msg, 'got list')", "array fill value on a number", None),
    ("contains(msg, 'fill_value')", "text fill value on a number", None),
    ("contains(msg, 'data type resolution')", "inexpressible data type", 70),
    ("contains(msg, 'same number of dimensions')", "wrong number of dimension names", None),
    ("contains(msg, 'copy-to-disk limit')", "copy limit", WHOLE),
    ("contains(msg, 'unrecognized container format')", "no known container signature", None),
    ("contains(type, 'Hdf5FeatureNotSupported')", "filter without a codec", 80),
    ("type = 'NoParser' OR contains(msg, 'no VirtualiZarr parser reads')", "", WHOLE),
    ("contains(msg, 'variable-length')", "variable-length data", None),
]


def classify_refusal(error_type: Column, error: Column) -> Column:
    """The obstruction that a refusal stands for; the first rule that fits decides, and what no rule knows is passed on."""
    out = F.concat(F.coalesce(error_type, F.lit("?")), F.lit(": "), F.substring(F.coalesce(error, F.lit("")), 1, 90))
    for rule, name, keep in reversed(REFUSALS):
        holds = _refusal(rule, {"type": F.coalesce(error_type, F.lit("?")), "msg": F.coalesce(error, F.lit(""))})
        said = F.lit(name) if keep is None else F.concat(F.lit(f"{name} — " if name else ""), F.substring(F.coalesce(error, F.lit("")), 1, keep))
        out = F.when(holds, said).otherwise(out)
    return out


def _refusal(rule: str, p: dict[str, Column]) -> Column:
    out = F.lit(False)
    for either in rule.split(" OR "):
        every = F.lit(True)
        for test in either.split(" AND "):
            if test.startswith("contains("):
                field, text = test[9:-1].split(", ", 1)
                every = every & p[field].contains(text.strip("'"))
            else:
                field, text = test.split(" = ")
                every = every & (p[field] == text.strip("'"))
        out = out | every
    return out


def collapse(error: Column) -> Column:
    return F.substring(F.regexp_replace(error, r"\d+", "N"), 1, 100)


def status_cell(status: Column) -> Column:
    return F.when(status.isin("yes", "no", "partial"), status).otherwise(DASH)


def chunk_cell(h2: Column, h3: Column, grid: Column) -> Column:
    """Do chunks line up: no if either alignment fails; yes if both are settled and a grid places them; else a dash."""
    settled = h2.isin("yes", "partial") & h3.isin("yes", "partial")
    return F.when((h2 == "no") | (h3 == "no"), "no").when(~F.coalesce(settled, F.lit(False)), DASH).when(grid.isin("yes", "partial"), "yes").otherwise(DASH)


def filename_of(url: Column) -> Column:
    """The last part of the path without its query; a fragment stays."""
    return F.substring_index(F.substring_index(url, "/", -1), "?", 1)


def name_tokens(url: Column) -> Column:
    name = filename_of(url)
    for form in TIMESTAMP_FORMS:
        name = F.regexp_replace(name, form, "#")
    return F.filter(F.split(name, "[._-]+"), lambda t: t != "")


def timestamp_token(t: Column) -> Column:
    integer = t.rlike(r"^[+-]?(\d+|0x[0-9a-fA-F]+|0b[01]+|0o[0-7]+)$")
    return ((F.length(t) >= TIMESTAMP_DIGITS) & (F.length(F.regexp_replace(t, r"\D", "")) >= TIMESTAMP_DIGITS)) | integer


def content_of(tokens: Column) -> Column:
    """The distinct tokens of a name that are no timestamps."""
    return F.array_distinct(F.filter(tokens, lambda t: ~timestamp_token(t)))


def content_tokens(url: Column) -> Column:
    return content_of(name_tokens(url))


def glob_like(pattern: Column) -> Column:
    """An anchored LIKE pattern of a glob in which only * is special; the escape is a backslash."""
    return F.replace(F.replace(F.replace(F.replace(pattern, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_")), F.lit("*"), F.lit("%"))


def orbit_letter(text: Column) -> Column:
    return F.upper(F.substring(text, 1, 1))


def data_urls(urls: Column) -> Column:
    """https links that are no sidecar files."""
    return F.filter(urls, lambda u: u.startswith("https") & ~u.rlike(SIDECARS))


def formats_union(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array_union(a, b)), "+")


def first_or_empty(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def split_group(name: Column) -> Column:
    """(group or null, array) at the last slash."""
    group = F.regexp_extract(name, r"^(.*)/[^/]*$", 1)
    return F.struct(F.when(name.contains("/"), group).alias("group"), leaf(name).alias("array"))


def criterion_of(blocker: Column) -> Column:
    return F.when(F.instr(blocker, ":") > 0, F.trim(F.substring_index(blocker, ":", 1)))


def interior_block(shape: Column, size: int = 4) -> Column:
    """(start, end) by axis of a slice near the middle, of `size` cells at most; one cell where there is no more."""

    def axis(n: Column) -> Column:
        start = F.greatest(F.floor(n / 2).cast("long") - size // 2, F.lit(0).cast("long"))
        inner = F.struct(start.alias("start"), F.least(start + size, n).alias("end"))
        return F.when(n <= 1, F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"))).otherwise(inner)

    return F.transform(shape, axis)


def digest(urls: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(urls), "\n"), 256), 1, 16)


def url_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 32)


def shape_text(values: Column, sep: str = "×") -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), sep)


def tiff_crs(code: Column, projection: Column, citation: Column) -> Column:
    """EPSG code unless it is the user-defined 32767, else the projection key, else the citation, else empty."""
    usable = lambda c: F.when(c.isNotNull() & (c != 32767), F.concat(F.lit("EPSG:"), c.cast("string")))
    return F.coalesce(usable(code), usable(projection), citation, F.lit(""))


SIGNATURES = {"hdf5": ["894844460D0A1A0A"], "hdf4": ["0E031301"], "netcdf3": ["434446"], "tiff": ["49492A00", "4D4D002A", "49492B00", "4D4D002B"]}


def sniff(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit("unknown")
    for kind, marks in reversed(SIGNATURES.items()):
        fits = F.lit(False)
        for m in marks:
            fits = fits | head.startswith(m)
        out = F.when(fits, kind).otherwise(out)
    return out


def shown_grade(grade: Column) -> Column:
    """A grade as a table shows it: the best with a star, and no asterisk that Markdown would take for emphasis."""
    return F.when(grade == "A", "A ⭐").when(grade == "F*", "F\\*").otherwise(grade)


def relative_paths(text: Column, places: list[tuple[str, str]]) -> Column:
    """text with each path of places in place of its name, the longest paths first."""
    out = text
    for path, name in sorted(places, key=lambda x: -len(x[0])):
        out = F.replace(out, F.lit(path), F.lit(name))
    return out


# What is copied to disk at most, for probing and for a diagnosis.
COPY_BYTES, DIAGNOSE_BYTES = 800 << 20, 2 << 30


def reading(container: Column, file_bytes: Column) -> Column:
    """How a granule is read: hdf4 is copied first, up to COPY_BYTES, and refused beyond; all else is read by ranges."""
    return F.when(container != "hdf4", "range").when(file_bytes <= COPY_BYTES, "copy").otherwise("refused")


def diagnosis_of(container: Column, file_bytes: Column) -> Column:
    """Which diagnosis a granule gets; larger files are skipped, and containers that none knows have none."""
    return F.when(file_bytes > DIAGNOSE_BYTES, "skipped").when(container.isin("hdf5", "hdf4", "zip", "text"), container).otherwise("none")


def verdict(criterion: str, status: Column, note: Column) -> Column:
    return F.struct(F.lit(criterion).alias("id"), status.alias("status"), note.alias("note"))


def archiver(centers: Column) -> Column:
    """The first data center with an archiver's role, else the first; centers: array of (name, roles)."""
    with_role = F.filter(centers, lambda c: F.exists(c["roles"], lambda r: F.upper(r).contains("ARCHIVER")))
    return F.coalesce(F.get(with_role, F.lit(0))["name"], F.get(centers, F.lit(0))["name"], F.lit(""))


def temporal_span(extents: Column) -> Column:
    """(begin, end) as dates in text of the first extent that has ranges; its end is present if it goes on.

    extents: array of (ranges: array of (begin, end), ongoing).
    """
    first = F.get(F.filter(extents, lambda t: F.size(t["ranges"]) > 0), F.lit(0))
    r = F.get(first["ranges"], F.lit(0))
    day = lambda c: F.coalesce(F.substring_index(c, "T", 1), F.lit(""))
    return F.struct(day(r["begin"]).alias("begin"), F.when(F.coalesce(first["ongoing"], F.lit(False)), "present").otherwise(day(r["end"])).alias("end"))


def instruments(platforms: Column) -> Column:
    """platform/instrument pairs in order, each once, joined by commas; platforms: array of (name, instruments)."""
    pairs = F.transform(platforms, lambda p: F.when(F.size(p["instruments"]) > 0, F.transform(p["instruments"], lambda i: F.concat(p["name"], F.lit("/"), i))).otherwise(F.array(p["name"])))
    return F.array_join(F.array_distinct(F.flatten(pairs)), ",")
