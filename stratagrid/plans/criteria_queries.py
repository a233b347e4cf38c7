"""Queries of array facts, criteria, grid and grade over the bound archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import criteria, facts, grading, grid
from ..operators.locality import locality
from ..sources.binding import archive, arrays, view
from ..sources.containers import settled
from .catalogue import query

ID = "collection_id"

# Facts in SQL: sci, rk, cmp, op, cv are shared by the criteria below.
FACTS = """
WITH sci AS (SELECT v.*, d0 * d1 * CASE dtype WHEN 'float64' THEN 8 WHEN 'float32' THEN 4 ELSE 2 END AS bytes FROM arch_var v WHERE name NOT IN ('metadata/v6', 'grid/lat')),
rk AS (SELECT collection_id, name, max(bytes) AS bytes, count(*) AS n_records, row_number() OVER (PARTITION BY collection_id ORDER BY max(bytes) DESC, name) AS rank FROM sci GROUP BY collection_id, name),
cmp AS (SELECT * FROM rk WHERE n_records >= 2),
op AS (SELECT collection_id, count(*) FILTER (ok) AS n_opened, count(*) AS n_sampled, count(*) FILTER (attempted) AS n_attempted FROM arch_granule GROUP BY collection_id),
cv AS (SELECT sci.*, rank FROM sci JOIN cmp USING (collection_id, name))"""

NOTHING = "WHEN n_opened = 0 THEN 'no granule opened' WHEN m IS NULL THEN 'no data array appears in two opened granules'"


def _differs(cte: str, rows: str, value: str, what: str) -> str:
    """CTE cte(collection_id, status, note) of a property that must agree."""
    return f"""
{cte}_v AS (SELECT collection_id, name, rank, {value} AS x, min(gi) AS seen FROM {rows} GROUP BY ALL),
{cte}_n AS (SELECT collection_id, name, rank, count(*) AS c, string_agg(x, ' vs ' ORDER BY seen) AS xs FROM {cte}_v GROUP BY ALL),
{cte}_d AS (SELECT collection_id, count(*) AS m, count(*) FILTER (c > 1) AS k, arg_min(c, rank) > 1 AS lead,
            arg_min(name, rank) FILTER (c > 1) AS worst, arg_min(xs, rank) FILTER (c > 1) AS xs FROM {cte}_n GROUP BY collection_id),
{cte} AS (SELECT op.collection_id, n_opened, CASE WHEN n_opened = 0 OR m IS NULL THEN 'unmeasured' WHEN k = 0 THEN 'yes' WHEN lead THEN 'no' ELSE 'partial' END AS status,
          CASE {NOTHING} WHEN k = 0 THEN 'one {what} in each of ' || m || ' variables'
               ELSE '{what} differs in ' || k || ' of ' || m || ' variables: ' || worst || ' ' || xs END AS note
          FROM op LEFT JOIN {cte}_d USING (collection_id))"""


H2A = _differs("h2a", "cv", "'[' || c0 || ', ' || c1 || ']'", "chunk shape")
H4 = _differs("h4", "cv", "dtype", "dtype")
H5 = _differs("h5", "cv", "codecs", "codec chain")
H0 = """
h0_g AS (SELECT g.*, NOT ok AND attempted AND error_type = 'ValueError' AS refused,
         CASE WHEN error LIKE '%fill_value%' AND error LIKE '%got list%' THEN 'array fill value on a number' WHEN error LIKE '%same number of dimensions%' THEN 'wrong number of dimension names'
              ELSE error_type || ': ' || error END AS why,
         EXISTS (SELECT 1 FROM arch_var v WHERE v.granule_id = g.granule_id) AS filled FROM arch_granule g),
h0_d AS (SELECT collection_id, count(*) FILTER (ok) AS good, count(*) FILTER (refused) AS bad, count(*) FILTER (ok AND filled) AS f, arg_min(why, gi) FILTER (refused) AS why FROM h0_g GROUP BY collection_id),
h0 AS (SELECT collection_id, CASE WHEN good + bad = 0 THEN 'unmeasured' WHEN good = 0 OR f = 0 THEN 'no' WHEN bad = 0 THEN 'yes' ELSE 'partial' END AS status,
       CASE WHEN good + bad = 0 THEN 'no layout read, 0 out of budget' WHEN good = 0 THEN 'all ' || (good + bad) || ' refused: ' || why WHEN f = 0 THEN good || ' opened without arrays'
            WHEN bad = 0 THEN good || '/' || (good + bad) || ' opened' ELSE good || '/' || (good + bad) || ' opened; ' || why END AS note FROM h0_d)"""
H3 = """
h3_s AS (SELECT collection_id, name FROM cv GROUP BY ALL HAVING count(DISTINCT c0 || 'x' || c1) = 1),
h3_c AS (SELECT collection_id, name, rank, gi, unnest([0, 1]) AS axis, unnest([d0, d1]) AS len, unnest([c0, c1]) AS size FROM cv SEMI JOIN h3_s USING (collection_id, name)),
h3_a AS (SELECT collection_id, name, rank, axis, count(DISTINCT len) AS lens, count(*) FILTER (len % size <> 0) AS off, arg_min(len, gi) FILTER (len % size <> 0) AS len, min(size) AS size FROM h3_c GROUP BY ALL),
h3_n AS (SELECT collection_id, name, rank, count(*) FILTER (lens > 1) AS vary, max(off) FILTER (lens > 1) AS off, arg_min(axis, axis) FILTER (lens > 1) AS axis,
         arg_min(len, axis) FILTER (lens > 1) AS len, arg_min(size, axis) FILTER (lens > 1) AS size FROM h3_a GROUP BY ALL),
h3_k AS (SELECT *, CASE WHEN vary >= 2 THEN 1 WHEN vary = 1 AND off >= 2 THEN 2 WHEN vary = 1 AND off = 1 THEN 3 END AS kind FROM h3_n),
h3_w AS (SELECT DISTINCT ON (collection_id) * FROM h3_k WHERE kind IS NOT NULL ORDER BY collection_id, kind, rank),
h3_d AS (SELECT collection_id, count(*) FILTER (vary > 0) AS varying, count(kind) AS n_off FROM h3_k GROUP BY collection_id),
h3_m AS (SELECT collection_id, count(*) AS m FROM cmp GROUP BY collection_id),
h3_t AS (SELECT op.collection_id, n_opened, m, varying, kind, ' (' || n_off || ' of ' || m || ' variables): ' || name AS o, ' axis ' || (axis + 1) || ', ' || len || ' in chunks of ' || size AS a
         FROM op LEFT JOIN h3_m USING (collection_id) LEFT JOIN h3_d USING (collection_id) LEFT JOIN h3_w USING (collection_id)),
h3 AS (SELECT collection_id, CASE WHEN n_opened = 0 OR m IS NULL THEN 'unmeasured' WHEN kind <= 2 THEN 'no' WHEN kind = 3 THEN 'partial' ELSE 'yes' END AS status,
       CASE WHEN n_opened = 0 THEN 'no granule opened' WHEN m IS NULL THEN 'no data array appears in two opened granules' WHEN kind = 1 THEN 'extents differ on several axes' || o
            WHEN kind = 2 THEN 'partial chunk inside' || o || a WHEN kind = 3 THEN 'one length is no multiple, which only the last may be' || o || a
            WHEN varying > 0 THEN 'lengths that vary are multiples of the chunk' ELSE 'shapes are identical' END AS note FROM h3_t)"""
V = """
v_d AS (SELECT collection_id, n_opened, count(*) AS n, count(*) FILTER (n_records = n_opened) AS uni, arg_min(name, rank) FILTER (n_records <> n_opened) AS worst,
        arg_min(n_records, rank) FILTER (n_records <> n_opened) AS seen, arg_min(name, rank) FILTER (n_records = n_opened) AS span FROM rk JOIN op USING (collection_id) GROUP BY ALL),
v_t AS (SELECT op.collection_id, op.n_opened, n, uni, (n - uni) || ' of ' || n || ' arrays are absent somewhere: ' || worst || ' is in ' || seen || ' of ' || op.n_opened AS t, span FROM op LEFT JOIN v_d USING (collection_id)),
v AS (SELECT collection_id, CASE WHEN n_opened < 2 OR n IS NULL THEN 'unmeasured' WHEN uni = n THEN 'yes' WHEN uni = 0 THEN 'no' ELSE 'partial' END AS status,
      CASE WHEN n_opened < 2 THEN 'fewer than two granules opened' WHEN n IS NULL THEN 'no data array recorded' WHEN uni = n THEN 'all ' || n || ' arrays are in each of ' || n_opened || ' granules'
           WHEN uni = 0 THEN t ELSE t || '; ' || span || ' spans the sample' END AS note FROM v_t)"""
S1 = """
s1_x AS (SELECT collection_id, name, rank, gi, 0 AS k, 'scale_factor' AS key, CASE scale_factor WHEN '0.5' THEN '0.5' ELSE '1.0' END AS x FROM cv
         UNION ALL SELECT collection_id, name, rank, gi, 3, 'units', units FROM cv),
s1_v AS (SELECT collection_id, name, rank, k, key, x, min(gi) AS seen FROM s1_x GROUP BY ALL),
s1_n AS (SELECT collection_id, rank, k, name || '.' || key || ': ' || string_agg(x, ' vs ' ORDER BY seen) AS t FROM s1_v GROUP BY collection_id, name, rank, k, key HAVING count(*) > 1),
s1_d AS (SELECT collection_id, arg_min(t, rank) FILTER (k = 0) AS d, arg_min(t, rank) FILTER (k = 3) AS u FROM s1_n GROUP BY collection_id),
s1_m AS (SELECT collection_id, count(*) AS m FROM cmp GROUP BY collection_id),
s1 AS (SELECT op.collection_id, CASE WHEN n_opened = 0 OR m IS NULL THEN 'unmeasured' WHEN d IS NOT NULL THEN 'no' WHEN u IS NOT NULL THEN 'partial' ELSE 'yes' END AS status,
       CASE WHEN n_opened = 0 THEN 'no granule opened' WHEN m IS NULL THEN 'no data array appears in two opened granules' WHEN d IS NOT NULL THEN 'decoded values differ: ' || d
            WHEN u IS NOT NULL THEN 'only labels differ: ' || u ELSE 'attributes agree over ' || m || ' variables' END AS note
       FROM op LEFT JOIN s1_m USING (collection_id) LEFT JOIN s1_d USING (collection_id))"""
T = """
t_u AS (SELECT collection_id, dim, count(DISTINCT name) AS n_arrays FROM (SELECT collection_id, name, unnest(string_split(dims, ',')) AS dim FROM arch_var WHERE dims IS NOT NULL) GROUP BY ALL),
t_a AS (SELECT collection_id, count(dims) AS n_dimmed FROM arch_var GROUP BY collection_id),
t_d AS (SELECT collection_id, min(dim) FILTER (dim = 'time' AND (n_arrays >= 2 OR n_dimmed <= 1)) AS shared, min(dim) FILTER (dim = 'time') AS lone, count(*) AS n FROM t_u JOIN t_a USING (collection_id) GROUP BY collection_id),
t AS (SELECT op.collection_id, CASE WHEN n_opened = 0 THEN 'unmeasured' WHEN shared IS NOT NULL THEN 'yes' WHEN lone IS NOT NULL THEN 'partial' ELSE 'no' END AS status,
      CASE WHEN n_opened = 0 THEN 'no granule opened' WHEN shared IS NOT NULL THEN 'dimension ' || shared WHEN lone IS NOT NULL THEN lone || ' is a coordinate of no other array'
           WHEN n IS NULL THEN 'no dimension names' ELSE 'no time dimension' END AS note FROM op LEFT JOIN t_d USING (collection_id))"""
RUNS = """
b_u AS (SELECT collection_id, granule_id, block_idx, count(*) AS reads FROM arch_block GROUP BY ALL),
b_l AS (SELECT *, lag(block_idx) OVER (PARTITION BY collection_id, granule_id ORDER BY block_idx) AS before FROM b_u),
b AS (SELECT collection_id, granule_id, count(*) AS n_blocks, CAST(sum(reads) AS BIGINT) AS n_fetches, count(*) FILTER (before IS NULL OR block_idx <> before + 1) AS runs,
      count(*) FILTER (block_idx < 25)::DOUBLE / count(*) AS "leading", (max(block_idx) - min(block_idx) + 1)::DOUBLE / 512 AS span FROM b_l GROUP BY ALL)"""
PMD = RUNS + """,
pmd_d AS (SELECT collection_id, median(n_blocks) AS bl, median(runs) AS ru, median("leading") AS le FROM b GROUP BY collection_id),
pmd_t AS (SELECT op.collection_id, n_opened, bl, ru, 'median ' || CAST(round_even(bl, 0) AS BIGINT) || ' blocks in ' || CAST(round_even(ru, 0) AS BIGINT) || ' runs, ' || CAST(round_even(100 * le, 0) AS BIGINT) || '% leading' AS x FROM op LEFT JOIN pmd_d USING (collection_id)),
pmd AS (SELECT collection_id, CASE WHEN bl IS NULL THEN 'unmeasured' WHEN n_opened = 0 THEN 'no' WHEN ru <= 2 AND bl <= 4 THEN 'yes' WHEN ru <= 8 THEN 'partial' ELSE 'no' END AS status,
        CASE WHEN bl IS NULL THEN 'no block log' WHEN n_opened = 0 THEN x || '; never opened' ELSE x END AS note FROM pmd_t)"""
PRINCIPAL = "pr AS (SELECT collection_id, arg_min(name, CASE WHEN n_records >= 2 THEN rank ELSE 1000000 + rank END) AS principal FROM rk GROUP BY collection_id)"
STORED = "CASE WHEN chunk_bytes_median > 0 AND chunk_bytes_median * 1032 >= c0 * c1 * CASE dtype WHEN 'float64' THEN 8 WHEN 'float32' THEN 4 ELSE 2 END THEN chunk_bytes_median END"
PSZ = f"""
{PRINCIPAL},
psz_d AS (SELECT collection_id, principal, median({STORED}) AS st, median(n_chunks) AS nc, arg_min(c0 || '×' || c1, gi) AS chunk FROM sci JOIN pr USING (collection_id) WHERE name = principal GROUP BY ALL),
psz_t AS (SELECT op.collection_id, n_opened, principal, st, nc, principal || ': median chunk ' || round_even(st / 1e6, 3)::DOUBLE || ' MB in ' || CAST(round_even(nc, 0) AS BIGINT) || ' chunks' AS x FROM op LEFT JOIN psz_d USING (collection_id)),
psz AS (SELECT collection_id, CASE WHEN n_opened = 0 OR st IS NULL THEN 'unmeasured' WHEN st >= 500000 THEN 'yes' WHEN st >= 50000 THEN 'partial' WHEN nc <= 4 THEN 'yes' ELSE 'no' END AS status,
        CASE WHEN n_opened = 0 THEN 'no granule opened' WHEN principal IS NULL THEN 'no data array recorded' WHEN st IS NULL THEN principal || ': no possible chunk length' WHEN st >= 50000 THEN x
             WHEN nc <= 4 THEN x || '; a few requests read it whole' ELSE x || '; bound by latency' END AS note FROM psz_t)"""
G = """
gt_f AS (SELECT collection_id, crs, arg_min(x0, granule_id) AS ox, count(DISTINCT x0) AS origins FROM arch_tiff GROUP BY ALL),
gt_o AS (SELECT collection_id, crs, origins, bool_or(abs(x0 - ox - 30 * round_even((x0 - ox) / 30, 0)) >= 1e-6) AS off FROM arch_tiff JOIN gt_f USING (collection_id, crs) GROUP BY ALL),
gt_s AS (SELECT collection_id, count(DISTINCT coalesce(scale, '')) > 1 AS sizes FROM arch_tiff GROUP BY collection_id),
gt_d AS (SELECT collection_id, any_value(sizes) AS sizes, count(*) AS n, bool_or(crs = '') AS bare, min(crs) FILTER (off) AS bad, CAST(sum(origins) AS BIGINT) AS origins FROM gt_o JOIN gt_s USING (collection_id) GROUP BY collection_id),
g_tiff AS (SELECT collection_id, CASE WHEN sizes THEN 'no' WHEN bare THEN 'unknown' WHEN bad IS NOT NULL THEN 'no' WHEN n > 1 OR origins > 1 THEN 'partial' ELSE 'yes' END AS status,
           CASE WHEN sizes THEN 'pixel sizes differ' WHEN bare THEN 'no projection named' WHEN bad IS NOT NULL THEN 'origins off the lattice in ' || bad ELSE n || ' projections, ' || origins || ' origins' END AS note FROM gt_d),
ge_s AS (SELECT collection_id, name, rank, d0, d1, min(gi) AS seen FROM cv GROUP BY ALL),
ge_r AS (SELECT *, row_number() OVER (PARTITION BY collection_id, name ORDER BY seen) AS k FROM ge_s),
ge_p AS (SELECT a.collection_id, a.name, a.rank, a.d0 AS a0, a.d1 AS a1, b.d0 AS b0, b.d1 AS b1 FROM ge_r a JOIN ge_r b ON a.collection_id = b.collection_id AND a.name = b.name AND a.k = 1 AND b.k = 2),
ge_h AS (SELECT ge_p.* FROM ge_p JOIN op USING (collection_id) WHERE n_opened >= 2 AND (a0 = b0 OR (greatest(a0, b0) % least(a0, b0) = 0)) AND (a1 = b1 OR (greatest(a1, b1) % least(a1, b1) = 0))),
g_extent AS (SELECT DISTINCT ON (collection_id) collection_id, 'no' AS status, name || ' has shapes ' || a0 || '×' || a1 || ' and ' || b0 || '×' || b1 AS note FROM ge_h ORDER BY collection_id, rank),
gc_l AS (SELECT collection_id, name, arg_min(first_v, granule_id) AS o0, arg_min(step_v, granule_id) AS s0 FROM arch_coord GROUP BY ALL),
gc_p AS (SELECT collection_id, name, count(*) AS r, count(DISTINCT step_v) AS st, count(DISTINCT n) AS le, count(DISTINCT first_v) AS orig,
         bool_and(abs(abs((first_v - o0) / s0) - round_even(abs((first_v - o0) / s0), 0)) < 1e-4) AS whole FROM arch_coord JOIN gc_l USING (collection_id, name) GROUP BY ALL),
gc_k AS (SELECT *, CASE WHEN r < 2 THEN NULL WHEN st > 1 THEN 'spacing' WHEN le > 1 THEN 'length' WHEN orig > 1 THEN CASE WHEN whole THEN 'whole cells' ELSE 'part of a cell' END END AS kind FROM gc_p),
gc_d AS (SELECT collection_id, max(r) AS r, min(name) FILTER (kind IS NOT NULL) AS name, arg_min(kind, name) FILTER (kind IS NOT NULL) AS kind, bool_and(kind = 'whole cells') FILTER (kind IS NOT NULL) AS shifted FROM gc_k GROUP BY collection_id),
g_coord AS (SELECT collection_id, CASE WHEN r < 2 THEN 'unknown' WHEN name IS NULL THEN 'yes' WHEN shifted THEN 'partial' ELSE 'no' END AS status,
            CASE WHEN r < 2 THEN 'coordinates of one granule only' WHEN name IS NULL THEN 'same coordinates in ' || r || ' granules' ELSE name || ' differs by ' || kind END AS note FROM gc_d),
g AS (SELECT op.collection_id, CASE WHEN n_opened = 0 THEN 'unmeasured' ELSE coalesce(gt.status, ge.status, gc.status, CASE WHEN level = 'L2' THEN 'no' ELSE 'unknown' END) END AS status,
      CASE WHEN n_opened = 0 THEN 'no granule opened' ELSE coalesce(gt.note, ge.note, gc.note, CASE WHEN level = 'L2' THEN 'swath geometry' ELSE 'grid not seen' END) END AS note
      FROM op LEFT JOIN g_tiff gt USING (collection_id) LEFT JOIN g_extent ge USING (collection_id) LEFT JOIN g_coord gc USING (collection_id) LEFT JOIN arch_level USING (collection_id))"""
H2 = H2A + """,
h2_l AS (SELECT collection_id, arg_min(w, rank) AS w FROM (SELECT collection_id, rank, bool_and(c0 = d0 AND c1 = d1) AS w FROM cv GROUP BY ALL) GROUP BY collection_id),
h2 AS (SELECT h2a.collection_id, CASE WHEN h2a.status = 'yes' AND coalesce(w, false) AND g.status <> 'yes' THEN 'partial' ELSE h2a.status END AS status,
       CASE WHEN h2a.status = 'yes' AND coalesce(w, false) AND g.status <> 'yes' THEN h2a.note || '; each granule is one chunk, and ' || CASE WHEN g.status = 'no' THEN 'without a grid their length may vary' ELSE 'whether a grid fixes their length is not known' END ELSE h2a.note END AS note
       FROM h2a LEFT JOIN h2_l USING (collection_id) LEFT JOIN g USING (collection_id))"""
VERDICTS = ",".join([H0, G, H2, H3, H4, H5, V, S1, PMD, PSZ, T])
PAIRS = [("H0", "h0"), ("H2", "h2"), ("H3", "h3"), ("H4", "h4"), ("H5", "h5"), ("V", "v"), ("S1", "s1"), ("P-md", "pmd"), ("P-sz", "psz"), ("G", "g"), ("T", "t")]
_said = {n: f"'{n}: ' || {c}.note" for n, c in PAIRS}
_of = dict(PAIRS)
_ladder = [("U", "H0", "unmeasured"), ("F", "H0", "no"), ("D", "H2", "no"), ("D", "H4", "no"), ("D", "H5", "no"), ("D", "H3", "no"), ("C", "S1", "no"), ("C", "H3", "partial"), ("C", "H0", "partial")]
_holds = "pmd.status IN ('yes', 'partial') AND psz.status IN ('yes', 'partial') AND " + " AND ".join(f"{_of[n]}.status = 'yes'" for n in ("G", "T", "H2", "H4", "H5", "V", "S1"))
_reasons = "nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {_of[n]}.status IN ({', '.join(repr(x) for x in st)}) THEN {_said[n]} END" for n, st in grading.REASONS) + "), '')"
GRADE = VERDICTS + f""",
gr AS (SELECT op.collection_id, CASE {' '.join(f"WHEN {_of[n]}.status = '{st}' THEN '{g}'" for g, n, st in _ladder)} WHEN {_holds} THEN 'A' ELSE 'B' END AS grade,
       CASE {' '.join(f"WHEN {_of[n]}.status = '{st}' THEN {_said[n]}" for g, n, st in _ladder)} WHEN {_holds} THEN 'no blocker' ELSE coalesce({_reasons}, {_said['G']}) END AS blocker,
       {', '.join(f'{c}.status AS s_{c}' for _, c in PAIRS)}
       FROM op {' '.join(f'JOIN {c} USING (collection_id)' for _, c in PAIRS)})"""


def _q(parts: str, select: str) -> str:
    return FACTS + "," + parts + "\n" + select


def _verdict_sql(cte: str, parts: str) -> str:
    return _q(parts, f"SELECT collection_id, status, note FROM {cte}")


# ---- scalars

DTYPES = "element_at(array('float32', '<f4', '>i2', '|S27', 'StringDType()', 'Float64', 'u1', 'object', 'bool', 'complex128'), CAST(p_partkey % 10 AS INT) + 1)"


@query("""SELECT p_partkey, dtype, CAST(CASE dtype WHEN 'float32' THEN 4 WHEN '<f4' THEN 4 WHEN '>i2' THEN 2 WHEN '|S27' THEN 27 WHEN 'Float64' THEN 8 WHEN 'u1' THEN 1 WHEN 'bool' THEN 1 WHEN 'complex128' THEN 16 END AS BIGINT) AS width,
       dtype = '|S27' AS fixed FROM (SELECT p_partkey, (['float32', '<f4', '>i2', '|S27', 'StringDType()', 'Float64', 'u1', 'object', 'bool', 'complex128'])[p_partkey % 10 + 1] AS dtype FROM part)""")
def dtype_width(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "part").select("p_partkey", F.expr(DTYPES).alias("dtype"))
    return p.select("p_partkey", "dtype", s.dtype_width(F.col("dtype")).alias("width"), s.fixed_string(F.col("dtype")).alias("fixed"))


@query(f"""SELECT collection_id, granule_id, name, d0 * d1 * CASE dtype WHEN 'float64' THEN 8 WHEN 'float32' THEN 4 ELSE 2 END AS bytes, {STORED} AS stored,
       CASE scale_factor WHEN '0.5' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS scale, units FROM arch_var""")
def array_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Bytes, plausible stored chunk and normalised attributes of every array record."""
    a = arrays(spark, d)
    chunk = s.chunks_of(F.col("chunks"), F.col("shape"))
    return a.select(ID, "granule_id", "name", s.array_bytes(F.col("shape"), F.col("dtype")).alias("bytes"), s.stored_bytes(F.col("chunk_bytes_median"), chunk, F.col("dtype"), F.col("codecs")).alias("stored"), s.cf_value(F.element_at("cf", "scale_factor"), "scale_factor").cast("double").alias("scale"), s.cf_value(F.element_at("cf", "units"), "units").alias("units"))


PATHS = ["grid/Time", "day_view_time_x", "ntimes2", "orbit/metadata/x", "Lat", "science/v1", "METADATA/a/b"]


@query(f"""SELECT p_partkey, name, string_split(name, '/')[-1] AS leaf, lower(string_split(name, '/')[-1]) IN ('time', 'x', 'lat') AS coordinate, name IN ('orbit/metadata/x', 'METADATA/a/b') AS metadata,
       regexp_matches(lower(string_split(name, '/')[-1]), '(^|[^a-z0-9])n?times?\\d*([^a-z0-9]|$)') AS timed, regexp_matches(lower(string_split(name, '/')[-1]), '^(n_?)?times?\\d*$') AS canonical
       FROM (SELECT p_partkey, ([{', '.join(repr(x) for x in PATHS)}])[p_partkey % 7 + 1] AS name FROM part)""")
def path_flags(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, PATHS)), (F.col("p_partkey") % 7 + 1).cast("int")).alias("name"))
    n = F.col("name")
    return p.select("p_partkey", "name", s.leaf(n).alias("leaf"), s.is_coordinate(n).alias("coordinate"), s.is_metadata(n).alias("metadata"), s.time_named(s.leaf(n)).alias("timed"), s.canonical_time(s.leaf(n)).alias("canonical"))


# ---- facts


@query(_q(PRINCIPAL, "SELECT rk.collection_id, name, CAST(bytes AS BIGINT) AS bytes, n_records, rank, n_records >= 2 AS comparable, n_records = n_opened AS universal, name = principal AS principal FROM rk JOIN op USING (collection_id) JOIN pr USING (collection_id)"))
def science_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranked data arrays, with whether they are comparable, universal and the principal one."""
    a = archive(spark, d)
    r = a.ranks.join(a.counts, ID).join(facts.principal(a.ranks), ID)
    return r.select(ID, "name", "bytes", "n_records", "rank", (F.col("n_records") >= 2).alias("comparable"), (F.col("n_records") == F.col("n_opened")).alias("universal"), (F.col("name") == F.col("principal")).alias("principal"))


@query(_q(PRINCIPAL, "SELECT collection_id, principal FROM pr"))
def principal_var(spark: SparkSession, d: str) -> DataFrame:
    return facts.principal(archive(spark, d).ranks)


@query(_q("u AS (SELECT collection_id, name, rank FROM rk JOIN op USING (collection_id) WHERE n_records = n_opened)", "SELECT * FROM u"))
def universal_vars(spark: SparkSession, d: str) -> DataFrame:
    a = archive(spark, d)
    return facts.universal(a.ranks, a.granules).select(ID, "name", "rank")


@query(_q("u AS (SELECT collection_id, name, rank FROM cmp)", "SELECT * FROM u"))
def comparable_vars(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).comparable.select(ID, "name", "rank")


# ---- criteria


@query(_verdict_sql("h0", H0))
def h0_parse(spark: SparkSession, d: str) -> DataFrame:
    return criteria.h0_parse(archive(spark, d))


@query(_verdict_sql("h2a", H2A))
def h2_chunk_shape(spark: SparkSession, d: str) -> DataFrame:
    return criteria.h2_chunks(archive(spark, d))


@query(_verdict_sql("h2", G + "," + H2))
def h2_with_grid(spark: SparkSession, d: str) -> DataFrame:
    a = archive(spark, d, whole=True).settle(settled)
    return criteria.h2_chunks(a, grid.grid_verdict(a))


@query(_verdict_sql("h3", H3))
def h3_concat(spark: SparkSession, d: str) -> DataFrame:
    return criteria.h3_concat(archive(spark, d))


@query(_verdict_sql("h4", H4))
def h4_dtype(spark: SparkSession, d: str) -> DataFrame:
    return criteria.h4_dtypes(archive(spark, d))


@query(_verdict_sql("h5", H5))
def h5_codec(spark: SparkSession, d: str) -> DataFrame:
    return criteria.h5_codecs(archive(spark, d))


@query(_verdict_sql("v", V))
def v_coverage(spark: SparkSession, d: str) -> DataFrame:
    return criteria.v_coverage(archive(spark, d))


@query(_verdict_sql("s1", S1))
def s1_cf(spark: SparkSession, d: str) -> DataFrame:
    return criteria.s1_cf(archive(spark, d))


@query(_verdict_sql("t", T))
def t_time_dim(spark: SparkSession, d: str) -> DataFrame:
    return criteria.t_time(archive(spark, d))


@query(_q(T, "SELECT * FROM t_u"))
def shared_dims(spark: SparkSession, d: str) -> DataFrame:
    return criteria.shared_dims(archive(spark, d))


@query(_q(RUNS, "SELECT * FROM b"))
def locality_runs(spark: SparkSession, d: str) -> DataFrame:
    return locality(view(spark, d, "arch_block"))


@query(_verdict_sql("pmd", PMD))
def pmd_locality(spark: SparkSession, d: str) -> DataFrame:
    return criteria.pmd_locality(archive(spark, d, whole=True))


@query(_verdict_sql("psz", PSZ))
def psz_chunk_size(spark: SparkSession, d: str) -> DataFrame:
    return criteria.psz_chunks(archive(spark, d))


@query(_q("""
m_d AS (SELECT collection_id, count(*) AS n, count(*) FILTER (dataset_ok) AS ds, count(*) FILTER (datatree_ok) AS dt FROM arch_store GROUP BY collection_id)""", """
SELECT op.collection_id, CASE WHEN n_opened = 0 OR n IS NULL THEN 'unmeasured' WHEN ds = n THEN 'yes' WHEN dt = n THEN 'partial' WHEN ds = 0 AND dt = 0 THEN 'no' ELSE 'partial' END AS status,
       CASE WHEN n_opened = 0 THEN 'no granule opened' WHEN n IS NULL THEN 'not recorded' ELSE ds || ' of ' || n || ' open as datasets, ' || dt || ' as trees' END AS note FROM op LEFT JOIN m_d USING (collection_id)"""))
def m_materialize(spark: SparkSession, d: str) -> DataFrame:
    return criteria.m_materialises(archive(spark, d, whole=True))


# ---- grid


@query(_verdict_sql("g_coord", G))
def g_coords(spark: SparkSession, d: str) -> DataFrame:
    return grid.coordinate_grid(archive(spark, d, whole=True).coords)


@query(_verdict_sql("g_tiff", G))
def g_tiff(spark: SparkSession, d: str) -> DataFrame:
    return grid.tiff_lattice(archive(spark, d, whole=True).tiffs)


@query(_verdict_sql("g_extent", G))
def g_extent(spark: SparkSession, d: str) -> DataFrame:
    return grid.varying_extent(archive(spark, d))


@query(_verdict_sql("g", G))
def g_precedence(spark: SparkSession, d: str) -> DataFrame:
    return grid.grid_verdict(archive(spark, d, whole=True))


# ---- grade


def graded(spark: SparkSession, d: str) -> DataFrame:
    """All criteria read the same few facts, so those are stored first."""
    return grading.grade(grading.wide(grading.verdicts(archive(spark, d, whole=True).settle(settled), settled)))


@query(_q(GRADE, "SELECT collection_id, grade FROM gr"))
def grade_collection(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select(ID, "grade")


@query(_q(GRADE, "SELECT collection_id, grade, blocker FROM gr"))
def grade_reasons(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select(ID, "grade", "blocker")
