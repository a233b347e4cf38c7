"""Queries of sampling, names, refusals, rollups, verification, inventory and sources over the bound archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import criteria, diagnosis, facts, grading, reports, sampling, verification
from ..sources import containers
from ..sources.binding import archive, arrays, view
from .catalogue import query
from .criteria_queries import FACTS, GRADE, H2A, H3, PAIRS, PSZ, _q, graded

ID = "collection_id"
c = F.col

# ---- ranking and cells

@query(_q(GRADE, """SELECT collection_id, grade, c_name, CAST(row_number() OVER (ORDER BY list_position(['A', 'B', 'C', 'D', 'F*', 'F', 'U'], grade), c_mktsegment, c_name) AS BIGINT) AS place FROM gr JOIN customer ON c_custkey = collection_id"""))
def ranking(spark: SparkSession, d: str) -> DataFrame:
    """The ranked table. Its places are global by definition; one row for each collection is all that one sort sees."""
    catalog = view(spark, d, "customer").select(c("c_custkey").alias(ID), "c_name", "c_mktsegment")
    g = graded(spark, d).select(ID, "grade").join(catalog, ID)
    return g.select(ID, "grade", "c_name", F.row_number().over(Window.orderBy(grading.grade_order(), "c_mktsegment", "c_name")).cast("long").alias("place"))


@query(_q(PSZ, "SELECT collection_id, coalesce(chunk, '—') AS chunk_shape, st / 1e6 AS chunk_mb FROM op LEFT JOIN psz_d USING (collection_id)"))
def headline_chunk(spark: SparkSession, d: str) -> DataFrame:
    a = archive(spark, d)
    j = a.counts.select(ID).join(criteria.principal_chunks(a), ID, "left")
    return j.select(ID, F.coalesce(s.shape_text(c("chunk")), F.lit(s.DASH)).alias("chunk_shape"), (c("stored") / 1e6).alias("chunk_mb"))


_cells = "CASE WHEN {0} IN ('yes', 'no', 'partial') THEN {0} ELSE '—' END AS {1}"


@query(_q(GRADE, f"""SELECT collection_id, {', '.join(_cells.format('s_' + k, 'cell_' + k) for _, k in PAIRS)},
       CASE WHEN s_h2 = 'no' OR s_h3 = 'no' THEN 'no' WHEN s_h2 = 'unmeasured' OR s_h3 = 'unmeasured' THEN '—' WHEN s_g IN ('yes', 'partial') THEN 'yes' ELSE '—' END AS chunk_cell FROM gr"""))
def status_cells(spark: SparkSession, d: str) -> DataFrame:
    g = graded(spark, d)
    cells = [s.status_cell(c(f"`{n}`.status")).alias(f"cell_{k}") for n, k in PAIRS]
    return g.select(ID, *cells, s.chunk_cell(c("H2.status"), c("H3.status"), c("G.status")).alias("chunk_cell"))


@query("SELECT collection_id, CASE WHEN count(*) FILTER (ok) > 0 THEN median(file_bytes) FILTER (ok) * count(*) / 1e12 END AS volume_tb FROM arch_granule GROUP BY collection_id")
def volume_tb(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "arch_granule")
    return g.groupBy(ID).agg(F.median(F.when(s.opened(c("ok")), c("file_bytes"))).alias("m"), F.count("*").alias("n")).select(ID, (c("m") * c("n") / 1e12).alias("volume_tb"))


@query("SELECT collection_id, coalesce(string_agg(DISTINCT orbit, '/' ORDER BY orbit) FILTER (orbit <> ''), '') AS orbit_dirs, count(*) FILTER (ok) AS n_probed, count(*) FILTER (attempted) AS n_attempted, count(*) AS n_sampled FROM arch_granule GROUP BY collection_id")
def orbit_dirs(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "arch_granule")
    dirs = F.array_join(F.array_sort(F.collect_set(F.when(c("orbit") != "", c("orbit")))), "/")
    return g.groupBy(ID).agg(dirs.alias("orbit_dirs"), F.count_if("ok").alias("n_probed"), F.count_if("attempted").alias("n_attempted"), F.count("*").alias("n_sampled"))


# ---- names

NAMES = r"""
WITH n AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(string_split(string_split(url, '/')[-1], '?')[1], '\d{4}-\d{2}-\d{2}[Tt]\d{2}-\d{2}-\d{2}', '#', 'g'), '\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}', '#', 'g'), '\d{4}-\d{2}-\d{2}', '#', 'g'), '[._-]+'), lambda t: t <> '') AS toks FROM arch_asset),
k AS (SELECT *, list_distinct(list_filter(toks, lambda t: NOT (length(regexp_replace(t, '\D', '', 'g')) >= 6 OR regexp_matches(t, '^[+-]?\d+$')))) AS content FROM n)"""


@query(NAMES + ", f AS (SELECT url, string_split(string_split(url, '/')[-1], '?')[1] AS filename, array_to_string(toks, ' ') AS tokens, array_to_string(list_sort(content), ' ') AS content FROM k) SELECT * FROM f")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    a, u = view(spark, d, "arch_asset"), c("url")
    cut = a.select("url", s.filename_of(u).alias("filename"), s.name_tokens(u).alias("tokens"))
    return cut.select("url", "filename", F.array_join("tokens", " ").alias("tokens"), F.array_join(F.array_sort(s.content_of(c("tokens"))), " ").alias("content"))


@query("SELECT page_id, string_split(string_split(url, '/')[-1], '?')[1] AS filename, substring(sha256(url), 1, 32) AS url_key FROM pages")
def filename_of(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pages")
    return p.select("page_id", s.filename_of(c("url")).alias("filename"), s.url_key(c("url")).alias("url_key"))


KEYED = NAMES + """,
tok AS (SELECT DISTINCT collection_id, granule_id, url, unnest(content) AS t FROM k),
cand AS (SELECT collection_id, granule_id, count(DISTINCT url) AS n FROM k GROUP BY ALL),
sh AS (SELECT collection_id, granule_id, t FROM tok JOIN cand USING (collection_id, granule_id) GROUP BY collection_id, granule_id, t, n HAVING count(*) = n),
own AS (SELECT * FROM tok ANTI JOIN sh USING (collection_id, granule_id, t)),
key AS (SELECT u.collection_id, u.granule_id, u.url, CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(t, '+' ORDER BY t), '') END AS key
        FROM (SELECT DISTINCT collection_id, granule_id, url FROM k) u JOIN cand USING (collection_id, granule_id) LEFT JOIN own ON own.granule_id = u.granule_id AND own.url = u.url GROUP BY u.collection_id, u.granule_id, u.url, n)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "arch_asset").groupBy(ID, "granule_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))


@query(KEYED + " SELECT * FROM key")
def asset_keys(spark: SparkSession, d: str) -> DataFrame:
    u = sampling.with_asset_keys(_candidates(spark, d))
    return u.select(ID, "granule_id", F.explode(F.arrays_zip("urls", "keys")).alias("z")).select(ID, "granule_id", c("z.urls").alias("url"), c("z.keys").alias("key"))


@query(KEYED + """,
off AS (SELECT collection_id, key, count(DISTINCT granule_id) AS n FROM key GROUP BY ALL),
best AS (SELECT DISTINCT ON (collection_id) collection_id, key AS best FROM off ORDER BY collection_id, n DESC, key)
SELECT key.collection_id, granule_id, max(key) FILTER (key = best) AS key, coalesce(max(url) FILTER (key = best), min(url)) AS url FROM key JOIN best USING (collection_id) GROUP BY ALL""")
def pin_asset(spark: SparkSession, d: str) -> DataFrame:
    return sampling.pin_asset(_candidates(spark, d), containers.settled)


@query(NAMES + """,
tok AS (SELECT DISTINCT collection_id, url, unnest(content) AS t FROM k),
cnt AS (SELECT collection_id, count(DISTINCT url) AS n FROM k GROUP BY collection_id)
SELECT cnt.collection_id, coalesce(string_agg(t, ', ' ORDER BY t), '') AS differing FROM cnt LEFT JOIN (SELECT collection_id, t, count(*) AS m FROM tok GROUP BY ALL) x ON x.collection_id = cnt.collection_id AND m < n GROUP BY cnt.collection_id""")
def sample_differs(spark: SparkSession, d: str) -> DataFrame:
    """Content tokens that not all of a collection's urls have: counts by token, so no token set is ever held whole."""
    u = view(spark, d, "arch_asset").select(ID, "url").distinct()
    n = u.groupBy(ID).agg(F.count("*").alias("n"))
    tokens = u.select(ID, F.explode(s.content_tokens(c("url"))).alias("t")).groupBy(ID, "t").agg(F.count("*").alias("m"))
    return n.join(tokens, ID, "left").groupBy(ID).agg(F.array_join(F.array_sort(F.collect_list(F.when(c("m") < c("n"), c("t")))), ", ").alias("differing"))


@query(r"SELECT p_partkey, p_name, p_name LIKE '%a%' AS glob_a, p_type LIKE p_brand || '%' AS glob_brand, regexp_matches(p_brand, '^Brand#.$') AS glob_one FROM part")
def glob_match(spark: SparkSession, d: str) -> DataFrame:
    """Names against globs: a literal one, one from a column, and one in which % and _ would be special to LIKE."""
    p = view(spark, d, "part")
    like = lambda value, pattern: F.expr(f"{value} LIKE {pattern}")
    q = p.withColumn("ga", s.glob_like(F.lit("*a*"))).withColumn("gb", s.glob_like(F.concat(c("p_brand"), F.lit("*"))))
    return q.select("p_partkey", "p_name", like("p_name", "ga").alias("glob_a"), like("p_type", "gb").alias("glob_brand"), c("p_brand").rlike("^Brand#.$").alias("glob_one"))


# ---- sampling: a granule's revision is its first line item's ship date

REV = "WITH rev AS (SELECT g.*, CAST(coalesce((SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = granule_id), begin_time) AS DATE) AS revision_date FROM arch_granule g)"


def _granules(spark: SparkSession, d: str) -> DataFrame:
    ship = view(spark, d, "lineitem").groupBy(c("l_orderkey").alias("granule_id")).agg(F.min("l_shipdate").alias("ship"))
    return view(spark, d, "arch_granule").join(ship, "granule_id", "left").withColumn("revision_date", F.to_date(F.coalesce("ship", "begin_time"))).drop("ship")


ENDS = """
e AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY begin_time, granule_id) AS u, row_number() OVER (PARTITION BY collection_id ORDER BY begin_time DESC, granule_id) AS w,
      row_number() OVER (PARTITION BY collection_id ORDER BY revision_date, granule_id) AS ru, row_number() OVER (PARTITION BY collection_id ORDER BY revision_date DESC, granule_id) AS rw FROM rev),
sp AS (SELECT collection_id, min(CAST(begin_time AS DATE)) AS t0, max(CAST(begin_time AS DATE)) AS t1 FROM rev GROUP BY collection_id),
win AS (SELECT collection_id, i AS slice, t0 + CAST(round_even((t1 - t0) * i / 5.0::DOUBLE, 0) AS INT) AS lo, t0 + CAST(round_even((t1 - t0) * (i + 1) / 5.0::DOUBLE, 0) AS INT) AS hi FROM sp, range(1, 5) r(i) WHERE t1 - t0 > 5),
inn AS (SELECT collection_id, slice, granule_id FROM (SELECT win.collection_id, slice, granule_id, row_number() OVER (PARTITION BY win.collection_id, slice ORDER BY begin_time, granule_id) AS r
        FROM win JOIN rev ON rev.collection_id = win.collection_id AND CAST(begin_time AS DATE) >= lo AND CAST(begin_time AS DATE) < hi) WHERE r = 1)"""


@query(REV + "," + ENDS + " SELECT collection_id, granule_id FROM e WHERE u <= 2 OR w <= 2")
def sample_ends(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_and_last(_granules(spark, d), "begin_time", sampling.PER_END).select(ID, "granule_id")


@query(REV + "," + ENDS + " SELECT collection_id, granule_id FROM e WHERE ru <= 1 OR rw <= 1")
def sample_revision(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_and_last(_granules(spark, d), "revision_date", sampling.PER_REVISION).select(ID, "granule_id")


@query(REV + "," + ENDS + " SELECT collection_id, CAST(slice AS INT) AS slice, CAST(lo AS STRING) AS lo, CAST(hi AS STRING) AS hi FROM win")
def interior_windows(spark: SparkSession, d: str) -> DataFrame:
    spans = view(spark, d, "arch_granule").groupBy(ID).agg(F.min(F.to_date("begin_time")).alias("t0"), F.max(F.to_date("begin_time")).alias("t1"))
    return sampling.windows(spans).select(ID, "slice", c("lo").cast("string").alias("lo"), c("hi").cast("string").alias("hi"))


@query(REV + "," + ENDS + " SELECT collection_id, CAST(slice AS INT) AS slice, granule_id FROM inn")
def sample_interior(spark: SparkSession, d: str) -> DataFrame:
    return sampling.interior(view(spark, d, "arch_granule")).select(ID, "slice", "granule_id")


UNION = ENDS + """,
pk AS (SELECT collection_id, granule_id FROM e WHERE u <= 2 OR w <= 2 OR ru <= 1 OR rw <= 1 UNION SELECT collection_id, granule_id FROM inn),
one AS (SELECT collection_id, min(orbit) AS seen FROM rev SEMI JOIN pk USING (collection_id, granule_id) WHERE orbit <> '' GROUP BY collection_id HAVING count(DISTINCT orbit) = 1),
opp AS (SELECT collection_id, granule_id FROM (SELECT collection_id, granule_id, row_number() OVER (PARTITION BY collection_id ORDER BY begin_time, granule_id) AS k FROM e JOIN one USING (collection_id) WHERE u <= 40 AND orbit <> '' AND orbit <> seen) WHERE k <= 2),
al AS (SELECT * FROM pk UNION SELECT * FROM opp)"""


@query(REV + "," + UNION + " SELECT collection_id, granule_id FROM opp")
def sample_opposite_orbit(spark: SparkSession, d: str) -> DataFrame:
    g = _granules(spark, d)
    picked = sampling.first_and_last(g, "begin_time", 2).select(ID, "granule_id", "orbit").unionByName(sampling.first_and_last(g, "revision_date", 1).select(ID, "granule_id", "orbit")).unionByName(sampling.interior(g).select(ID, "granule_id", "orbit"))
    return sampling.opposite_orbit(g, picked).select(ID, "granule_id")


@query(REV + "," + UNION + " SELECT collection_id, granule_id, row_number() OVER (PARTITION BY collection_id ORDER BY begin_time, granule_id) AS place FROM rev SEMI JOIN al USING (collection_id, granule_id)")
def sample_union(spark: SparkSession, d: str) -> DataFrame:
    g = _granules(spark, d).select(ID, "granule_id", "begin_time", "revision_date", "orbit")
    return sampling.sample(g, write=containers.settled).select(ID, "granule_id", "place")


@query("SELECT p_brand, p_size AS version, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(p_size AS STRING) DESC, p_partkey) AS r FROM part) WHERE r = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "part").withColumn("v", c("p_size").cast("string"))
    return sampling.latest(p.select("p_brand", "v", "p_partkey", "p_size"), "p_brand", "v").select("p_brand", c("p_size").alias("version"), "p_partkey")


@query("SELECT collection_id, granule_id, gi, NOT coalesce(max(CASE WHEN error_type = 'ProbeTimeout' THEN 1 ELSE 0 END) OVER (PARTITION BY collection_id ORDER BY gi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS attempted_now FROM arch_granule")
def abandon_after_timeout(spark: SparkSession, d: str) -> DataFrame:
    return sampling.abandoned(view(spark, d, "arch_granule")).select(ID, "granule_id", "gi", "attempted_now")


DIGEST = "dg AS (SELECT o_custkey AS collection_id, substring(sha256(string_agg(CAST(o_orderkey AS STRING), chr(10) ORDER BY CAST(o_orderkey AS STRING))), 1, 16) AS digest FROM {} GROUP BY o_custkey)"


def _digests(orders: DataFrame) -> DataFrame:
    return orders.groupBy(c("o_custkey").alias(ID)).agg(s.digest(F.collect_list(c("o_orderkey").cast("string"))).alias("digest"))


@query("WITH " + DIGEST.format("orders") + " SELECT * FROM dg")
def sample_digest(spark: SparkSession, d: str) -> DataFrame:
    return _digests(view(spark, d, "orders"))


@query("WITH " + DIGEST.format("orders") + ", " + DIGEST.format("orders WHERE o_orderkey % 97 <> 0").replace("dg AS", "old AS") + " SELECT * FROM dg ANTI JOIN old USING (collection_id, digest)")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "orders")
    return sampling.resume(_digests(o), _digests(o.where("o_orderkey % 97 <> 0")))


@query("SELECT o_custkey AS collection_id, o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'new' ELSE 'old' END AS source FROM orders")
def merge_sample(spark: SparkSession, d: str) -> DataFrame:
    """A fresh sample of some collections takes the place of what was on record for them."""
    o = view(spark, d, "orders").select(c("o_custkey").alias(ID), "o_orderkey")
    return sampling.merge(o.withColumn("source", F.lit("old")), o.where("collection_id % 5 = 0").withColumn("source", F.lit("new")))


# ---- catalog

@query("SELECT o_orderkey AS granule_id, c_name, n_name, coalesce(r_name, '') AS r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def catalog_left_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Inner to the catalog, left to the lookups. nation and region have fixed sizes."""
    get = lambda n: view(spark, d, n)
    regions = F.broadcast(get("region").where("r_regionkey < 3"))
    j = get("orders").join(get("customer"), c("o_custkey") == c("c_custkey")).join(F.broadcast(get("nation")), c("c_nationkey") == c("n_nationkey"), "left").join(regions, c("n_regionkey") == c("r_regionkey"), "left")
    return j.select(c("o_orderkey").alias("granule_id"), "c_name", "n_name", F.coalesce("r_name", F.lit("")).alias("r_name"))


@query("SELECT count(*) AS unresolved, min(c_custkey) AS first_one FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def catalog_join_check(spark: SparkSession, d: str) -> DataFrame:
    lost = view(spark, d, "customer").join(view(spark, d, "orders"), c("o_custkey") == c("c_custkey"), "left_anti")
    return lost.agg(F.count("*").alias("unresolved"), F.min("c_custkey").alias("first_one"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'HDF5+netCDF-4' WHEN c_custkey % 3 = 0 THEN 'HDF5' ELSE 'COG+HDF5' END AS formats, CASE WHEN c_custkey % 4 = 0 THEN 'second' ELSE 'first' END AS archiver, '2001-02-03' AS begin_, CASE WHEN c_custkey % 5 = 0 THEN 'present' ELSE '2004-05-06' END AS end_, CASE WHEN c_custkey % 2 = 0 THEN 'Terra/MODIS,Aqua' ELSE 'Terra/MODIS,Terra/ASTER' END AS instruments FROM customer")
def inventory_fields(spark: SparkSession, d: str) -> DataFrame:
    """A catalog record's fields, reduced to one row: formats, archiving center, span, instruments."""
    k = c("c_custkey")
    arr = lambda *x: F.array(*map(F.lit, x))
    a = F.when(k % 2 == 0, arr("netCDF-4")).when(k % 3 == 0, arr("HDF5")).otherwise(arr("COG", "HDF5"))
    centers = F.array(F.struct(F.lit("first").alias("name"), arr("DISTRIBUTOR").alias("roles")), F.struct(F.lit("second").alias("name"), F.when(k % 4 == 0, arr("archiver")).otherwise(arr("PROCESSOR")).alias("roles")))
    none = F.array().cast("array<struct<begin: string, end: string>>")
    ranges = F.array(F.struct(F.lit("2001-02-03T00:00:00Z").alias("begin"), F.lit("2004-05-06T00:00:00Z").alias("end")))
    extents = F.array(F.struct(none.alias("ranges"), F.lit(False).alias("ongoing")), F.struct(ranges.alias("ranges"), (k % 5 == 0).alias("ongoing")))
    even = F.array(F.struct(F.lit("Terra").alias("name"), arr("MODIS", "MODIS").alias("instruments")), F.struct(F.lit("Aqua").alias("name"), F.array().cast("array<string>").alias("instruments")))
    odd = F.array(F.struct(F.lit("Terra").alias("name"), arr("MODIS", "ASTER").alias("instruments")))
    span = s.temporal_span(extents)
    return view(spark, d, "customer").select("c_custkey", s.formats_union(a, arr("HDF5")).alias("formats"), s.archiver(centers).alias("archiver"), span["begin"].alias("begin_"), span["end"].alias("end_"), s.instruments(F.when(k % 2 == 0, even).otherwise(odd)).alias("instruments"))


# ---- refusals

CLASS = """CASE WHEN error_type = 'ProbeTimeout' THEN 'budget ran out — ' || error WHEN error_type = 'UnicodeDecodeError' THEN 'group name is not UTF-8' WHEN contains(error, 'dimension scales attached') THEN 'several dimension scales on one axis'
  WHEN error_type = 'KeyError' AND contains(error, 'data') THEN 'data-block references unreadable' WHEN contains(error, 'fill_value') AND contains(error, 'got list') THEN 'array fill value on a number'
  WHEN contains(error, 'fill_value') THEN 'text fill value on a number' ELSE error_type || ': ' || substring(error, 1, 90) END"""


@query(f"SELECT event_id, {CLASS} AS class, error_type IN ('ProbeTimeout', 'GenericError') AS ours, error_type = 'GenericError' AS transport, NOT (contains(error, 'probe budget')) AS refusal FROM arch_refusal")
def refusal_class(spark: SparkSession, d: str) -> DataFrame:
    """The class of each refusal, and the three lines that stages draw between files and limits: they differ."""
    r, no = view(spark, d, "arch_refusal"), F.lit(False)
    return r.select("event_id", s.classify_refusal(c("error_type"), c("error")).alias("class"), s.ours(c("error_type"), c("error")).alias("ours"), s.transport_failure(no, c("error_type"), c("error")).alias("transport"), s.is_refusal(no, F.lit(True), F.lit(0), c("error")).alias("refusal"))


@query(f"""SELECT collection_id, string_agg(class, '; ' ORDER BY seen) AS reasons FROM (SELECT collection_id, class, min(event_id) AS seen FROM (SELECT collection_id, event_id,
       CASE WHEN error_type = 'GenericError' THEN 'failed in transport' ELSE {CLASS} END AS class FROM arch_refusal) GROUP BY ALL) GROUP BY collection_id""")
def unopened_reason(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "arch_refusal")
    why = F.when(s.transport_failure(F.lit(False), c("error_type"), c("error")), "failed in transport").otherwise(s.classify_refusal(c("error_type"), c("error")))
    first = r.withColumn("gi", c("event_id")).withColumn("vi", F.lit(0)).withColumn("why", why)
    return facts.distinct_in_order(first, [ID], "why").select(ID, F.array_join("values", "; ").alias("reasons"))


@query("SELECT collection_id, error_type, error, event_id, n_like_this FROM (SELECT *, count(*) OVER (PARTITION BY collection_id, error_type, substring(error, 1, 200)) AS n_like_this, row_number() OVER (PARTITION BY collection_id, error_type, substring(error, 1, 200) ORDER BY event_id) AS r FROM arch_refusal WHERE NOT contains(error, 'probe budget')) WHERE r = 1")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "arch_refusal")
    return diagnosis.representatives(r.where(s.is_refusal(F.lit(False), F.lit(True), F.lit(0), c("error"))), "event_id").select(ID, "error_type", "error", "event_id", "n_like_this")


BUCKETED = "WITH bk AS (SELECT *, CASE WHEN error LIKE '%dimension scales%' THEN 'DIMENSION_SCALES' WHEN error LIKE '%fill_value%' THEN 'FILL_VALUE' WHEN error_type = 'UnicodeDecodeError' THEN 'DECODING' ELSE 'OTHER' END AS bucket FROM arch_refusal WHERE error_type NOT IN ('ProbeTimeout', 'GenericError'))"


@query(BUCKETED + " SELECT bucket, count(DISTINCT collection_id) AS n_collections, count(*) AS n_granules FROM bk GROUP BY bucket")
def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return diagnosis.bucket_counts(diagnosis.bucketed(view(spark, d, "arch_refusal")))


@query(BUCKETED + r" SELECT error_type || ': ' || substring(regexp_replace(error, '\d+', 'N', 'g'), 1, 100) AS error, count(*) AS n_granules, count(DISTINCT collection_id) AS n_collections FROM bk WHERE bucket = 'OTHER' GROUP BY 1")
def unnamed_classes(spark: SparkSession, d: str) -> DataFrame:
    return diagnosis.unnamed(diagnosis.bucketed(view(spark, d, "arch_refusal")))


@query("SELECT event_id, crit, msg, (crit = 'H2' AND contains(lower(msg), 'inconsistent chunk shapes')) OR (crit = 'H3' AND contains(lower(msg), 'partial chunk')) AS confirmed FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'H2' WHEN 1 THEN 'H3' ELSE 'G' END AS crit, CASE event_id % 4 WHEN 0 THEN 'Inconsistent chunk shapes' WHEN 1 THEN 'a partial chunk inside' ELSE error END AS msg FROM arch_refusal)")
def negative_control_phrase(spark: SparkSession, d: str) -> DataFrame:
    e = c("event_id")
    r = view(spark, d, "arch_refusal").select("event_id", F.when(e % 3 == 0, "H2").when(e % 3 == 1, "H3").otherwise("G").alias("crit"), F.when(e % 4 == 0, "Inconsistent chunk shapes").when(e % 4 == 1, "a partial chunk inside").otherwise(c("error")).alias("msg"))
    return verification.refusal_confirms(r, "crit", "msg")


# ---- diagnoses: a supplier is a collection with a few diagnoses, one for each nation's turn

DIAG = """
WITH dg AS (SELECT s_suppkey % 40 AS collection_id, s_suppkey AS pos, CASE s_suppkey % 4 WHEN 0 THEN 'hdf5' WHEN 1 THEN 'hdf4' WHEN 2 THEN 'zip' ELSE CASE WHEN s_suppkey % 40 < 8 THEN 'text' ELSE 'hdf5' END END AS container,
       s_nationkey <> 24 AS has_findings, s_suppkey % 7 + 3 AS n, CASE WHEN s_nationkey = 5 THEN 2 ELSE 0 END AS fills, CASE WHEN s_nationkey = 6 THEN 1 ELSE 0 END AS scales,
       s_nationkey % 3 = 0 AS odd, s_nationkey % 4 AS chunks, s_nationkey <> 7 AS stored FROM supplier)"""


def _diagnoses(spark: SparkSession, d: str) -> DataFrame:
    k, n = c("s_suppkey"), c("s_nationkey")
    container = F.when(k % 4 == 0, "hdf5").when(k % 4 == 1, "hdf4").when(k % 4 == 2, "zip").when(k % 40 < 8, "text").otherwise("hdf5")
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return view(spark, d, "supplier").select(
        (k % 40).alias(ID), k.alias("pos"), container.alias("container"), (n != 24).alias("has_findings"), (k % 7 + 3).alias("n_datasets"), F.when(n == 5, 2).otherwise(0).alias("n_bad_fills"),
        F.when(n == 6, 1).otherwise(0).alias("n_multi_scale"), F.lit(0).alias("n_unfixed"), F.when(n % 3 == 0, arr("gzip", "shuffle")).otherwise(arr("gzip")).alias("filters"),
        F.when((n % 4 == 0), arr()).when(n % 3 == 0, arr("DEFLATE", "SZIP")).otherwise(arr("DEFLATE")).alias("codecs"), (n % 4).alias("n_chunks"), F.lit(0).alias("n_compressed"), F.lit(0).alias("n_contiguous"),
        arr("LINKED").alias("extensions"), (n != 7).alias("all_stored"),
    )


@query(DIAG + """,
x AS (SELECT *, CASE WHEN NOT has_findings THEN false WHEN container = 'hdf5' THEN fills + scales = 0 WHEN container = 'hdf4' THEN NOT (odd AND chunks > 0) AND chunks > 0 WHEN container = 'zip' THEN stored ELSE false END AS good,
      CASE container WHEN 'hdf5' THEN n || ' arrays under expressible filters' WHEN 'hdf4' THEN chunks || ' addressable blocks' ELSE 'members are stored' END AS gap,
      CASE WHEN NOT has_findings THEN NULL WHEN container = 'hdf5' AND fills > 0 THEN fills || ' of ' || n || ' arrays have fill values that do not encode' WHEN container = 'hdf5' AND scales > 0 THEN scales || ' of ' || n || ' arrays have axes with several scales'
           WHEN container = 'hdf4' AND odd AND chunks > 0 THEN 'codecs without a decoder: SZIP' WHEN container = 'zip' AND NOT stored THEN 'members are deflated' WHEN container = 'text' THEN 'text has no byte offsets' END AS part,
      CASE WHEN has_findings AND container = 'hdf4' AND chunks = 0 THEN 'blocks behind LINKED' END AS op FROM dg),
gg AS (SELECT collection_id, string_agg(gap, '; ' ORDER BY p) AS t FROM (SELECT collection_id, gap, min(pos) AS p FROM x WHERE good GROUP BY ALL) GROUP BY collection_id),
pp AS (SELECT collection_id, string_agg(part, '; ' ORDER BY p) AS t FROM (SELECT collection_id, part, min(pos) AS p FROM x WHERE part IS NOT NULL GROUP BY ALL) GROUP BY collection_id),
aa AS (SELECT collection_id, bool_and(good) AS a, arg_min(op, pos) FILTER (op IS NOT NULL) AS o FROM x GROUP BY collection_id)
SELECT collection_id, CASE WHEN a THEN 'reader gap: ' || gg.t END AS reader_gap, pp.t AS file_blocker, o AS open_question FROM aa LEFT JOIN gg USING (collection_id) LEFT JOIN pp USING (collection_id)""")
def reader_gap_sets(spark: SparkSession, d: str) -> DataFrame:
    return diagnosis.reader_gaps(_diagnoses(spark, d))


@query(DIAG + """, sc AS (SELECT collection_id, CASE WHEN collection_id % 3 = 0 THEN 'F' ELSE 'B' END AS grade FROM dg GROUP BY collection_id),
al AS (SELECT collection_id, bool_and(CASE WHEN NOT has_findings THEN false WHEN container = 'hdf5' THEN fills + scales = 0 WHEN container = 'hdf4' THEN NOT (odd AND chunks > 0) AND chunks > 0 WHEN container = 'zip' THEN stored ELSE false END) AS a FROM dg GROUP BY collection_id)
SELECT collection_id, CASE WHEN grade = 'F' AND a THEN 'F*' ELSE grade END AS grade FROM sc JOIN al USING (collection_id)""")
def starred_grades(spark: SparkSession, d: str) -> DataFrame:
    dg = _diagnoses(spark, d)
    base = dg.select(ID).distinct().select(ID, F.when(c(ID) % 3 == 0, "F").otherwise("B").alias("grade"), F.lit("H0: refused").alias("blocker"))
    return grading.starred(base, diagnosis.reader_gaps(dg)).select(ID, "grade")


@query("""WITH h AS (SELECT doc_id, list_slice(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1, 12) AS l FROM documents),
w AS (SELECT doc_id, list_transform(l, lambda x: strlen(rtrim(x, chr(13)))) AS w FROM h)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_lines, CAST(list_min(w) AS BIGINT) AS min_width, CAST(list_max(w) AS BIGINT) AS max_width, len(list_distinct(w)) = 1 AS fixed_width FROM w""")
def text_census(spark: SparkSession, d: str) -> DataFrame:
    return diagnosis.text_census(view(spark, d, "documents"), "doc_id", "text")


@query("SELECT l_orderkey, count(*) AS n_members, bool_and(l_returnflag <> 'R') AS all_stored FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag) AS r FROM lineitem) WHERE r <= 32 GROUP BY l_orderkey")
def zip_all_stored(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag").alias("place"), (c("l_returnflag") != "R").alias("stored"))
    return diagnosis.zip_census(m, "l_orderkey", "place", "stored")


@query("SELECT collection_id, string_agg(dataset, ',' ORDER BY seen) AS arrays FROM (SELECT l_orderkey % 50 AS collection_id, 'v' || l_linenumber AS dataset, min(l_orderkey * 10 + l_linenumber) AS seen FROM lineitem WHERE l_tax >= 0.075 GROUP BY ALL) GROUP BY collection_id")
def blocking_arrays(spark: SparkSession, d: str) -> DataFrame:
    hit = view(spark, d, "lineitem").where("l_tax >= 0.075")
    found = hit.groupBy((c("l_orderkey") % 50).alias(ID), c("l_orderkey").alias("pos")).agg(F.array_sort(F.collect_set(F.concat(F.lit("v"), c("l_linenumber").cast("string")))).alias("datasets"))
    return diagnosis.blocking_arrays(found).select(ID, F.array_join("arrays", ",").alias("arrays"))


# ---- rollups

_roll = " UNION ALL ".join(f"SELECT '{n}' AS criterion, count(*) FILTER (s_{k} = 'yes') AS held, count(*) FILTER (s_{k} = 'partial') AS \"partial\", count(*) FILTER (s_{k} = 'no') AS failed, count(*) FILTER (s_{k} NOT IN ('yes', 'partial', 'no')) AS unsettled FROM gr" for n, k in PAIRS)


@query(_q(GRADE, _roll))
def criterion_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reports.criterion_rollup(graded(spark, d))


@query(_q(GRADE, """SELECT n_name AS center, count(*) AS collections, count(*) FILTER (grade = 'A') AS "A", count(*) FILTER (grade = 'B') AS "B", count(*) FILTER (grade = 'C') AS "C", count(*) FILTER (grade = 'D') AS "D", count(*) FILTER (grade IN ('F', 'F*', 'U')) AS unread
FROM gr JOIN customer ON c_custkey = collection_id JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"""))
def daac_rollup(spark: SparkSession, d: str) -> DataFrame:
    catalog = view(spark, d, "customer").join(F.broadcast(view(spark, d, "nation")), c("c_nationkey") == c("n_nationkey")).select(c("c_custkey").alias(ID), "n_name")
    return reports.center_rollup(graded(spark, d).join(catalog, ID), "n_name")


@query(_q(GRADE, "SELECT x.grade, count(collection_id) AS n FROM (SELECT unnest(['A', 'B', 'C', 'D', 'F*', 'F', 'U']) AS grade) x LEFT JOIN gr ON gr.grade = x.grade GROUP BY x.grade"))
def grade_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.grade_counts(graded(spark, d))


@query("SELECT n_sampled, count(*) AS collections, CAST(sum(n_sampled) AS BIGINT) AS granules, CAST(sum(n_sampled - n_attempted) AS BIGINT) AS abandoned FROM (SELECT collection_id, count(*) AS n_sampled, count(*) FILTER (attempted) AS n_attempted FROM arch_granule GROUP BY ALL) GROUP BY n_sampled")
def sampling_hist(spark: SparkSession, d: str) -> DataFrame:
    return reports.sampling_histogram(facts.opened_counts(view(spark, d, "arch_granule")))


@query("""SELECT CASE WHEN days > 1 THEN 'spans' ELSE 'single' END AS epochs, count(*) AS collections, count(*) FILTER (collection_id % 7 = 0) AS top
FROM (SELECT l_orderkey AS collection_id, count(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM lineitem GROUP BY 1) GROUP BY 1""")
def revision_epochs(spark: SparkSession, d: str) -> DataFrame:
    li = view(spark, d, "lineitem").select(c("l_orderkey").alias(ID), "l_shipdate")
    grades = li.select(ID).distinct().withColumn("grade", F.when(c(ID) % 7 == 0, "A").otherwise("B"))
    return reports.revision_epochs(li, grades, "l_shipdate")


@query(_q(GRADE, """SELECT '| ' || collection_id || ' | ' || grade || ' | ' || replace(CASE WHEN blocker = '' THEN '—' ELSE blocker END, '|', '\\|') || ' |' AS line FROM gr"""))
def markdown_table(spark: SparkSession, d: str) -> DataFrame:
    return reports.markdown_rows(graded(spark, d), [ID, "grade", "blocker"])


# ---- verification

@query("SELECT collection_id, name, d0 * d1 AS elements FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY d0 * d1 DESC, gi, name) AS r FROM arch_var) WHERE r = 1")
def largest_var(spark: SparkSession, d: str) -> DataFrame:
    return verification.largest_array(arrays(spark, d))


@query("SELECT collection_id, name, c0 || '×' || c1 AS chunks, n FROM (SELECT *, row_number() OVER (PARTITION BY collection_id, name ORDER BY n DESC, seen) AS r FROM (SELECT collection_id, name, c0, c1, count(*) AS n, min(gi) AS seen FROM arch_var GROUP BY ALL)) WHERE r = 1")
def modal_chunk(spark: SparkSession, d: str) -> DataFrame:
    return verification.modal_chunk(arrays(spark, d)).withColumn("chunks", s.shape_text(c("chunks")))


@query("SELECT collection_id, name, CAST(CASE WHEN count(DISTINCT d0) > 1 THEN 0 WHEN count(DISTINCT d1) > 1 THEN 1 END AS BIGINT) AS axis FROM arch_var GROUP BY ALL")
def varying_axis(spark: SparkSession, d: str) -> DataFrame:
    return verification.varying_axis(arrays(spark, d))


@query("""SELECT collection_id, gi_a, gi_b, arg_min(name, -d0 * d1 * 1000000 + rn) FILTER (dif) AS name, max(d0 * d1) FILTER (dif) AS elements FROM (
  SELECT a.collection_id, a.gi AS gi_a, b.gi AS gi_b, a.name, a.d0, a.d1, a.d0 = b.d0 AND a.d1 = b.d1 AS same, a.c0 <> b.c0 OR a.c1 <> b.c1 AS dif, dense_rank() OVER (ORDER BY a.name) AS rn
  FROM arch_var a JOIN arch_var b ON a.collection_id = b.collection_id AND a.name = b.name AND a.gi < b.gi) GROUP BY ALL HAVING bool_and(same) AND bool_or(dif)""")
def h2_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return verification.chunk_only_pairs(arrays(spark, d))


@query("SELECT coalesce(a.k, b.k) AS o_custkey, coalesce(b.n, 0) AS recorded, coalesce(a.n, 0) AS live, coalesce(a.n, 0) - coalesce(b.n, 0) AS drift FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) b ON a.k = b.k")
def catalog_drift(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "orders")
    count = lambda x: x.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return verification.drift(count(o), count(o.where("o_orderstatus <> 'P'")), "o_custkey")


@query("SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right")
def roundtrip_equal(spark: SparkSession, d: str) -> DataFrame:
    """One cube read two ways: from lineitem directly, and through a partitioned table that was written."""
    li = view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return verification.same_rows(li, containers.round_trip(li, "l_linenumber"))


@query("SELECT collection_id, granule_id, name, c0 * c1 * CASE dtype WHEN 'float64' THEN 8 WHEN 'float32' THEN 4 ELSE 2 END AS decoded_bytes, CAST(d0 // 2 - 2 AS BIGINT) AS b0, CAST(d0 // 2 + 2 AS BIGINT) AS e0 FROM arch_var")
def hand_chunk(spark: SparkSession, d: str) -> DataFrame:
    a = verification.chunk_bytes(arrays(spark, d)).withColumn("block", s.interior_block(c("shape")))
    return a.select(ID, "granule_id", "name", "decoded_bytes", c("block")[0]["start"].alias("b0"), c("block")[0]["end"].alias("e0"))


@query(_q(GRADE, "SELECT collection_id, grade, CASE WHEN contains(blocker, ':') THEN trim(split_part(blocker, ':', 1)) END AS criterion FROM gr"))
def deciding_criterion(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select(ID, "grade", s.criterion_of(c("blocker")).alias("criterion"))


@query(_q(GRADE, "SELECT collection_id, grade, blocker FROM gr JOIN op USING (collection_id) WHERE grade IN ('D') AND n_opened >= 2 AND starts_with(blocker, 'H2:') ORDER BY collection_id LIMIT 1"))
def pick_control(spark: SparkSession, d: str) -> DataFrame:
    a = graded(spark, d).join(facts.opened_counts(view(spark, d, "arch_granule")), ID)
    return verification.pick(a, ["D"], "H2").select(ID, "grade", "blocker")


# ---- sources

@query()
def magic_sniff(spark: SparkSession, d: str) -> DataFrame:
    """The container of each of the tables' files, from its first bytes; Parquet is none of those that are known."""
    return containers.sniff_files(spark, f"{d}/*.parquet")


@query("""SELECT CAST(user_id AS BIGINT) AS user_id, CASE WHEN k >= 32767 THEN 'none' ELSE 'EPSG:' || k END AS crs, overview FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 'band' ELSE 'overview' || (event_id % 3) END AS overview FROM events)""")
def tiff_layout(spark: SparkSession, d: str) -> DataFrame:
    """Projection keys and the names of pages: the first is the band, the others are overviews."""
    e = view(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (c("event_id") % 3).alias("page"))
    code = F.when(c("k") >= 32767, 32767).otherwise(c("k"))
    return e.select("user_id", s.tiff_crs(code, F.lit(None).cast("long"), F.when(code == 32767, "none")).alias("crs"), F.when(c("page") == 0, "band").otherwise(F.concat(F.lit("overview"), c("page").cast("string"))).alias("overview"))
