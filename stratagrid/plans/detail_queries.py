"""Queries of layouts, urls, notes and documents that the other modules leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import diagnosis, layout, sampling
from ..sources.binding import view
from .catalogue import query
from .criteria_queries import GRADE, _q, graded
from .report_queries import BUCKETED

ID = "collection_id"
c = F.col


@query("SELECT p_partkey, CAST(len(l) AS BIGINT) AS n, l[1] AS first_url FROM (SELECT p_partkey, list_filter(['https://h/a' || p_partkey || (CASE WHEN p_size % 2 = 0 THEN '.JPG' ELSE '.nc' END), 's3://h/b.nc', 'https://h/c.cmr.json', 'https://h/d' || (CASE WHEN p_size % 3 = 0 THEN '.tif' ELSE '.xml' END)], lambda u: starts_with(u, 'https') AND NOT regexp_matches(u, '(?i)\\.(jpg|jpeg|png|gif|xml|txt|met|hdr|cmr\\.json)$')) AS l FROM part)")
def data_urls(spark: SparkSession, d: str) -> DataFrame:
    """Links of a granule that are https and no sidecar; the first is the granule's."""
    urls = F.array(F.concat(F.lit("https://h/a"), c("p_partkey").cast("string"), F.when(c("p_size") % 2 == 0, ".JPG").otherwise(".nc")), F.lit("s3://h/b.nc"), F.lit("https://h/c.cmr.json"), F.concat(F.lit("https://h/d"), F.when(c("p_size") % 3 == 0, ".tif").otherwise(".xml")))
    p = view(spark, d, "part").select("p_partkey", s.data_urls(urls).alias("u"))
    return p.select("p_partkey", F.size("u").cast("long").alias("n"), F.get("u", F.lit(0)).alias("first_url"))


@query("SELECT DISTINCT name, CASE WHEN contains(name, '/') THEN string_split(name, '/')[1] END AS grp, string_split(name, '/')[-1] AS arr FROM arch_var")
def split_group(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "arch_var").select("name").distinct().withColumn("g", s.split_group(c("name")))
    return v.select("name", c("g.group").alias("grp"), c("g.array").alias("arr"))


NODES = """
WITH nd AS (SELECT r_regionkey AS file, 0 AS id, NULL AS parent, '' AS name, false AS is_array FROM region
  UNION ALL SELECT n_regionkey, 1 + n_nationkey, 0, n_name, n_nationkey % 4 = 0 FROM nation
  UNION ALL SELECT n_regionkey, 100 + s_suppkey, 1 + n_nationkey, 's' || s_suppkey, true FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0)"""


@query(NODES + " SELECT file, name AS path FROM nd WHERE is_array AND parent = 0 UNION ALL SELECT a.file, b.name || '/' || a.name FROM nd a JOIN nd b ON a.parent = b.id AND a.file = b.file WHERE a.is_array AND a.parent > 0")
def flatten_groups(spark: SparkSession, d: str) -> DataFrame:
    """A file's groups and arrays, as nation and supplier below a region."""
    n, sup = view(spark, d, "nation"), view(spark, d, "supplier")
    long = lambda x: x.cast("long")
    root = view(spark, d, "region").select(c("r_regionkey").alias("file"), long(F.lit(0)).alias("id"), F.lit(None).cast("long").alias("parent"), F.lit("").alias("name"), F.lit(False).alias("is_array"))
    groups = n.select(c("n_regionkey").alias("file"), long(c("n_nationkey") + 1).alias("id"), long(F.lit(0)).alias("parent"), c("n_name").alias("name"), (c("n_nationkey") % 4 == 0).alias("is_array"))
    own = sup.join(n, c("s_nationkey") == c("n_nationkey")).where("n_nationkey % 4 <> 0").select(c("n_regionkey").alias("file"), long(c("s_suppkey") + 100).alias("id"), long(c("n_nationkey") + 1).alias("parent"), F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("name"), F.lit(True).alias("is_array"))
    return layout.flatten_groups(root.unionByName(groups).unionByName(own))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'units' ELSE 'scale_factor,units' END AS kept, CASE WHEN c_nationkey % 5 = 0 THEN 'none' ELSE CASE c_custkey % 5 WHEN 0 THEN 'hdf' WHEN 1 THEN 'hdf4' WHEN 2 THEN 'tiff' WHEN 3 THEN 'netcdf3' ELSE 'none' END END AS reader FROM customer")
def attributes_and_readers(spark: SparkSession, d: str) -> DataFrame:
    """Attributes that are kept, and the reader that a container and its declared format call for."""
    attrs = F.create_map(F.lit("units"), F.lit("K"), F.lit("long_name"), F.lit("x"), F.when(c("c_mktsegment") == "BUILDING", "history").otherwise("scale_factor"), F.lit("2"))
    kind = F.element_at(F.array(*map(F.lit, ["hdf5", "hdf4", "tiff", "netcdf3", "unknown"])), (c("c_custkey") % 5 + 1).cast("int"))
    declared = F.when(c("c_nationkey") % 5 == 0, "ascii").otherwise("netCDF-4")
    return view(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(F.map_keys(layout.kept_attributes(attrs))), ",").alias("kept"), layout.reader_for(kind, declared).alias("reader"))


@query("SELECT collection_id, granule_id, gi FROM arch_granule SEMI JOIN (SELECT collection_id, min(gi) AS gi FROM arch_granule GROUP BY 1 UNION SELECT collection_id, max(gi) FROM arch_granule GROUP BY 1) USING (collection_id, gi)")
def coordinate_granules(spark: SparkSession, d: str) -> DataFrame:
    return layout.coordinate_granules(view(spark, d, "arch_granule")).select(ID, "granule_id", "gi")


@query("""WITH v AS (SELECT l_orderkey % 20 AS collection_id, l_orderkey AS granule_id, min(l_partkey) AS vi, CASE l_linenumber WHEN 1 THEN 'lat' WHEN 2 THEN 'g/lon' WHEN 3 THEN 'a/b/time' WHEN 4 THEN 'XDim' WHEN 5 THEN 'xdim' WHEN 6 THEN 'x' ELSE 'g/y' END AS name, max(l_quantity) AS q, l_linenumber FROM lineitem GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY granule_id ORDER BY vi, name) AS r FROM v WHERE l_linenumber NOT IN (3, 5) AND q > 10)
SELECT collection_id, granule_id, name, CAST(3 AS BIGINT) AS n, q AS first_v, 0.5::DOUBLE AS step_v, q + 2.0::DOUBLE AS last_v FROM f WHERE r <= 6""")
def read_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Origin, step and end of coordinate arrays; arrays of one value are no axis."""
    names = F.array(*map(F.lit, ["lat", "g/lon", "a/b/time", "XDim", "xdim", "x", "g/y"]))
    v = view(spark, d, "lineitem").groupBy((c("l_orderkey") % 20).alias(ID), c("l_orderkey").alias("granule_id"), "l_linenumber").agg(F.min("l_partkey").alias("vi"), F.max("l_quantity").cast("double").alias("q"))
    x = F.when(c("q") > 10, F.array(c("q"), c("q") + 0.5, c("q") + 2.0)).otherwise(F.array("q"))
    return layout.read_coordinates(v.select(ID, "granule_id", "vi", F.element_at(names, c("l_linenumber")).alias("name"), x.alias("x")))


@query("""SELECT l_orderkey, count(*) AS n_datasets, count(*) FILTER (l_returnflag <> 'N') AS n_bad_fills, count(*) FILTER (l_linenumber % 3 > 1) AS n_multi_scale, count(*) FILTER (l_linestatus = 'F') AS n_unfixed,
       concat_ws(',', 'gzip:' || nullif(count(*) FILTER (l_quantity > 10), 0), 'shuffle:' || nullif(count(*) FILTER (l_quantity > 30), 0)) AS filters FROM lineitem GROUP BY l_orderkey""")
def dataset_census(spark: SparkSession, d: str) -> DataFrame:
    li = view(spark, d, "lineitem")
    filters = F.array_compact(F.array(F.when(c("l_quantity") > 10, F.lit("gzip")), F.when(c("l_quantity") > 30, F.lit("shuffle"))))
    kind = F.when(c("l_returnflag") == "R", "text").when(c("l_returnflag") == "A", "array").otherwise("scalar")
    return layout.dataset_census(li.select("l_orderkey", kind.alias("fill_kind"), (c("l_linenumber") % 3).alias("max_scales"), F.when(c("l_linestatus") == "F", "object").otherwise("float").alias("dtype_kind"), filters.alias("filters")), "l_orderkey")


@query("""SELECT l_orderkey, count(*) FILTER (l_linestatus <> 'F') AS contiguous, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END) AS BIGINT) AS chunks,
       coalesce(string_agg(DISTINCT CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_tax > 0.04 THEN 'DEFLATE' ELSE 'NONE' END END, ',' ORDER BY CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_tax > 0.04 THEN 'DEFLATE' ELSE 'NONE' END END), '') AS codecs,
       coalesce(string_agg(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_returnflag END, ',' ORDER BY CASE WHEN l_linestatus = 'F' THEN l_returnflag END), '') AS extensions FROM lineitem GROUP BY l_orderkey""")
def tag_census(spark: SparkSession, d: str) -> DataFrame:
    li, ext = view(spark, d, "lineitem"), c("l_linestatus") == "F"
    e = li.select("l_orderkey", ext.alias("extended"), c("l_returnflag").alias("extension"), F.when(ext, c("l_linenumber").cast("long")).alias("n_chunks"), F.when(ext, F.when(c("l_tax") > 0.04, "DEFLATE").otherwise("NONE")).alias("codec"))
    return layout.tag_census(e, "l_orderkey")


@query("SELECT collection_id, granule_name FROM (SELECT o_custkey AS collection_id, o_orderpriority || '.' || o_orderkey || '.nc' AS granule_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderpriority || '.' || o_orderkey || '.nc') AS r FROM orders WHERE o_orderpriority = '1-URGENT') WHERE r <= 2")
def matching_names(spark: SparkSession, d: str) -> DataFrame:
    """The first two granules of each collection whose name fits a glob; its dots are only dots."""
    g = view(spark, d, "orders").select(c("o_custkey").alias(ID), F.concat("o_orderpriority", F.lit("."), c("o_orderkey").cast("string"), F.lit(".nc")).alias("granule_name"), "o_orderdate").withColumn("_pattern", s.glob_like(F.lit("1-*.*.nc")))
    return sampling.matching(g, c("_pattern"), "o_orderdate", 2).select(ID, "granule_name")


# ---- notes of the report: counts and lists by status


@query(_q(GRADE, """SELECT count(*) FILTER (s_h4 = 'no') AS dtype_changes, count(*) FILTER (s_h5 = 'no') AS codec_changes, count(*) FILTER (s_v = 'partial') AS arrays_missing, count(*) FILTER (s_v = 'no') AS arrays_disjoint,
       min(collection_id) FILTER (s_h2 = 'partial') AS partial_example, count(*) FILTER (grade IN ('F', 'F*', 'U')) AS unread, count(*) FILTER (grade = 'D') AS rewritten FROM gr"""))
def report_notes(spark: SparkSession, d: str) -> DataFrame:
    st = lambda n, x: F.col(f"`{n}`.status") == x
    return graded(spark, d).agg(
        F.count_if(st("H4", "no")).alias("dtype_changes"), F.count_if(st("H5", "no")).alias("codec_changes"), F.count_if(st("V", "partial")).alias("arrays_missing"), F.count_if(st("V", "no")).alias("arrays_disjoint"),
        F.min(F.when(st("H2", "partial"), c(ID))).alias("partial_example"), F.count_if(c("grade").isin("F", "F*", "U")).alias("unread"), F.count_if(c("grade") == "D").alias("rewritten"),
    )


@query("""WITH o AS (SELECT collection_id, count(DISTINCT orbit) FILTER (orbit <> '') AS n FROM arch_granule GROUP BY 1)
SELECT count(*) FILTER (n > 0) AS recorded, count(*) FILTER (n > 1) AS both_directions, min(collection_id) FILTER (n > 1) AS first_both FROM o""")
def orbit_note(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "arch_granule").groupBy(ID).agg(F.count_distinct(F.when(c("orbit") != "", c("orbit"))).alias("n"))
    return o.agg(F.count_if(c("n") > 0).alias("recorded"), F.count_if(c("n") > 1).alias("both_directions"), F.min(F.when(c("n") > 1, c(ID))).alias("first_both"))


@query(BUCKETED + """ SELECT collection_id, '{"collection_id":' || collection_id || ',"buckets":[' || string_agg(DISTINCT '"' || bucket || '"', ',' ORDER BY '"' || bucket || '"') || '],"n_refused":' || count(*) || '}' AS doc FROM bk GROUP BY collection_id""")
def bucket_document(spark: SparkSession, d: str) -> DataFrame:
    """Each collection's buckets as a JSON document."""
    b = diagnosis.bucketed(view(spark, d, "arch_refusal"))
    each = b.groupBy(ID).agg(F.array_sort(F.collect_set("bucket")).alias("buckets"), F.count("*").alias("n_refused"))
    return each.select(ID, F.to_json(F.struct(ID, "buckets", "n_refused")).alias("doc"))


@query("SELECT r_regionkey, 'pkg' || r_regionkey AS package, '1.' || r_regionkey || '.0' AS version FROM region")
def pinned_versions(spark: SparkSession, d: str) -> DataFrame:
    """Name and version of requirement lines; comments and unpinned lines have none."""
    line = F.concat(F.lit("  pkg"), c("r_regionkey").cast("string"), F.lit("==1."), c("r_regionkey").cast("string"), F.lit(".0  # pinned"))
    lines = F.explode(F.array(F.lit("# head==1"), line, F.lit("loose>=2")))
    pin = r"^\s*([A-Za-z0-9_.\[\]-]+)==([^\s;#]+)"
    r = view(spark, d, "region").select("r_regionkey", lines.alias("line"))
    return r.where(c("line").rlike(pin)).select("r_regionkey", F.regexp_extract("line", pin, 1).alias("package"), F.regexp_extract("line", pin, 2).alias("version"))
