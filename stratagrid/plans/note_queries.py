"""Queries of a report's notes and filters, of the bucket document, and of small rules over files and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import criteria, diagnosis, layout, notes, sampling, verification
from ..sources import records
from ..sources.binding import archive, arrays, view
from .catalogue import query
from .criteria_queries import GRADE, _q, graded
from .report_queries import BUCKETED, CLASS

ID = "collection_id"
c = F.col


def _named(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).join(view(spark, d, "customer").select(c("c_custkey").alias(ID), "c_name", "c_mktsegment"), ID)


_list = "coalesce(string_agg(c_name, ', ' ORDER BY c_name) FILTER ({}), '')"


@query(_q(GRADE, f"""SELECT count(*) FILTER (s_h4 = 'no') AS n_dtype, {_list.format("s_h4 = 'no'")} AS dtype_names, count(*) FILTER (s_h5 = 'no') AS n_codec, {_list.format("s_h5 = 'no'")} AS codec_names,
       count(*) FILTER (s_v = 'partial') AS n_missing, count(*) FILTER (s_v = 'no') AS n_disjoint, {_list.format("s_v = 'no'")} AS disjoint_names, {_list.format("s_h4 = 'no' OR s_h5 = 'no'")} AS control_names
       FROM gr JOIN customer ON c_custkey = collection_id"""))
def status_notes(spark: SparkSession, d: str) -> DataFrame:
    return notes.status_notes(_named(spark, d), "c_name")


@query(_q("""
m_d AS (SELECT collection_id, count(*) AS n, count(*) FILTER (dataset_ok) AS ds, count(*) FILTER (datatree_ok) AS dt FROM arch_store GROUP BY collection_id),
m AS (SELECT CASE WHEN n_opened = 0 OR n IS NULL THEN 'unmeasured' WHEN ds = n THEN 'yes' WHEN dt = n THEN 'partial' WHEN ds = 0 AND dt = 0 THEN 'no' ELSE 'partial' END AS status FROM op LEFT JOIN m_d USING (collection_id))""",
          "SELECT count(*) FILTER (status = 'yes') AS flat, count(*) FILTER (status = 'partial') AS trees, count(*) FILTER (status = 'no') AS neither, count(*) FILTER (status = 'unmeasured') AS unrecorded FROM m"))
def store_notes(spark: SparkSession, d: str) -> DataFrame:
    return notes.store_notes(criteria.m_materialises(archive(spark, d, whole=True)))


#: A customer's container and blocker: each segment is one format, and its key decides what a reader said.
FORMS = """WITH f AS (SELECT c_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'HDF4' WHEN 'MACHINERY' THEN 'HDF-EOS2' WHEN 'AUTOMOBILE' THEN 'HDF-EOS' ELSE 'HDF-EOS5' END AS format,
  CASE c_custkey % 7 WHEN 0 THEN 'H0: all 3 refused: group name is not UTF-8' WHEN 1 THEN 'H0: all 2 refused: wrong number of dimension names' WHEN 2 THEN 'H0: 4 opened without arrays' WHEN 3 THEN 'H0: all 9 refused: reader died — x' ELSE 'no blocker' END AS blocker FROM customer)"""


def _forms(spark: SparkSession, d: str) -> DataFrame:
    form = F.when(c("c_mktsegment") == "BUILDING", "HDF4").when(c("c_mktsegment") == "MACHINERY", "HDF-EOS2").when(c("c_mktsegment") == "AUTOMOBILE", "HDF-EOS").otherwise("HDF-EOS5")
    said = ["H0: all 3 refused: group name is not UTF-8", "H0: all 2 refused: wrong number of dimension names", "H0: 4 opened without arrays", "H0: all 9 refused: reader died — x"]
    return view(spark, d, "customer").select("c_name", form.alias("format"), F.coalesce(F.get(F.array(*map(F.lit, said)), (c("c_custkey") % 7).cast("int")), F.lit("no blocker")).alias("blocker"))


@query(FORMS + """, fam AS (SELECT *, contains(blocker, 'without arrays') AS e, contains(blocker, 'refused: ') AS r, nullif(regexp_extract(blocker, '(data-block references unreadable|wrong number of dimension names|UTF-8)', 1), '') AS k FROM f WHERE format IN ('HDF4', 'HDF-EOS2', 'HDF-EOS'))
SELECT count(*) AS family, count(*) FILTER (NOT e AND NOT r) AS read, count(*) FILTER (r) AS refused, count(DISTINCT k) FILTER (r) AS kinds, count(*) FILTER (e) AS empty, coalesce(string_agg(c_name, ', ' ORDER BY c_name) FILTER (e), '') AS empty_names FROM fam""")
def container_note(spark: SparkSession, d: str) -> DataFrame:
    return notes.container_note(_forms(spark, d), "c_name", "format", "blocker")


@query("SELECT p_name, p_brand AS largest_var, 'Brand#' || (p_size % 3 + 1) AS headline_var FROM part WHERE p_brand <> 'Brand#' || (p_size % 3 + 1) ORDER BY p_name, p_brand, headline_var LIMIT 1")
def principal_note(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "part").select("p_name", c("p_brand").alias("largest_var"), F.concat(F.lit("Brand#"), (c("p_size") % 3 + 1).cast("string")).alias("headline_var"))
    return notes.principal_note(p, "p_name", "largest_var", "headline_var")


@query(_q(GRADE, "SELECT c_name, note FROM gr JOIN h2 USING (collection_id) JOIN customer ON c_custkey = collection_id WHERE s_h2 = 'partial' ORDER BY c_name LIMIT 1"))
def partial_example(spark: SparkSession, d: str) -> DataFrame:
    return notes.partial_example(_named(spark, d), "c_name")


@query(_q(GRADE, "SELECT x.grade FROM (SELECT unnest(['A', 'B', 'C', 'D', 'F*', 'F', 'U']) AS grade) x ANTI JOIN gr ON gr.grade = x.grade"))
def empty_grades(spark: SparkSession, d: str) -> DataFrame:
    return notes.empty_grades(graded(spark, d))


@query(_q(GRADE, r"SELECT collection_id, CASE grade WHEN 'A' THEN 'A ⭐' WHEN 'F*' THEN 'F\*' ELSE grade END AS grade_shown FROM gr"))
def shown_grade(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select(ID, s.shown_grade(c("grade")).alias("grade_shown"))


@query(f"""WITH w AS (SELECT collection_id, gi, CASE WHEN NOT attempted THEN 'not attempted: an earlier granule used up the budget' WHEN error_type = 'ConnectionError' THEN 'failed in transport'
         WHEN contains(error, 'same number of dimensions') THEN 'wrong number of dimension names' ELSE {CLASS} END AS why FROM arch_granule WHERE NOT ok),
n AS (SELECT collection_id, count(*) FILTER (ok) AS n_probed, count(*) FILTER (attempted) AS n_attempted, count(*) AS n_sampled FROM arch_granule GROUP BY collection_id)
SELECT collection_id, n_probed, n_attempted, n_sampled, reasons FROM n JOIN (SELECT collection_id, string_agg(why, '; ' ORDER BY gi) AS reasons FROM (SELECT collection_id, why, min(gi) AS gi FROM w GROUP BY ALL) GROUP BY collection_id) USING (collection_id)
WHERE n_probed < n_sampled""")
def partial_coverage(spark: SparkSession, d: str) -> DataFrame:
    return notes.coverage(view(spark, d, "arch_granule"))


@query("SELECT collection_id, count(*) FILTER (ok) AS n_probed, count(*) FILTER (attempted) AS n_attempted, count(*) AS n_sampled, bool_or(gi % 7 = 0) AS dmrpp FROM arch_granule GROUP BY collection_id")
def granule_counts(spark: SparkSession, d: str) -> DataFrame:
    """Opened, attempted and sampled granules, and whether any has a sidecar index."""
    g = view(spark, d, "arch_granule").withColumn("dmrpp", c("gi") % 7 == 0)
    return g.groupBy(ID).agg(F.count_if(s.opened(c("ok"))).alias("n_probed"), F.count_if(s.attempted(c("attempted"))).alias("n_attempted"), F.count("*").alias("n_sampled"), F.bool_or("dmrpp").alias("dmrpp"))


@query(BUCKETED + """, n AS (SELECT bucket, count(DISTINCT collection_id) AS n_collections FROM bk GROUP BY bucket) SELECT * FROM n WHERE bucket <> 'OTHER'""")
def bucket_section(spark: SparkSession, d: str) -> DataFrame:
    return notes.bucket_section(diagnosis.bucket_counts(diagnosis.bucketed(view(spark, d, "arch_refusal"))))


@query(BUCKETED + """, o AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY event_id) AS r FROM bk)
SELECT collection_id, string_agg(DISTINCT bucket, ', ' ORDER BY bucket) AS buckets, count(*) AS n_refused, max(error_type) FILTER (r = 1) AS example_type, max(substring(error, 1, 200)) FILTER (r = 1) AS example_error, max(bucket) FILTER (r = 1) AS example_bucket FROM o GROUP BY collection_id""")
def bucket_labels(spark: SparkSession, d: str) -> DataFrame:
    found = diagnosis.bucket_labels(diagnosis.bucketed(view(spark, d, "arch_refusal")), "event_id")
    return found.select(ID, "buckets", "n_refused", c("example.error_type").alias("example_type"), c("example.error").alias("example_error"), c("example.bucket").alias("example_bucket"))


@query(BUCKETED + r""", k AS (SELECT error_type || ': ' || substring(regexp_replace(error, '\d+', 'N', 'g'), 1, 100) AS error, collection_id, count(*) AS n FROM bk WHERE bucket = 'OTHER' GROUP BY ALL)
SELECT error, CAST(sum(n) AS BIGINT) AS n_granules, string_agg(CAST(collection_id AS STRING), ', ' ORDER BY collection_id) AS collections FROM k GROUP BY error""")
def unnamed_collections(spark: SparkSession, d: str) -> DataFrame:
    found = diagnosis.unnamed_classes(diagnosis.bucketed(view(spark, d, "arch_refusal")))
    return found.select("error", "n_granules", F.array_join(c("collections").cast("array<string>"), ", ").alias("collections"))


@query(BUCKETED + "SELECT count(DISTINCT collection_id) AS collections, CAST((SELECT count(DISTINCT bucket) FROM bk) AS BIGINT) AS buckets, (SELECT bucket FROM bk GROUP BY bucket ORDER BY count(DISTINCT collection_id) DESC, bucket LIMIT 1) AS top_bucket FROM bk")
def bucket_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole bucket document as JSON, read again: its collections, its buckets and the commonest of them."""
    doc = diagnosis.bucket_report(diagnosis.bucketed(view(spark, d, "arch_refusal")), "event_id")
    kind = "collections array<struct<n_refused: bigint>>, collections_per_bucket array<struct<bucket: string, n_collections: bigint>>"
    x = doc.select(F.from_json("document", kind).alias("x"))
    return x.select(F.size("x.collections").cast("long").alias("collections"), F.size("x.collections_per_bucket").cast("long").alias("buckets"), c("x.collections_per_bucket")[0]["bucket"].alias("top_bucket"))


@query()
def inventory_date(spark: SparkSession, d: str) -> DataFrame:
    """The day on which the catalog table was written."""
    return records.written_on(spark, f"{d}/customer.parquet")


@query("SELECT event_id, replace(replace('at /opt/env/lib/' || event_type || ' in /opt/env/work/' || user_id, '/opt/env/work', '<repo>'), '/opt/env', '<env>') AS trace FROM events")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "events")
    text = F.concat(F.lit("at /opt/env/lib/"), "event_type", F.lit(" in /opt/env/work/"), c("user_id").cast("string"))
    return e.select("event_id", s.relative_paths(text, [("/opt/env", "<env>"), ("/opt/env/work", "<repo>")]).alias("trace"))


@query("SELECT o_orderkey, o_custkey, c_acctbal > 0 AS dmrpp, c_custkey IS NOT NULL AS remembered FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0")
def memo_recall(spark: SparkSession, d: str) -> DataFrame:
    """A memo of some customers: true, false, or not on record."""
    memo = view(spark, d, "customer").where("c_custkey % 3 <> 0").select(c("c_custkey").alias("o_custkey"), (c("c_acctbal") > 0).alias("dmrpp"))
    return sampling.recall(view(spark, d, "orders").select("o_orderkey", "o_custkey"), memo, "o_custkey", "dmrpp").select("o_orderkey", "o_custkey", "dmrpp", "remembered")


_kind = "CASE o_orderkey % 5 WHEN 0 THEN 'hdf4' WHEN 1 THEN 'hdf5' WHEN 2 THEN 'zip' WHEN 3 THEN 'text' ELSE 'tiff' END"
_size = "CAST(round(o_totalprice * 100) AS BIGINT) * 100"


@query(f"SELECT o_orderkey, CASE WHEN k <> 'hdf4' THEN 'range' WHEN b <= 838860800 THEN 'copy' ELSE 'refused' END AS reading, CASE WHEN b > 2147483648 THEN 'skipped' WHEN k = 'tiff' THEN 'none' ELSE k END AS diagnosis FROM (SELECT o_orderkey, {_kind} AS k, {_size} AS b FROM orders)")
def reading_rules(spark: SparkSession, d: str) -> DataFrame:
    """How a granule would be read and diagnosed, by its container and size."""
    o = view(spark, d, "orders").select("o_orderkey", F.expr(_kind).alias("k"), F.expr(_size).alias("b"))
    return o.select("o_orderkey", s.reading(c("k"), c("b")).alias("reading"), s.diagnosis_of(c("k"), c("b")).alias("diagnosis"))


@query("SELECT o_orderkey AS granule_id, o_orderpriority, coalesce(CAST(CAST(ship AS DATE) AS STRING), '') AS revision_date FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def backfill_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Revision dates anew for granules on record; those that the lookup does not know have none."""
    held = view(spark, d, "orders").select(c("o_orderkey").alias("granule_id"), "o_orderpriority", F.lit("old").alias("revision_date"))
    dates = view(spark, d, "lineitem").where("l_orderkey % 4 <> 0").groupBy(c("l_orderkey").alias("granule_id")).agg(F.to_date(F.min("l_shipdate")).alias("revision_date"))
    return sampling.backfill(held, dates).select("granule_id", "o_orderpriority", "revision_date")


@query("SELECT c_custkey, c_name, count(*) AS granules FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def build_inventory(spark: SparkSession, d: str) -> DataFrame:
    """A row for each candidate with its catalog record; a candidate without one fails the build."""
    candidates = view(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("granules"))
    return sampling.required(candidates, view(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "catalog record").select("c_custkey", "c_name", "granules")


@query("""WITH q AS (SELECT DISTINCT p_brand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS asked FROM part),
x AS (SELECT p_brand, CAST(p_size AS STRING) AS v, min(p_partkey) AS p_partkey FROM part GROUP BY ALL),
l AS (SELECT DISTINCT ON (p_brand) * FROM x ORDER BY p_brand, v DESC)
SELECT q.p_brand, asked, coalesce(x.v, l.v) AS found, coalesce(x.p_partkey, l.p_partkey) AS p_partkey FROM q LEFT JOIN x ON x.p_brand = q.p_brand AND x.v = asked LEFT JOIN l ON l.p_brand = q.p_brand AND asked IS NULL""")
def resolve_version(spark: SparkSession, d: str) -> DataFrame:
    """A catalog row by name and version, or the last one where no version is asked for."""
    p = view(spark, d, "part").select("p_brand", c("p_size").cast("string").alias("version"), "p_partkey")
    asked = p.select("p_brand", F.when(c("p_partkey") % 3 != 0, c("version")).alias("version")).distinct()
    return sampling.resolve(asked, p, "p_brand", "version").select("p_brand", "asked", "found", "p_partkey")


@query("""WITH n AS (SELECT collection_id, name, c0, c1, count(*) AS n, min(gi) AS seen FROM arch_var GROUP BY ALL),
b AS (SELECT DISTINCT ON (collection_id, name) collection_id, name, c0, c1 FROM n ORDER BY collection_id, name, n DESC, seen)
SELECT collection_id, name, gi FROM (SELECT v.collection_id, v.name, gi, row_number() OVER (PARTITION BY v.collection_id, v.name ORDER BY gi) AS r FROM arch_var v JOIN b USING (collection_id, name, c0, c1)) WHERE r <= 3""")
def consistent_granules(spark: SparkSession, d: str) -> DataFrame:
    """Up to three granules that agree on an array's commonest chunk shape."""
    return verification.consistent(arrays(spark, d), 3)


@query("""WITH p AS (SELECT collection_id, gi_a, gi_b, arg_min(name, (-e, name)) FILTER (dif) AS name, max(e) FILTER (dif) AS elements FROM (
  SELECT a.collection_id, a.gi AS gi_a, b.gi AS gi_b, a.name, a.d0 * a.d1 AS e, a.d0 = b.d0 AND a.d1 = b.d1 AS same, a.c0 <> b.c0 OR a.c1 <> b.c1 AS dif
  FROM arch_var a JOIN arch_var b ON a.collection_id = b.collection_id AND a.name = b.name AND a.gi < b.gi) GROUP BY ALL HAVING bool_and(same) AND bool_or(dif))
SELECT collection_id, gi_a, gi_b, elements FROM p ORDER BY elements DESC, collection_id, gi_a, gi_b LIMIT 1""")
def h2_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The pair of granules on which a control for chunk shapes would be run."""
    return verification.best_pair(verification.chunk_only_pairs(arrays(spark, d))).select(ID, "gi_a", "gi_b", "elements")


@query("""SELECT heading, completed, n_lines FROM (VALUES ('1. Regions', true, CAST((SELECT count(*) FROM region) + 2 AS BIGINT)), ('2. A check that fails', false, CAST(1 AS BIGINT)), ('3. Nations by region', true, CAST((SELECT count(DISTINCT n_regionkey) FROM nation) + 2 AS BIGINT))) t(heading, completed, n_lines)""")
def verification_report(spark: SparkSession, d: str) -> DataFrame:
    """Checks as sections: each is its rows, or what it failed with, and the others go on."""
    n = view(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    found = verification.report(spark, {"Regions": lambda: view(spark, d, "region").select("r_name"), "A check that fails": lambda: n.select("absent"), "Nations by region": lambda: n})
    return found.select("heading", "completed", F.size("lines").cast("long").alias("n_lines"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.04 THEN 'DEFLATE' ELSE 'NONE' END AS codec, row_number() OVER (PARTITION BY l_orderkey, l_tax > 0.04 ORDER BY l_linenumber * 1000000 + l_partkey) AS r FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey, codec, count(*) AS n, string_agg(CAST(l_linenumber * 1000000 + l_partkey AS STRING), ',' ORDER BY r) FILTER (r <= 4) AS first FROM e GROUP BY ALL""")
def codec_histogram(spark: SparkSession, d: str) -> DataFrame:
    li = view(spark, d, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", (c("l_linenumber").cast("long") * 1000000 + c("l_partkey")).alias("place"), F.when(c("l_tax") > 0.04, "DEFLATE").otherwise("NONE").alias("codec"))
    return layout.codec_histogram(li, "l_orderkey", "place")


HEADS = ["894844460D0A1A0A00", "0E03130100", "43444601", "49492A0008", "4D4D002A00", "4D4D002B", "504B0304", "", "8948"]


@query("SELECT event_id, ['hdf5', 'hdf4', 'netcdf3', 'tiff', 'tiff', 'tiff', 'unknown', 'unknown', 'unknown'][1 + CAST(event_id % 9 AS INT)] AS container FROM events")
def sniff_heads(spark: SparkSession, d: str) -> DataFrame:
    """Containers by the first bytes of a column."""
    head = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (c("event_id") % 9 + 1).cast("int")))
    return view(spark, d, "events").select("event_id", s.sniff(head).alias("container"))
