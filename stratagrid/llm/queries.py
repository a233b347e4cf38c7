"""The text queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, near_dedup, packing, quality_rules, shared, substring_dedup, token_store, toxicity, url_filters, warc
from .shared import table

BLANK = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER, URL = url_filters.UPPER, url_filters.LOWER, url_filters.URL


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on the labelled ones of sf_dir's documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", toxicity.grade(F.col("toxic"), F.col("quality")).alias("grade"))
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return out.select("doc_id", F.element_at("above", 1).alias("p_toxic"), "severity", "grade", "toxic")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", "n_near")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return held.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"), "failures", F.lit("v1").alias("policy"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 removes, with the others and alone, from the stored ledger."""
    held = shared.materialise(quality_rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    return quality_rules.ablation(held, "v1")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", good.alias("good"))
    return url_filters.judge(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "template", "verdict")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write(table(spark, sf_dir, "documents"), shared.new_folder(spark, "tokens"), end_id=1)
    return token_store.digests(spark, manifest)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.read(spark, warc.write(table(spark, sf_dir, "pages"), shared.new_folder(spark, "warc")))
    return out.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", warc.page_of("refers_id").alias("refers_to"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), "license", "coverage")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "quality_ablation": quality_ablation,
    "op5_url_filters": op5_url_filters,
    "op6_token_store": op6_token_store,
    "op7_near_dedup": op7_near_dedup,
    "op8_warc": op8_warc,
    "op9_license_scan": op9_license_scan,
    "op10_packing": op10_packing,
}

#: SQL of op4's ledger: f has the measurements and the failure bits.
QUALITY = rf"""d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{BLANK}') AS w FROM documents),
line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
         FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{BLANK}') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(5)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN line USING (doc_id) LEFT JOIN hit USING (doc_id)),
f AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
                     + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
                     + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 30 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failures FROM m)"""

#: SQL for: of n labels, g good, against the pn and pg of all, more than 1.96 deviations and half a label.
CHANCE = "2 * abs(g * pn - n * pg) - pn > 0 AND pow(CAST(2 * abs(g * pn - n * pg) - pn AS DOUBLE), 2) * pn > 4 * 1.96::DOUBLE * 1.96::DOUBLE * n::DOUBLE * pg * (pn - pg) * (pn - n)"


def _levels() -> str:
    """SQL of op5's tree, level by level: s0 to s6 are (host, path, n, g, s, parent, t)."""
    return ",".join(
        f"""
c{d} AS MATERIALIZED (SELECT host, t, s[{d}] AS child, count(*) AS paths, CAST(sum(n) AS BIGINT) AS n, CAST(sum(g) AS BIGINT) AS g FROM s{d - 1} WHERE len(s) >= {d} GROUP BY ALL),
r{d} AS (SELECT * FROM (SELECT *, sum(paths) OVER (PARTITION BY host, t) AS total FROM c{d}) WHERE 8 * paths < total),
v{d} AS (SELECT *, count(*) OVER w AS c, CAST(sum(n) OVER w AS BIGINT) AS pn, CAST(sum(g) OVER w AS BIGINT) AS pg FROM r{d} WINDOW w AS (PARTITION BY host, t)),
w{d} AS (SELECT host, t, child, '{{*}}' AS star FROM v{d} WHERE c >= 8 AND NOT ({CHANCE})),
s{d} AS MATERIALIZED (SELECT x.host, path, n, g, s, CASE WHEN len(s) >= {d} THEN x.t ELSE parent END AS parent,
       CASE WHEN len(s) < {d} THEN x.t ELSE concat(x.t, '{"" if d == 1 else "/"}', coalesce(star, s[{d}])) END AS t
       FROM s{d - 1} x LEFT JOIN w{d} ON x.host = w{d}.host AND x.t = w{d}.t AND x.s[{d}] = w{d}.child)"""
        for d in range(1, 7)
    )


ORACLES: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{BLANK}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(35)) AS j FROM win SEMI JOIN rep USING (s))),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY ALL)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id),
-- proximity: starts by the rarest and the second rarest place of a window that differ by at most 3, where the window does not stand
place AS (SELECT s, unnest(range(0, len(x))) AS off, unnest(x) AS term FROM (SELECT DISTINCT s, string_split(s, ' ') AS x FROM bw)),
dp AS (SELECT doc_id, p - 1 AS pos, x AS term FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d) SEMI JOIN place ON x = term),
freq AS (SELECT term, count(*) AS n FROM dp GROUP BY term),
rare AS (SELECT s, off, term, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY s ORDER BY coalesce(n, 0), term, off) AS k FROM place LEFT JOIN freq USING (term)),
st AS (SELECT DISTINCT doc_id, s, k, pos - off AS a FROM dp JOIN rare USING (term) WHERE k <= 2 AND pos >= off),
near AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, x.s, x.a FROM st x JOIN st y USING (doc_id, s) WHERE x.k = 1 AND y.k = 2 AND x.a <> y.a AND abs(x.a - y.a) <= 3) c
         ANTI JOIN (SELECT doc_id, i - 1 AS a, dw.s FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k) e USING (doc_id, s, a) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated,
       CAST(coalesce(near.n, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op4_quality_rules": f"""
WITH {QUALITY}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures, 'v1' AS policy
FROM f""",
    "quality_ablation": f"""
WITH {QUALITY},
r AS (SELECT unnest(['too_few_words', 'repeated_phrases', 'symbols', 'duplicate_lines', 'short_mean_word', 'long_mean_word']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit)
SELECT rule, count(*) AS texts, count(*) FILTER (failures & bit <> 0) AS failed, count(*) FILTER (failures = bit) AS only,
       count(*) FILTER (failures = bit OR failures = 0) AS kept_without
FROM f, r GROUP BY rule""",
    "op5_url_filters": rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
                  coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
lab AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id),
u AS (SELECT host, path, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '{{n}}', 'g')) AS s,
             CAST(count(good) AS BIGINT) AS n, CAST(coalesce(sum(good), 0) AS BIGINT) AS g FROM p LEFT JOIN lab ON doc_id = page_id GROUP BY host, path),
s0 AS (SELECT host, path, n, g, CASE WHEN len(s) <= 6 THEN s ELSE list_append(s[1:5], array_to_string(s[6:], '/')) END AS s, '' AS parent, '' AS t FROM u),
{_levels()},
t AS (SELECT host, parent, t AS template, CAST(sum(n) AS BIGINT) AS n, CAST(sum(g) AS BIGINT) AS g FROM s6 GROUP BY ALL),
pool AS (SELECT host, parent, CAST(sum(n) AS BIGINT) AS pn, CAST(sum(g) AS BIGINT) AS pg FROM t GROUP BY ALL),
h AS (SELECT host, (sum(g) + 10.0::DOUBLE * coalesce((SELECT sum(g)::DOUBLE / sum(n) FROM t WHERE n > 0), 1.0)) / (sum(n) + 10.0::DOUBLE) AS hp FROM t GROUP BY host),
a AS (SELECT t.*, NOT ({CHANCE}) AS merged FROM t JOIN pool USING (host, parent)),
j AS (SELECT host, parent, sum(n) AS mn, sum(g) AS mg FROM a WHERE merged GROUP BY ALL),
q AS (SELECT a.host, a.parent, a.template, CASE WHEN merged AND mn = 0 THEN NULL WHEN merged THEN (mg + 10.0::DOUBLE * hp) / (mn + 10.0::DOUBLE) ELSE (g + 10.0::DOUBLE * hp) / (n + 10.0::DOUBLE) END AS purity
      FROM a LEFT JOIN j USING (host, parent) JOIN h ON h.host = a.host)
SELECT page_id, r.host, r.path, rule, template,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN purity < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN s6 USING (host, path) JOIN q ON q.host = r.host AND q.parent = s6.parent AND q.template = s6.t""",
    "op7_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANK}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw, sha1(encode(coalesce(html, ''))) AS h FROM pages),
-- 40 hexadecimal digits are 8 times 20 bits, each 4 letters of base 32
d AS (SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS payload_bytes, h, array_to_string(list_transform(range(32), lambda i:
        substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(concat('0x', substring(h, CAST(1 + 5 * (i // 4) AS INT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INT), 1)), '') AS payload_digest FROM p),
t AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d JOIN t USING (h)""",
}
