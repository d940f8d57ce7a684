"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import feistel_pii, filter_audit, fm_decontam, golay_simhash, license_digest, media_sniff, nra_search, ordinal_quality, pivotal_mix, slot_sharding, token_groups, toxicity_kn, url_asof
from lociweave.llm.common import table
from lociweave.operators.ordered import row_numbers


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good; learnt from the labelled documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    return ordinal_quality.quality(docs, ordinal_quality.fit(docs, ratings, n_grades=3))


def op2_url_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures: all pages, fetched at times dealt over January 2024.  List: every event
    lists the host of a page, dealt in turn over the pages (the parent domain for values
    from 50 on) - errors and purchases block it, other events allow it."""
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    second = F.pmod(F.col("page_id") * 7919, F.lit(30 * 86_400))
    captures = pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + second).alias("fetched_at"))
    host = url_asof.host_of(F.col("url"))
    parent = F.when(F.size(F.split(host, "[.]")) > 2, F.regexp_replace(host, "^[^.]+[.]", "")).otherwise(host)
    hosts = row_numbers(pages.select("page_id", host.alias("host"), parent.alias("parent")), ["page_id"], "turn")
    listed = events.select((F.pmod("event_id", F.lit(max(1, pages.count()))) + 1).alias("turn"), F.col("ts").cast("timestamp").alias("effective_at"), "event_type", "value").join(hosts, "turn")
    entries = listed.select(F.when(F.col("value") >= 50, F.col("parent")).otherwise(F.col("host")).alias("host"), "effective_at", F.when(F.col("event_type").isin("error", "purchase"), "block").otherwise("allow").alias("action"))
    judged = url_asof.filter_captures(captures, entries)
    return judged.select("page_id", "host", F.unix_seconds("fetched_at").alias("fetched_s"), "matched_host", F.unix_micros("valid_from").cast("string").alias("from_us"), F.unix_micros("valid_to").cast("string").alias("to_us"), "action", "blocked")


def op3_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity_kn.toxicity(docs, toxicity_kn.fit(docs, labels))


def op4_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.license_scan(table(spark, sf_dir, "documents"))


def op5_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_sniff.sniff(media_sniff.text_media(table(spark, sf_dir, "documents")))


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.mix(table(spark, sf_dir, "documents"))


def op7_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fm_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a real run comes from the caller's own secret store."""
    return feistel_pii.pseudonymise(table(spark, sf_dir, "documents"), "rotate0this0key")


def op10_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_groups.jaccard_components(table(spark, sf_dir, "documents"))


def op12_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ordinal_quality, op2_url_asof, op3_toxicity_kn, op4_license_digest, op5_media_sniff, op6_pivotal_mix, op7_fm_decontam, op8_golay_simhash, op9_feistel_pii, op10_slot_sharding, op11_token_groups, op12_nra_search, op13_filter_audit)
}

_HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '')"

URL_SQL = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, 1704067200 + (page_id * 7919) % 2592000 AS fetched_s, row_number() OVER (ORDER BY page_id) - 1 AS turn FROM pages),
e AS (
  SELECT CASE WHEN value >= 50 AND len(string_split(host, '.')) > 2 THEN regexp_replace(host, '^[^.]+[.]', '') ELSE host END AS host,
         epoch_us(ts) AS us, max(CASE WHEN event_type IN ('error', 'purchase') THEN 'block' ELSE 'allow' END) AS action
  FROM events JOIN p ON event_id % (SELECT count(*) FROM pages) = turn WHERE host IS NOT NULL GROUP BY 1, 2),
v AS (SELECT *, lead(us) OVER (PARTITION BY host ORDER BY us) AS to_us FROM e),
s AS (
  SELECT page_id, host AS own, fetched_s, depth,
         array_to_string(list_slice(string_split(host, '.'), depth, len(string_split(host, '.'))), '.') AS host
  FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS depth FROM p WHERE host IS NOT NULL)),
m AS (
  SELECT s.page_id, s.fetched_s, s.depth, s.host, v.us, v.to_us, v.action FROM s ASOF JOIN v ON s.host = v.host AND s.fetched_s * 1000000 >= v.us
  QUALIFY row_number() OVER (PARTITION BY s.page_id ORDER BY s.depth) = 1)
SELECT p.page_id, p.host, CAST(p.fetched_s AS BIGINT) AS fetched_s, m.host AS matched_host, CAST(m.us AS VARCHAR) AS from_us, CAST(m.to_us AS VARCHAR) AS to_us, m.action, coalesce(m.action = 'block', false) AS blocked
FROM p LEFT JOIN m ON p.page_id = m.page_id
"""


def _normal_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{license_digest.COPYRIGHT_LINE}', '', 'g')"
    out = f"trim(regexp_replace({out}, '{license_digest.NOT_WORD}', ' ', 'g'))"
    out = f"' ' || replace({out}, ' ', '  ') || ' '"
    for old, new in license_digest.SPELLINGS:
        wide = [" " + x.replace(" ", "  ") + " " for x in (old, new)]
        out = f"replace({out}, '{wide[0]}', '{wide[1]}')"
    return f"trim(replace({out}, '  ', ' '))"


def _known_sql(texts: list[tuple[str, str]]) -> str:
    return "(VALUES " + ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in texts) + ") t(license, text)"


LICENSE_SQL = f"""
WITH known AS (SELECT sha256({_normal_sql("text")}) AS digest, min(license) AS license FROM {_known_sql(license_digest.known_texts())} GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, sha256({_normal_sql("text")}) AS text_digest FROM d),
n AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d WHERE lower(text) LIKE '%licen%'),
h AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS names, count(*) AS n
  FROM (SELECT r, sha256({_normal_sql("line")}) AS digest FROM n WHERE lower(line) LIKE '%licen%') JOIN known USING (digest) GROUP BY r)
SELECT doc_id, text_digest, license AS license_id, coalesce(names, '') AS line_licenses, CAST(coalesce(h.n, 0) AS BIGINT) AS n_license_lines
FROM w LEFT JOIN known ON text_digest = digest LEFT JOIN h ON w.r = h.r
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAM_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw))),
hit AS (SELECT DISTINCT r, i, g.size, item FROM g JOIN bw ON g.gram = bw.gram AND g.size = bw.size),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.r = a JOIN z y ON y.r = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
c(r, other) AS (SELECT r, r FROM d UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.other)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN z USING (r) JOIN (SELECT c.r, min(o.doc_id) AS component_id FROM c JOIN d o ON o.r = c.other GROUP BY c.r) m ON m.r = d.r
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2),
i AS (SELECT DISTINCT b, item_id, term FROM (SELECT row_number() OVER () AS b, item_id, unnest({_TERMS}) AS term FROM benchmark)),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * N + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, s WHERE term IN (SELECT term FROM i) GROUP BY term, N),
c AS (
  SELECT b, item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * N) // L)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY b, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0) WHERE rank <= 10
"""

AUDIT_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS again FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
         + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(again AS INT) AS mask,
         count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM d LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
b AS (SELECT unnest(range(5)) AS f),
o AS (
  SELECT [b1.f, b2.f, b3.f, b4.f, b5.f] AS fs FROM b b1, b b2, b b3, b b4, b b5
  WHERE b1.f <> b2.f AND b1.f <> b3.f AND b1.f <> b4.f AND b1.f <> b5.f AND b2.f <> b3.f AND b2.f <> b4.f AND b2.f <> b5.f AND b3.f <> b4.f AND b3.f <> b5.f AND b4.f <> b5.f),
s AS (
  SELECT array_to_string(list_transform(fs, lambda x: substr('ABCDE', CAST(x AS INT) + 1, 1)), '') AS filter_order, k AS step, fs[k] AS f, 1 << fs[k] AS bit,
         coalesce(list_sum(list_transform(fs[1:k - 1], lambda x: 1 << x)), 0)::BIGINT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (
  SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER ((mask & before) > 0 AND (mask & bit) > 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0) AS BIGINT) AS toxic_lost
  FROM s, m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""

ORACLE_SQL: dict[str, str] = {"op2_url_asof": URL_SQL, "op4_license_digest": LICENSE_SQL, "op7_fm_decontam": DECONTAM_SQL, "op11_token_groups": JACCARD_SQL, "op12_nra_search": SEARCH_SQL, "op13_filter_audit": AUDIT_SQL}
