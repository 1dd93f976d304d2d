"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import html_content, quality_gam
from patronage.llm.decontaminate import decontaminate
from patronage.llm.fill_middle import fill_in_middle, restored
from patronage.llm.filter_audit import filter_audit
from patronage.llm.langid import identify, training_rows
from patronage.llm.licenses import names, scan_licenses, sureness
from patronage.llm.lines import line_dedup
from patronage.llm.mixing import mix_sources
from patronage.llm.simhash import simhash_groups
from patronage.llm.substring import substring_dedup
from patronage.llm.target_ratio import quality_rules
from patronage.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_gam.train(docs, _table(spark, sf_dir, "labels").where(quality_gam.learnable()))
    return quality_gam.score(docs, model).select("doc_id", (~quality_gam.learnable()).alias("held_out"), "score", "predicted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_content.extract_text(pages, html_content.train(pages))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", (~training_rows()).alias("held_out"), "lang_pred", "score", "accepted")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def license_digest(docs: DataFrame) -> DataFrame:
    base = F.filter("detections", lambda d: d["base"])
    found = scan_licenses(docs).select("doc_id", "n_words", "detections", base.alias("base"), F.transform(base, lambda d: d["first"].cast("long")).alias("places"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.col("detections")).alias("labels"), sureness(F.col("detections")).alias("score"),
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontaminate": op3_decontaminate,
    "op4_html_text": op4_html_text,
    "op5_quality_rules": op5_quality_rules,
    "op6_mix_sources": op6_mix_sources,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_license_scan": op11_license_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}

WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

BENCH_WORDS_SQL = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op1_line_dedup": """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pl FROM l),
n AS (SELECT doc_id, line, pl, row_number() OVER (PARTITION BY doc_id ORDER BY pl) - 1 AS p FROM e WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT doc_id, p, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS k FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM w WHERE k IS NOT NULL),
g AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (VALUES (0), (1), (2)) v(o) WHERE nth > 1),
x AS (SELECT n.doc_id, n.pl FROM n JOIN g USING (doc_id, p)),
k AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.pl) AS t FROM e LEFT JOIN x ON e.doc_id = x.doc_id AND e.pl = x.pl WHERE x.pl IS NULL GROUP BY e.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM n GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op3_decontaminate": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {BENCH_WORDS_SQL} AS w FROM benchmark),
i AS (SELECT item, unnest(range(1, greatest(len(w) - 8, 2))) AS p, w FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, array_to_string(w[p:p + 9], ' ') AS k, least(len(w), 10) AS n FROM i),
d AS (SELECT doc_id, {BENCH_WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
z AS (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS k FROM s, (SELECT DISTINCT n AS m FROM pat) WHERE p + m - 1 <= len(w)),
h AS (SELECT doc_id, p, item, n FROM z JOIN pat ON z.m = pat.n AND z.k = pat.k),
c AS (SELECT doc_id, count(DISTINCT q) AS hits FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits, 0) AS BIGINT) AS n_hit, CAST(coalesce(items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hits, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to FROM g""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM s),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
r AS (SELECT doc_id, list(p) AS ps FROM h JOIN f USING (k) WHERE first < doc_id GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 50)))) AS gone FROM r),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS g, CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ') END AS t FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(t) AS kept_sha256 FROM k""",
    "op12_filter_audit": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
 + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
 + CASE WHEN rank() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) > 1 THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
p AS (SELECT letter AS o, bit AS applied FROM f UNION ALL SELECT o || letter, applied | bit FROM p JOIN f ON applied & bit = 0),
s AS (SELECT o AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM p WHERE length(o) = 5),
e AS (SELECT filter_order, step, f.letter, f.bit, applied - f.bit AS before FROM s JOIN p ON p.o = substring(filter_order, 1, step) JOIN f ON f.letter = substring(filter_order, step, 1)),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed, coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant,
 coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
 FROM c, e GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r""",
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || x[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || x[25:32] AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, least(a, b) AS p, greatest(a, b) AS q, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || substring(t, q + 1) || '<P>' || substring(t, 1, p) || '<M>' || substring(t, p + 1, q - p)
 ELSE '<P>' || substring(t, 1, p) || '<S>' || substring(t, q + 1) || '<M>' || substring(t, p + 1, q - p) END AS o FROM f),
r AS (SELECT *, regexp_split_to_array(o, '<[PSM]>') AS c FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(q - p AS BIGINT) END AS middle_chars, sha256(o) AS output_sha256,
sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN c[2] || c[4] || c[3] ELSE c[3] || c[4] || c[2] END) AS restored_sha256 FROM r""",
}
