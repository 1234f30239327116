"""Registered queries of the engine, one or more per operator, and the DuckDB SQL that checks them.

Every query reads the given tables, or inputs that Spark derives from them (fixtures), whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compare, numbers, periods, text
from ..operators import aggregates as A
from ..operators import evidence as E
from ..operators import findings as D
from ..operators import passages as C
from ..operators import replies as N
from ..operators import scoring as X
from ..operators import search as Q
from ..operators import selection as L
from ..operators import views as V
from ..schemas import CITABLE
from ..sources import reports as S
from ..sources import sinks as K
from ..sources.staging import shared_dir, staged
from ..streaming import streams as T
from . import fixtures as I

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def also(name: str):
    """A second name of a query."""
    def add(fn):
        first = next(n for n, f in QUERIES.items() if f is fn)
        return query(name, ORACLES.get(first))(fn)
    return add


# --- SQL pieces -------------------------------------------------------------------------------------------------------

REPORTS = "reports AS (" + I.duck(I.REPORTS) + ")"
PAGES = "pages_of AS (" + I.duck(I.PAGES) + ")"
WITH = f"WITH {REPORTS} "


def canon(c: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')))"


def norm(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"


NOISE = ", ".join(f"'{w}'" for w in text.ENTITY_NOISE)
MINE = "coalesce(nullif(mine_name, ''), nullif(location, ''))"
KEPT = f"list_sort(list_filter(string_split({canon(MINE)}, ' '), lambda w: w <> '' AND w NOT IN ({NOISE})))"
KEY = f"CASE WHEN {MINE} IS NOT NULL THEN CASE WHEN len({KEPT}) > 0 THEN array_to_string({KEPT}, ' ') ELSE nullif({canon(MINE)}, '') END END"
QTY = "coalesce(nullif(quantity_extracted, ''), nullif(x_quantity_extracted, ''))"
MINERAL = "coalesce(nullif(mineral_type, ''), nullif(x_mineral_type, ''))"
METHOD = "nullif(extraction_method, '')"
RESERVE = "nullif(x_reserve_estimate, '')"
QTY_NUM = "CASE WHEN nullif(quantity_extracted, '') IS NOT NULL THEN q_num ELSE xq_num END"
TERM = "CASE c WHEN 'open cast' THEN 'opencast' WHEN 'opencast' THEN 'opencast' WHEN 'underground' THEN 'underground' WHEN 'sub surface' THEN 'underground' WHEN 'coal' THEN 'coal' WHEN 'iron ore' THEN 'iron ore' WHEN 'limestone' THEN 'limestone' END"
STATED = f"""stated AS (
  SELECT id, filename, mk, mine, org, y, q, field, value, num, {norm('value')} AS vk, {canon('value')} AS c FROM (
    SELECT id, filename, {KEY} AS mk, {MINE} AS mine, nullif(company_name, '') AS org, p_year AS y, p_quarter AS q,
      unnest([{{'field': 'quantity_extracted', 'value': {QTY}, 'num': {QTY_NUM}}}, {{'field': 'reserve_estimate', 'value': {RESERVE}, 'num': r_num}},
              {{'field': 'extraction_method', 'value': {METHOD}, 'num': NULL}}, {{'field': 'mineral_type', 'value': {MINERAL}, 'num': NULL}}], recursive := true)
    FROM reports WHERE status = 'completed')
  WHERE mk IS NOT NULL AND value IS NOT NULL)"""
CONFLICTS = f"""{STATED}, pos AS (
  SELECT *, min(id) OVER (PARTITION BY mk, field, vk) AS first_id, count(*) OVER (PARTITION BY mk, field, vk) AS total, {TERM} AS term FROM stated
), per AS (SELECT DISTINCT ON (mk, field, vk, y, q) * FROM pos ORDER BY mk, field, vk, y, q, id
), pairs AS (
  SELECT a.field AS field_name, a.id AS a_id, b.id AS b_id, a.filename AS a_name, b.filename AS b_name, a.value AS a_value, b.value AS b_value, a.mine AS mine_name,
    a.org AS organisation, a.total AS ta, b.total AS tb, a.c AS ca, b.c AS cb, a.num AS na, b.num AS nb, a.term AS xa, b.term AS xb,
    row_number() OVER (PARTITION BY a.mk, a.field, a.vk, b.vk ORDER BY a.id, b.id) AS n
  FROM per a JOIN per b ON a.mk = b.mk AND a.field = b.field AND a.first_id < b.first_id
  WHERE CASE WHEN a.field IN ('quantity_extracted', 'reserve_estimate')
    THEN NOT coalesce(a.y <> b.y OR (a.y = b.y AND a.q <> b.q), false) ELSE a.id = a.first_id AND b.id = b.first_id END
), judged AS (
  SELECT *, na IS NOT NULL AND nb IS NOT NULL AS both_num, abs(na - nb) / greatest(abs(na), abs(nb)) >= 0.01 AS apart FROM pairs WHERE n = 1
), conflicts AS (
  SELECT concat('conflict:', field_name, ':', a_id, ':', b_id) AS id, 'conflict' AS type,
    CASE WHEN field_name IN ('quantity_extracted', 'reserve_estimate') THEN 'high' ELSE 'medium' END AS severity,
    field_name, mine_name, organisation, a_id, a_value, b_id, b_value,
    concat('Both documents describe the same mine but report a different ', replace(field_name, '_', ' '), '.',
      CASE WHEN ta > 1 OR tb > 1 THEN concat(' The first value appears in ', ta, ' document(s), the second in ', tb, '.') ELSE '' END) AS detail
  FROM judged WHERE CASE WHEN ca = cb THEN false WHEN replace(ca, ' ', '') = replace(cb, ' ', '') AND NOT (both_num AND apart) THEN false
    WHEN xa IS NOT NULL AND xb IS NOT NULL THEN xa <> xb WHEN both_num THEN apart
    ELSE NOT (ca <> '' AND cb <> '' AND (list_has_all(string_split(ca, ' '), string_split(cb, ' ')) OR list_has_all(string_split(cb, ' '), string_split(ca, ' ')))) END)"""
DUPLICATES = f"""dup AS (
  SELECT *, min(id) OVER (PARTITION BY {norm('filename')}) AS first_id FROM reports WHERE status = 'completed'
), duplicates AS (
  SELECT concat('duplicate:filename:', f.id, ':', d.id) AS id, 'duplicate' AS type, 'medium' AS severity, 'filename' AS field_name,
    coalesce(nullif(f.mine_name, ''), nullif(f.location, '')) AS mine_name, nullif(f.company_name, '') AS organisation, f.id AS a_id, f.filename AS a_value,
    d.id AS b_id, d.filename AS b_value, 'These entries share a filename, so the corpus may double-count them.' AS detail
  FROM dup d JOIN reports f ON f.id = d.first_id WHERE d.id > d.first_id)"""
MISSING = f"""missing AS (
  SELECT concat('missing:', field, ':', id) AS id, 'missing_data' AS type, 'low' AS severity, field AS field_name, {MINE} AS mine_name,
    nullif(company_name, '') AS organisation, reports.id AS a_id, CAST(NULL AS VARCHAR) AS a_value, CAST(NULL AS BIGINT) AS b_id, CAST(NULL AS VARCHAR) AS b_value,
    concat('The extractor returned no ', replace(field, '_', ' '), ' for this document.') AS detail
  FROM reports, (VALUES ('mineral_type'), ('quantity_extracted'), ('location')) v(field)
  WHERE status = 'completed' AND CASE field WHEN 'mineral_type' THEN {MINERAL} WHEN 'quantity_extracted' THEN {QTY} ELSE nullif(location, '') END IS NULL)"""
FAILURES = """failures AS (
  SELECT concat('error:', id) AS id, 'extraction_error' AS type, 'high' AS severity, 'status' AS field_name, nullif(mine_name, '') AS mine_name,
    nullif(company_name, '') AS organisation, reports.id AS a_id, coalesce(nullif(error_message, ''), 'Processing error') AS a_value, CAST(NULL AS BIGINT) AS b_id,
    CAST(NULL AS VARCHAR) AS b_value, 'The document was uploaded but could not be processed.' AS detail
  FROM reports WHERE status = 'error')"""
FINDINGS = f"{CONFLICTS}, {DUPLICATES}, {MISSING}, {FAILURES}, findings AS (SELECT * FROM conflicts UNION ALL SELECT * FROM duplicates UNION ALL SELECT * FROM missing UNION ALL SELECT * FROM failures)"
DECISIONS = "decisions AS (" + I.duck(I.DECISIONS) + """), latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY step DESC) AS n FROM decisions) WHERE n = 1 AND status <> 'pending')"""


def flat(findings: DataFrame) -> DataFrame:
    return findings.select("id", "type", "severity", "field_name", "mine_name", "organisation", F.col("source_a.document_id").alias("a_id"),
                           F.col("source_a.value").alias("a_value"), F.col("source_b.document_id").alias("b_id"), F.col("source_b.value").alias("b_value"), "detail")


# --- 2.8 findings -------------------------------------------------------------------------------------------------------

@query("f1_conflicts", WITH + f", {CONFLICTS} SELECT * FROM conflicts")
def f1(spark, d):
    return flat(D.conflicts(I.reports(spark, d)))


@query("f2_duplicates", WITH + f", {DUPLICATES} SELECT * FROM duplicates")
def f2(spark, d):
    return flat(D.duplicates(I.reports(spark, d)))


@query("f2b_content_duplicates", WITH + f""", t AS (
  SELECT id, filename, min(id) OVER (PARTITION BY {norm("concat(page1, chr(10), page2)")}) AS first_id FROM reports WHERE status = 'completed')
  SELECT concat('duplicate:content:', first_id, ':', id) AS id, first_id AS a_id, id AS b_id FROM t WHERE id > first_id""")
def f2b(spark, d):
    return flat(D.content_duplicates(I.reports(spark, d))).select("id", "a_id", "b_id")


@query("f3_missing_fields", WITH + f", {MISSING} SELECT * FROM missing")
def f3(spark, d):
    return flat(D.missing_fields(I.reports(spark, d)))


@query("f4_failures", WITH + f", {FAILURES} SELECT * FROM failures")
def f4(spark, d):
    return flat(D.failures(I.reports(spark, d)))


@query("f5_all_findings", WITH + f", {FINDINGS}, {DECISIONS} SELECT f.*, coalesce(l.status, 'pending') AS decision FROM findings f LEFT JOIN latest l ON f.id = l.finding_id")
def f5(spark, d):
    found = D.with_decisions(D.all_findings(I.reports(spark, d)), I.decisions(spark, d))
    return D.order_findings(found).select(
        "id", "type", "severity", "field_name", "mine_name", "organisation", F.col("source_a.document_id").alias("a_id"), F.col("source_a.value").alias("a_value"),
        F.col("source_b.document_id").alias("b_id"), F.col("source_b.value").alias("b_value"), "detail", "decision")


@query("f5_findings_in_scope", WITH.replace("reports AS", "all_reports AS") + ", reports AS (SELECT * FROM all_reports WHERE company_name = 'NATION_6'), " + FINDINGS + " SELECT * FROM findings")
def f5_scope(spark, d):
    return flat(D.all_findings(I.reports(spark, d), "NATION_6"))


@query("f6_apply_decisions", WITH + f", {FINDINGS}, {DECISIONS} SELECT finding_id, status, note, resolved_by FROM latest WHERE finding_id IN (SELECT id FROM findings)")
def f6(spark, d):
    return D.apply_decisions(D.all_findings(I.reports(spark, d)), I.decisions(spark, d)).drop("resolved_at")


@query("j2_findings_with_decisions", WITH + f", {FINDINGS}, {DECISIONS} SELECT m.id, coalesce(l.status, 'pending') AS decision, l.note FROM findings m LEFT JOIN latest l ON m.id = l.finding_id")
def j2(spark, d):
    return D.with_decisions(D.all_findings(I.reports(spark, d)), I.decisions(spark, d)).select("id", "decision", "note")


@query("p8_findings_by_status", WITH + f", {FINDINGS}, {DECISIONS} SELECT m.id, l.status AS decision FROM findings m JOIN latest l ON m.id = l.finding_id")
def p8(spark, d):
    return D.by_status(D.with_decisions(D.all_findings(I.reports(spark, d)), I.decisions(spark, d)), "decided").select("id", "decision")


@query("a5_finding_counts", WITH + f", {FINDINGS}, {DECISIONS}, j AS (SELECT f.*, coalesce(l.status, 'pending') AS decision FROM findings f LEFT JOIN latest l ON f.id = l.finding_id) "
       "SELECT type, count(*) AS total, count(*) FILTER (WHERE decision = 'pending') AS pending, count(*) FILTER (WHERE decision <> 'pending') AS resolved, "
       "count(*) FILTER (WHERE severity = 'high') AS high FROM j GROUP BY ROLLUP (type)")
def a5(spark, d):
    return D.finding_counts(D.with_decisions(D.all_findings(I.reports(spark, d)), I.decisions(spark, d)))


@query("w1_positions", WITH + f", {STATED}, p AS (SELECT mk AS mine_key, field, vk AS value_key, min(id) AS first_id, count(*) AS documents FROM stated GROUP BY 1, 2, 3) "
       "SELECT *, CAST(dense_rank() OVER (PARTITION BY mine_key, field ORDER BY first_id) AS INTEGER) AS position FROM p")
def w1(spark, d):
    return D.positions(I.reports(spark, d))


ORDERED = WITH + f", {FINDINGS} SELECT id, severity, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id) AS position FROM findings"


def in_places(ordered: DataFrame) -> DataFrame:
    """The rows of a sorted table with their places in it, from 1."""
    columns = ordered.columns
    rows = staged(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered").select(
        *columns, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    # One row per partition of the sort, so the running sum is over few rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").select(*columns, (F.col("offset") + F.col("at") + 1).alias("position"))


@query("w2_order_findings", ORDERED)
@query("w2_order_all_findings", ORDERED)
def w2(spark, d):
    return in_places(D.order_findings(D.all_findings(I.reports(spark, d))).select("id", "severity"))


# --- 2.3 scalar functions -----------------------------------------------------------------------------------------------

@query("n_text", WITH + f"""SELECT id, {norm('mine_name')} AS n1_norm, {canon('mine_name')} AS n2_canonical, array_to_string(list_sort(list_distinct(string_split({canon('mine_name')}, ' '))), ' ') AS n3_tokens,
  {KEY} AS n4_mine_key, {TERM.replace('CASE c', "CASE " + canon('extraction_method'))} AS n5_term, coalesce(regexp_replace(trim(page1), '[\\r\\n\\t]+', ' ', 'g'), '') AS n13_prompt,
  concat('topic-', regexp_replace(lower(split_part(topics_text, '|', 2)), '[^a-z0-9]+', '-', 'g')) AS n15_slug,
  CASE WHEN regexp_matches(lower(split_part(topics_text, '|', 2)), 'safety|hazard|dgms|methane|risk|incident') THEN 'safety'
    WHEN regexp_matches(lower(split_part(topics_text, '|', 2)), 'environment|reclamation|emission|pollution|moefcc|ecolog') THEN 'environment'
    WHEN regexp_matches(lower(split_part(topics_text, '|', 2)), 'coal|ore|mineral|lignite|seam|reserve|grade') THEN 'mineral'
    WHEN regexp_matches(lower(split_part(topics_text, '|', 2)), 'basin|block|region|district|state|field') THEN 'location' ELSE 'operation' END AS n15_category,
  CASE WHEN regexp_matches(lower(error_message), '429|quota|resource_exhausted') THEN 'quota' WHEN regexp_matches(lower(error_message), 'timed out|timeout') THEN 'timeout' ELSE 'other' END AS n18_error,
  concat(filename, ', page 2') AS n28_citation, sha256(page1) AS s19_hash FROM reports""")
def n_text(spark, d):
    topic = F.split("topics_text", r"\|").getItem(1)
    return I.flat_reports(spark, d).select(
        "id", text.norm_text(F.col("mine_name")).alias("n1_norm"), text.canonical(F.col("mine_name")).alias("n2_canonical"),
        F.array_join(F.array_sort(text.token_set(F.col("mine_name"))), " ").alias("n3_tokens"), text.mine_key(F.col("mine_name"), F.col("location")).alias("n4_mine_key"),
        text.known_term(text.canonical(F.col("extraction_method"))).alias("n5_term"), text.prompt_field(F.col("page1")).alias("n13_prompt"),
        text.topic_slug(topic).alias("n15_slug"), text.topic_category(topic).alias("n15_category"), text.error_category(F.col("error_message")).alias("n18_error"),
        text.citation_label(F.col("filename"), F.lit(2), F.col("id")).alias("n28_citation"), text.content_hash(F.col("page1")).alias("s19_hash"))


@query("n_numbers_periods", WITH + f"""SELECT id, CAST({QTY_NUM} AS DOUBLE) AS n7_quantity, p_year AS n8_year, p_quarter AS n8_quarter,
  coalesce(CASE id % 9 WHEN 2 THEN q_num WHEN 3 THEN 1199800000 + q_num WHEN 4 THEN q_num WHEN 5 THEN 199800000 + q_num ELSE q_num END, 0)::DOUBLE AS n11_production FROM reports""")
def n_numbers(spark, d):
    p = periods.period_of(F.col("report_date"))
    return I.flat_reports(spark, d).select(
        "id", numbers.quantity_value(text.field_of(F.col("quantity_extracted"), F.col("x_quantity_extracted"))).alias("n7_quantity"),
        p["year"].alias("n8_year"), p["quarter"].alias("n8_quarter"), numbers.production_number(F.col("quantity_extracted")).alias("n11_production"))


@query("n9_periods_differ", WITH + """SELECT a.id AS a, b.id AS b, coalesce(a.p_year <> b.p_year OR (a.p_year = b.p_year AND a.p_quarter <> b.p_quarter), false) AS differ
  FROM reports a JOIN reports b ON b.id = a.id + 1""")
def n9(spark, d):
    r = I.flat_reports(spark, d).select("id", periods.period_of(F.col("report_date")).alias("p"))
    a, b = r.select(F.col("id").alias("a"), F.col("p").alias("pa")), r.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("p").alias("pb"))
    return a.join(b, "a").select("a", "b", periods.periods_differ(*[F.col(x) for x in ("pa.year", "pa.quarter", "pb.year", "pb.quarter")]).alias("differ"))


@query("n10_values_conflict", WITH + f""", p AS (SELECT a.id, {canon('a.mineral_type')} AS ca, {canon('b.mineral_type')} AS cb, a.mineral_type AS va, b.mineral_type AS vb FROM reports a JOIN reports b ON b.id = a.id + 1)
  SELECT id, CASE WHEN coalesce(va, '') = '' OR coalesce(vb, '') = '' THEN false WHEN ca = cb THEN false
    WHEN 'bituminous coal' IN (ca, cb) THEN NOT ('coal' IN (ca, cb)) ELSE true END AS conflict FROM p""")
def n10(spark, d):
    r = I.flat_reports(spark, d).select("id", compare.parsed(F.col("mineral_type")).alias("p"))
    b = r.select((F.col("id") - 1).alias("id"), F.col("p").alias("q"))
    return r.join(b, "id").select("id", compare.values_conflict(F.col("p"), F.col("q")).alias("conflict"))


@query("n_documents", """SELECT doc_id, trim(regexp_replace(replace(text, chr(13), ''), '[ \\t]+', ' ', 'g'), chr(10) || chr(9) || chr(12) || ' ') AS n12_tidy, length(replace(text, chr(0), '')) AS s3_length,
  md5(substring(replace(text, chr(0), ''), 1, 50000)) AS s3_capped, '' AS n16_scripts, CAST(NULL AS VARCHAR) AS n17_script, false AS n17_complex,
  CAST(len(regexp_extract_all(text, '\\p{Nd}')) AS DOUBLE) / greatest(length(text), 1) AS n29_figures FROM documents""")
def n_documents(spark, d):
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", text.tidy_text(t).alias("n12_tidy"), F.length(text.clean_text(t)).cast("bigint").alias("s3_length"), F.md5(text.clean_text(t, 50_000).cast("binary")).alias("s3_capped"),
        F.array_join(text.scripts_in(t), ",").alias("n16_scripts"), text.dominant_script(t).alias("n17_script"), text.is_complex_script(t).alias("n17_complex"),
        text.mentions_figure(t).alias("n29_figures"))


@query("n14_shorten_name", WITH + """, n AS (SELECT id, concat('Annual statement of ', coalesce(mine_name, 'no mine'), ' ', filename) AS name FROM reports),
  e AS (SELECT *, regexp_extract(name, '(\\.[^.]{1,5})$', 1) AS ext FROM n), r AS (SELECT *, 33 - length(ext) AS room, left(name, length(name) - length(ext)) AS stem FROM e)
  SELECT id, CASE WHEN length(name) <= 34 THEN name ELSE concat(left(stem, CAST(ceil(room * CAST(0.62 AS DOUBLE)) AS INTEGER)), '…', right(stem, room - CAST(ceil(room * CAST(0.62 AS DOUBLE)) AS INTEGER)), ext) END AS short FROM r""")
def n14(spark, d):
    name = F.concat(F.lit("Annual statement of "), F.coalesce("mine_name", F.lit("no mine")), F.lit(" "), "filename")
    return I.flat_reports(spark, d).select("id", text.shorten_name(name).alias("short"))


@query("n19_n22_replies", "WITH replies AS (" + I.duck(I.REPLIES) + """) SELECT id, want_mine AS mine, want_mine IS NOT NULL AS known, id % 6 = 3 AS truncated FROM replies""")
def n19(spark, d):
    rows = N.parse_replies(I.spark_sql(spark, d, I.REPLIES))
    return rows.select("id", N.extracted(F.col("object"))["mine_name"].alias("mine"), N.matches_schema(F.col("object")).alias("known"), text.reply_truncated(F.col("reply")).alias("truncated"))


@query("n21_reply_array", WITH + "SELECT id, CASE id % 3 WHEN 0 THEN 'coal,ore' WHEN 1 THEN '' ELSE concat('x ', cast(id AS varchar)) END AS items FROM reports")
def n21(spark, d):
    said = F.when(F.col("id") % 3 == 0, F.lit('Topics: ["coal", "ore"] as asked')).when(F.col("id") % 3 == 1, F.lit("none")).otherwise(
        F.concat(F.lit('```json\n["x '), F.col("id").cast("string"), F.lit('"]\n```')))
    return I.flat_reports(spark, d).select("id", F.array_join(N.parse_reply_array(said), ",").alias("items"))


VARIANTS = WITH + f"""SELECT id, CASE WHEN id % 9 IN (0, 1) THEN '' WHEN id % 9 = 2 THEN concat(quantity_extracted, '|', q_num) WHEN id % 9 = 4 THEN concat(quantity_extracted, '|', q_num, '.0')
  WHEN id % 9 = 3 THEN concat('Q1 1998: ', b, ' t|Q1 1998: ', q_num, ' t') WHEN id % 9 = 5 THEN concat('FY1998: ', b, ' tonnes|FY1998: ', q_num, ' tonnes|', b, ' tonnes|1998')
  ELSE concat(b, ' MT|', q_num, ' MT|', b, '|', q_num) END AS variants FROM (SELECT *, concat(q_num // 1000, ',', lpad(cast(q_num % 1000 AS varchar), 3, '0')) AS b FROM reports)"""


@query("n23_n24_variants", VARIANTS)
@query("n23_n24_variants_all", VARIANTS)
def n23(spark, d):
    return I.flat_reports(spark, d).select("id", F.array_join(numbers.search_variants(F.col("quantity_extracted")), "|").alias("variants"))


WORDS = "SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}][\\p{L}\\p{N}_]*'), lambda x: length(x) >= 3) AS w FROM documents)"


@query("n25_words", WORDS)
@query("n25_words_all", WORDS)
def n25(spark, d):
    w = text.words(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("bigint").alias("words"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query("s3_clean_text", "SELECT doc_id, md5(substring(replace(text, chr(0), ''), 1, 50000)) AS capped FROM documents")
def s3_clean(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.clean_text(F.col("text"), 50_000).cast("binary")).alias("capped"))


@query("n26_rule_fields", WITH + "SELECT id, 'Coal' AS mineral, CAST(NULL AS VARCHAR) AS state, 'Opencast' AS method FROM reports")
def n26(spark, d):
    return I.flat_reports(spark, d).select("id", text.rule_fields(F.col("page2")).alias("r")).select("id", "r.*")


INDIC = "indic AS (" + I.duck(I.INDIC) + ")"
DIGITS = f"'{numbers.DEVANAGARI_DIGITS}{numbers.TELUGU_DIGITS}', '01234567890123456789'"
IN_SCRIPT = {"Devanagari": "900}-\\x{97F", "Telugu": "C00}-\\x{C7F", "Bengali": "980}-\\x{9FF", "Tamil": "B80}-\\x{BFF", "Gujarati": "A80}-\\x{AFF", "Odia": "B00}-\\x{B7F"}


def _script(c: str, name: str) -> str:
    return f"len(regexp_extract_all({c}, '[\\x{{{IN_SCRIPT[name]}}}]'))"


@query("n_indic_numbers", f"WITH {INDIC} SELECT id, translate(quantity, {DIGITS}) AS n6_folded, CAST(figure AS DOUBLE) AS n7_quantity, p_year AS n8_year, p_quarter AS n8_quarter, term AS n5_term FROM indic")
def n_indic(spark, d):
    rows = I.spark_sql(spark, d, I.INDIC)
    p = periods.period_of(F.col("reported"))
    return rows.select("id", numbers.fold_digits(F.col("quantity")).alias("n6_folded"), numbers.quantity_value(F.col("quantity")).alias("n7_quantity"), p["year"].alias("n8_year"),
                       p["quarter"].alias("n8_quarter"), text.known_term(text.canonical(F.col("stated"))).alias("n5_term"))


@query("n16_n17_scripts", f"""WITH {INDIC} SELECT id, array_to_string(list_filter([{", ".join(f"CASE WHEN {_script('body', n)} > 0 THEN '{n}' END" for n in IN_SCRIPT)}], lambda x: x IS NOT NULL), ',') AS n16_scripts,
  CASE WHEN {_script('body', 'Devanagari')} = 0 AND {_script('body', 'Telugu')} = 0 THEN NULL WHEN {_script('body', 'Devanagari')} >= {_script('body', 'Telugu')} THEN 'Devanagari' ELSE 'Telugu' END AS n17_script,
  {_script('body', 'Devanagari')} + {_script('body', 'Telugu')} > 0 AS n17_complex FROM indic""")
def n16(spark, d):
    t = F.col("body")
    return I.spark_sql(spark, d, I.INDIC).select("id", F.array_join(text.scripts_in(t), ",").alias("n16_scripts"), text.dominant_script(t).alias("n17_script"), text.is_complex_script(t).alias("n17_complex"))


@query("n26_rules_in_text", f"""WITH {INDIC}, l AS (SELECT id, lower(told) AS t FROM indic) SELECT id,
  CASE WHEN contains(t, 'lignite') THEN 'Lignite' WHEN contains(t, 'iron') THEN 'Iron Ore' WHEN contains(t, 'bauxite') THEN 'Bauxite' WHEN contains(t, 'copper') THEN 'Copper' WHEN contains(t, 'gold') THEN 'Gold' WHEN contains(t, 'coal') THEN 'Coal' END AS mineral,
  CASE WHEN contains(t, 'jharkhand') THEN 'Jharkhand, India' WHEN contains(t, 'odisha') THEN 'Odisha, India' WHEN contains(t, 'madhya pradesh') THEN 'Madhya Pradesh, India' WHEN contains(t, 'telangana') THEN 'Telangana, India' WHEN contains(t, 'bihar') THEN 'Bihar, India' END AS state,
  CASE WHEN regexp_matches(t, 'underground|under ground') THEN 'Underground' WHEN regexp_matches(t, 'opencast|open cast') THEN 'Opencast' END AS method FROM l""")
def n26_told(spark, d):
    return I.spark_sql(spark, d, I.INDIC).select("id", text.rule_fields(F.col("told")).alias("r")).select("id", "r.*")


# --- 2.1 sources and table maintenance ----------------------------------------------------------------------------------

@query("s1_read_reports", WITH + "SELECT id, filename, status, CAST(NULL AS VARCHAR) AS summary FROM reports WHERE status = 'completed'")
def s1(spark, d):
    from ..schemas import REPORTS as SCHEMA
    return S.conform(I.reports(spark, d).drop("summary"), SCHEMA).where("status = 'completed'").select("id", "filename", "status", "summary")


@query("s1_read_old_reports", WITH + """SELECT id, filename, status, CASE WHEN id % 2 = 0 THEN summary END AS summary, CASE WHEN id % 2 = 0 THEN x_reserve_estimate END AS reserve_estimate,
  CAST(CASE WHEN id % 2 = 0 THEN 2 END AS INTEGER) AS pages FROM reports""")
def s1_old(spark, d):
    """Files of the time before summaries, pages and extracted data beside new ones."""
    r = staged(I.reports(spark, d), "reports")
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    r.where("id % 2 = 0").write.parquet(f"{path}/new")
    r.where("id % 2 = 1").drop("summary", "page_texts", "extracted_data", "topics").write.parquet(f"{path}/old")
    found = S.read_reports(spark, f"{path}/new", f"{path}/old")
    return found.select("id", "filename", "status", "summary", F.col("extracted_data.reserve_estimate").alias("reserve_estimate"), F.when(F.col("page_texts").isNotNull(), F.size("page_texts")).alias("pages"))


@query("s2_report_pages", WITH + "SELECT id AS report_id, CAST(1 AS INTEGER) AS page, page1 AS text FROM reports UNION ALL SELECT id, 2, page2 FROM reports")
def s2(spark, d):
    return S.report_pages(I.reports(spark, d))


@query("s3_clean_reports", WITH + "SELECT id, concat(page1, chr(10), page2) AS raw_text, CAST(2 AS INTEGER) AS pages FROM reports")
def s3(spark, d):
    dirty = I.reports(spark, d).withColumn("raw_text", F.concat(F.lit("\0"), "raw_text"))
    return S.clean_reports(dirty).select("id", "raw_text", F.size("page_texts").alias("pages"))


@query("s4_pick_page_text", f"""WITH {PAGES}, n AS (SELECT report_id, page, text AS ocr, CASE WHEN report_id % 3 = 0 THEN ' ' WHEN report_id % 3 = 1 AND page > 1 THEN '' WHEN report_id % 2 = 0 THEN left(text, 90) ELSE text END AS native FROM pages_of),
  g AS (SELECT report_id, string_agg(native, chr(10) ORDER BY page) AS nat, string_agg(ocr, chr(10) ORDER BY page) AS o, bool_and(trim(native) = '') AS blank FROM n GROUP BY 1)
  SELECT report_id, md5(CASE WHEN length(trim(nat, chr(10) || ' ' || chr(9))) < 100 THEN o ELSE nat END) AS flat, length(trim(nat, chr(10) || ' ' || chr(9))) < 100 AS flat_is_ocr, blank AS pages_are_ocr FROM g""")
def s4(spark, d):
    rows = I.pages(spark, d).select("report_id", "page", F.col("text").alias("ocr"), F.when(F.col("report_id") % 3 == 0, " ").when(
        (F.col("report_id") % 3 == 1) & (F.col("page") > 1), "").when(F.col("report_id") % 2 == 0, F.left("text", F.lit(90))).otherwise(F.col("text")).alias("native"))
    return S.pick_page_text(rows).select("report_id", F.md5(F.col("flat").cast("binary")).alias("flat"), "flat_is_ocr", "pages_are_ocr")


@query("s5_text_layer", f"""WITH {PAGES} SELECT report_id, count(*) AS pages, CAST(sum(length(trim(text, chr(10) || chr(9) || ' '))) AS BIGINT) AS chars,
  sum(length(trim(text, chr(10) || chr(9) || ' '))) >= count(*) * 120 AS usable FROM pages_of GROUP BY 1""")
def s5(spark, d):
    return S.text_layer_profile(I.pages(spark, d))


@query("s7_csv_lines", WITH + """SELECT concat(id, ',', coalesce(CASE WHEN regexp_matches(quantity_extracted, '[",]') THEN concat('"', replace(quantity_extracted, '"', '""'), '"') ELSE quantity_extracted END, ''), ',', status) AS value FROM reports""")
def s7(spark, d):
    return K.csv_lines(I.flat_reports(spark, d).select("id", "quantity_extracted", "status"))


@query("s9_list_reports", WITH + "SELECT id, filename, x_reserve_estimate AS reserve_estimate, (SELECT count(*) FROM reports) AS total FROM reports ORDER BY upload_date DESC, id LIMIT 50 OFFSET 20")
def s9(spark, d):
    return S.list_reports(I.reports(spark, d), 20, 50).select("id", "filename", "reserve_estimate", "total")


@query("s11_delete_report", WITH + "SELECT id, status FROM reports WHERE id % 10 <> 3")
def s11(spark, d):
    r = I.reports(spark, d)
    return S.delete_reports(r, r.where("id % 10 = 3").select("id")).select("id", "status")


@query("s12_replace_passages", f"""WITH {PAGES} SELECT report_id, page, CASE WHEN report_id % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM pages_of WHERE report_id % 2 = 1 OR page = 1""")
def s12(spark, d):
    p = I.pages(spark, d).select("report_id", "page")
    new = p.where("report_id % 2 = 0 AND page = 1").withColumn("version", F.lit("new"))
    return K.replace_passages(p.withColumn("version", F.lit("old")), new)


@query("s12_check_counts", f"WITH {PAGES} SELECT report_id, count(*) AS chunks, count(*) - 1 AS vectors FROM pages_of WHERE report_id % 5 = 0 GROUP BY 1")
def s12b(spark, d):
    p = I.pages(spark, d).select("report_id", "page")
    return K.check_counts(p, p.where("report_id % 5 <> 0 OR page > 1"))


@query("s13_check_index_model", "SELECT 'hash-64' AS model, CAST(64 AS INTEGER) AS dimension, count(*) AS passages, false AS accepted FROM embeddings")
def s13(spark, d):
    meta = spark.range(1).select(F.lit("other").alias("model"), F.lit(64).alias("dimension"))
    return K.check_index_model(meta, I.vector_passages(spark, d), "hash-64", 64)


@query("s14_pending_reports", WITH + """, t AS (SELECT id FROM reports WHERE status = 'completed' AND id > 100 AND id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)), b AS (SELECT id FROM t ORDER BY id LIMIT 100)
  SELECT id, (SELECT max(id) FROM b) AS next_after, (SELECT count(*) FROM t) - (SELECT count(*) FROM b) AS remaining FROM b""")
def s14(spark, d):
    indexed = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 2 = 0").select(F.col("doc_id").alias("report_id"))
    return S.pending_reports(I.reports(spark, d), indexed, 100, 100)


@query("s15_index_stats", "SELECT count(*) AS passages, count(DISTINCT vec_id) AS reports, 'hash-64' AS model, CAST(64 AS INTEGER) AS dimension FROM embeddings")
def s15(spark, d):
    meta = spark.range(1).select(F.lit("hash-64").alias("model"), F.lit(64).alias("dimension"))
    return K.index_stats(I.vector_passages(spark, d), meta)


HISTORY = "history AS (" + I.duck(I.HISTORY) + ")"


@query("s16_recent_queries", f"WITH {HISTORY} SELECT id, question FROM history ORDER BY id DESC LIMIT 5")
def s16(spark, d):
    return S.recent_queries(I.history(spark, d)).select("id", "question")


@query("s16_append_history", f"WITH {HISTORY} SELECT id, question, answer, r1, r2 FROM history")
def s16_append(spark, d):
    """Appended in three batches."""
    h = staged(I.history(spark, d), "history")
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    for part in range(3):
        S.append_history(h.where(F.pmod(F.hash("id"), F.lit(3)) == part), path)
    found = spark.read.parquet(path)
    return found.select("id", "question", "answer", F.get("report_ids_used", F.lit(0)).alias("r1"), F.get("report_ids_used", F.lit(1)).alias("r2"))


@query("s17_latest_upload", WITH + "SELECT filename, max(id) AS id, arg_max(status, id) AS status FROM reports WHERE id > 50 GROUP BY 1")
def s17(spark, d):
    return S.latest_upload(I.reports(spark, d), 50)


def _all_parsed(spark, d):
    return I.flat_reports(spark, d).select(
        "id", F.when(F.col("status") != "error", F.col("page1")).alias("fields"), F.concat("error_message", F.lit("\0!")).alias("failure"), F.lit(False).alias("provider_failed"))


@query("s18_quarantine", WITH + """SELECT id, 'error' AS status, coalesce(concat(error_message || '!'), '') AS error_message FROM reports WHERE status = 'error' AND error_message IS NOT NULL
  UNION ALL SELECT id, 'error', 'No fields could be read' FROM reports WHERE status = 'error' AND error_message IS NULL""")
def s18(spark, d):
    return S.quarantine(_all_parsed(spark, d))[1]


@query("s18_quarantine_both", WITH + """SELECT id, 'completed' AS status, CAST(NULL AS VARCHAR) AS error_message, page1 AS fields FROM reports WHERE status <> 'error'
  UNION ALL SELECT id, 'error', CASE WHEN error_message IS NULL THEN 'No fields could be read' ELSE concat(error_message, '!') END, NULL FROM reports WHERE status = 'error'""")
def s18_both(spark, d):
    good, bad = S.quarantine(_all_parsed(spark, d))
    return good.select("id", "status", F.lit(None).cast("string").alias("error_message"), "fields").unionByName(bad.withColumn("fields", F.lit(None).cast("string")))


@query("s20_extraction_cache", WITH + "SELECT id, id % 2 = 0 AND id % 3 <> 0 AS hit FROM reports")
def s20(spark, d):
    todo = I.flat_reports(spark, d).select("id", F.concat("page1", F.col("id").cast("string")).alias("content"))
    key = F.sha2(F.concat_ws("\0", text.content_hash(F.col("content")), F.lit("m1"), F.lit("v1")), 256)
    cache = todo.where("id % 2 = 0").select(key.alias("key"), F.lit("{}").alias("payload"), F.when(F.col("id") % 3 == 0, "mock").otherwise("real").alias("provider"))
    return S.extraction_cache(todo, cache, F.lit("m1"), "v1").select("id", "hit")


# --- 2.2 projections and filters ----------------------------------------------------------------------------------------

@query("p1_p2_fields", WITH + f"""SELECT id, {METHOD} AS value_extraction_method, nullif(location, '') AS value_location, {MINERAL} AS value_mineral_type, {QTY} AS value_quantity_extracted,
  {RESERVE} AS value_reserve_estimate, coalesce(trim(extraction_method) <> '', false) AS has_extraction_method, coalesce(trim(location) <> '', false) AS has_location,
  coalesce(trim(coalesce(mineral_type, x_mineral_type)) <> '', false) AS has_mineral_type, coalesce(trim(coalesce(quantity_extracted, x_quantity_extracted)) <> '', false) AS has_quantity_extracted,
  coalesce(trim(x_reserve_estimate) <> '', false) AS has_reserve_estimate FROM reports""")
def p1(spark, d):
    return A.value_columns(I.reports(spark, d))


@query("p3_scope", WITH + "SELECT id, company_name FROM reports WHERE company_name = 'NATION_5'")
def p3(spark, d):
    return D.scope(I.reports(spark, d), "NATION_5").select("id", "company_name")


DOC = f"""docs AS (SELECT id, filename, CASE lower(split_part(filename, '.', -1)) WHEN 'docx' THEN 'DOCX' WHEN 'xlsx' THEN 'XLSX' WHEN 'png' THEN 'IMAGE' ELSE 'PDF' END AS file_type,
  CASE WHEN status IN ('processing', 'completed', 'error') THEN status ELSE 'pending' END AS status, upload_date, nullif(trim(mine_name), '') AS mine_name, nullif(trim(company_name), '') AS organisation,
  nullif(trim(location), '') AS location, x_district AS district, CAST(NULL AS VARCHAR) AS state, coalesce(nullif(trim(mineral_type), ''), nullif(trim(x_mineral_type), '')) AS mineral_type,
  coalesce(nullif(trim(quantity_extracted), ''), nullif(trim(x_quantity_extracted), '')) AS quantity_extracted, nullif(trim(extraction_method), '') AS extraction_method,
  nullif(trim(x_reserve_estimate), '') AS reserve_estimate, trim(summary) AS summary FROM reports)"""


@query("p4_to_document", WITH + f", {DOC} SELECT id, filename, file_type, status, mine_name, organisation, location, district, state, mineral_type, quantity_extracted, extraction_method, reserve_estimate, summary, CAST(2 AS INTEGER) AS page_count FROM docs")
def p4(spark, d):
    return V.to_document(I.reports(spark, d)).drop("upload_date", "topics")


@query("p5_search_documents", WITH + f", {DOC} SELECT id FROM docs WHERE contains(lower(filename), 'block 7') OR contains(lower(coalesce(mine_name, '')), 'block 7') OR contains(lower(coalesce(mineral_type, '')), 'block 7')")
def p5(spark, d):
    return V.search_documents(V.to_document(I.reports(spark, d)), "Block 7").select("id")


@query("p6_explore", WITH + f", {DOC} SELECT id, mine_name AS mine, extraction_method AS method FROM docs WHERE lower(extraction_method) = 'opencast' AND (contains(lower(coalesce(mine_name, '')), 'coal') OR contains(lower(coalesce(mineral_type, '')), 'coal'))")
def p6(spark, d):
    return V.explore(V.to_document(I.reports(spark, d)), "coal", "Opencast").select("id", "mine", "method")


@query("p6_explore_by_production", WITH + f""", {DOC}, x AS (SELECT id, mine_name AS mine, CAST(coalesce(nullif(regexp_extract(regexp_replace(coalesce(quantity_extracted, ''), '[^0-9.]', '', 'g'), '^([0-9]*\\.?[0-9]*)', 1), ''), '0') AS DOUBLE) AS production FROM docs)
  SELECT *, row_number() OVER (ORDER BY production DESC, id) AS position FROM x""")
def p6_sorted(spark, d):
    return in_places(V.explore(V.to_document(I.reports(spark, d))).select("id", "mine", "production"))


@query("p7_search_reports", WITH + "SELECT id FROM reports WHERE contains(lower(filename), 'nation_7') OR contains(lower(coalesce(mine_name, '')), 'nation_7') OR contains(lower(coalesce(company_name, '')), 'nation_7') OR contains(lower(location), 'nation_7') OR contains(lower(coalesce(mineral_type, '')), 'nation_7') ORDER BY id LIMIT 100")
def p7(spark, d):
    return V.search_reports(I.reports(spark, d), "Nation_7", 1000).select("id")


@query("p10_list_projection", WITH + "SELECT id, status, x_reserve_estimate AS reserve_estimate FROM reports")
def p10(spark, d):
    return S.list_projection(I.reports(spark, d)).select("id", "status", "reserve_estimate")


@query("w3_recent_documents", WITH + "SELECT id, filename FROM reports ORDER BY upload_date DESC, id DESC LIMIT 5")
def w3(spark, d):
    return V.recent_documents(V.to_document(I.reports(spark, d))).select("id", "filename")


@query("j4_not_indexed", WITH + "SELECT id FROM reports WHERE status = 'completed' AND id NOT IN (SELECT doc_id FROM documents)")
def j4(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"))
    return D.completed(I.reports(spark, d)).join(docs, "id", "left_anti").select("id")


@query("j6_sources_of_answers", WITH + f", {HISTORY}, u AS (SELECT id AS query_id, unnest([r1, r2]) AS report_id FROM history) SELECT query_id, report_id, coalesce(r.filename, concat('Report #', report_id)) AS name FROM u LEFT JOIN reports r ON r.id = u.report_id")
def j6(spark, d):
    return V.sources_of_answers(I.history(spark, d), I.reports(spark, d))


# --- 2.5 aggregations ---------------------------------------------------------------------------------------------------

@query("a1_stats", WITH + f", {HISTORY} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'error') AS errors, (SELECT count(*) FROM history) AS queries FROM reports WHERE company_name = 'NATION_1'")
def a1(spark, d):
    return A.stats(I.reports(spark, d), I.history(spark, d), "NATION_1")


@query("a2_distribution", WITH + "SELECT mineral_type AS label, count(*) AS reports FROM reports WHERE status = 'completed' AND mineral_type <> '' GROUP BY 1")
def a2(spark, d):
    return A.distribution(I.reports(spark, d), "mineral_type")


HAS = " + ".join(f"CAST(coalesce(trim({c}) <> '', false) AS INTEGER)" for c in ("extraction_method", "location", "coalesce(mineral_type, x_mineral_type)", "coalesce(quantity_extracted, x_quantity_extracted)", "x_reserve_estimate"))


@query("a3_coverage", WITH + f"SELECT count(*) AS documents, count(*) * 5 AS fields_expected, CAST(sum({HAS}) AS BIGINT) AS fields_populated, CAST(sum({HAS}) AS DOUBLE) / (count(*) * 5) AS ratio FROM reports WHERE status = 'completed'")
def a3(spark, d):
    return A.coverage(I.reports(spark, d))


@query("a4_organisations", WITH + f", {DOC} SELECT organisation AS name, count(*) AS reports FROM docs WHERE organisation IS NOT NULL GROUP BY 1")
def a4(spark, d):
    return A.organisations(V.to_document(I.reports(spark, d)))


STOP = ", ".join(f"'{w}'" for w in A.STOPWORDS)
TERMS = f"""w AS (SELECT doc_id AS report_id, unnest(x) AS term, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}][\\p{{L}}\\p{{N}}_]*'), lambda x: length(x) >= 3) AS x FROM documents)),
  c AS (SELECT report_id, term, count(*) AS n, min(pos) AS first FROM w WHERE term NOT IN ({STOP}) GROUP BY 1, 2)"""


@query("a9_top_terms", f"WITH {TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY n DESC, first) AS rank FROM c) SELECT report_id, term, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def a9(spark, d):
    return A.top_terms(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("report_id"), "text"))


@query("a9_corpus_terms", f"WITH {TERMS} SELECT term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1 ORDER BY n DESC, term LIMIT 25")
def a9b(spark, d):
    return A.corpus_terms(spark.read.parquet(f"{d}/documents.parquet").select("text"), 25)


TOPICS = "topics AS (SELECT DISTINCT id AS report_id, trim(t) AS term FROM (SELECT id, unnest(string_split(topics_text, '|')) AS t FROM reports) WHERE trim(t) <> '')"


@query("j8_co_occurrence", WITH + f", {TOPICS} SELECT a.term, b.term AS other, count(*) AS shared FROM topics a JOIN topics b USING (report_id) WHERE a.term <> b.term GROUP BY 1, 2")
def j8(spark, d):
    return A.co_occurrence(A.report_topics(I.reports(spark, d)))


ENTITIES = f"""{TOPICS}, co AS (SELECT a.term, b.term AS other, count(*) AS shared FROM topics a JOIN topics b USING (report_id) WHERE a.term <> b.term GROUP BY 1, 2),
  near AS (SELECT term, string_agg(other, ',' ORDER BY r) AS related FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY shared DESC, other) AS r FROM co) WHERE r <= 6 GROUP BY 1),
  cnt AS (SELECT term, count(*) AS documents FROM topics GROUP BY 1),
  entities AS (SELECT cnt.term AS name, documents, CAST(floor(CAST(documents * 100 AS DOUBLE) / (SELECT max(documents) FROM cnt) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS weight, coalesce(related, '') AS related,
    CASE WHEN contains(lower(cnt.term), 'safety') THEN 'safety' WHEN regexp_matches(lower(cnt.term), 'coal|ore|mineral|lignite|seam|reserve|grade') THEN 'mineral'
      WHEN regexp_matches(lower(cnt.term), 'basin|block|region|district|state|field') THEN 'location' ELSE 'operation' END AS category FROM cnt LEFT JOIN near USING (term))"""


def _entities(spark, d):
    return A.topic_entities(I.reports(spark, d)).select("name", "documents", "weight", F.array_join("related_terms", ",").alias("related"), "category")


@query("a10_topic_entities", WITH + f", {ENTITIES} SELECT * FROM entities")
def a10(spark, d):
    return _entities(spark, d)


@query("p9_topics_by_category", WITH + f", {ENTITIES} SELECT name FROM entities WHERE category = 'mineral'")
def p9(spark, d):
    return V.topics_by_category(_entities(spark, d), "mineral").select("name")


SHARE = f"""{TOPICS}, hit AS (SELECT DISTINCT t.name, o.report_id FROM (VALUES ('coal'), ('Mine Safety Drill'), ('block')) t(name) JOIN topics o ON contains(lower(o.term), lower(t.name)) OR contains(lower(t.name), lower(o.term)))"""


def _terms(spark):
    return spark.range(3).select(F.get(F.array(F.lit("coal"), F.lit("Mine Safety Drill"), F.lit("block")), F.col("id").cast("int")).alias("name"))


@query("j7_topic_documents", WITH + f", {SHARE} SELECT name, report_id FROM hit")
def j7(spark, d):
    return A.topic_documents(I.reports(spark, d), _terms(spark))


@query("a11_topic_share", WITH + f", {SHARE} SELECT name, count(*) AS documents, CAST(floor(CAST(count(*) * 100 AS DOUBLE) / (SELECT count(*) FROM reports) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS percent FROM hit GROUP BY 1")
def a11(spark, d):
    return A.topic_share(I.reports(spark, d), _terms(spark))


@query("a12_overview", WITH + "SELECT count(*) AS reports, (SELECT string_agg(m, ', ' ORDER BY m) FROM (SELECT DISTINCT mineral_type AS m FROM reports WHERE status = 'completed' AND mineral_type <> '')) AS minerals, "
       "(SELECT string_agg(m, ', ' ORDER BY m) FROM (SELECT DISTINCT location AS m FROM reports WHERE status = 'completed' AND location <> '')) AS locations FROM reports WHERE status = 'completed'")
def a12(spark, d):
    return A.dossier_overview(I.reports(spark, d))


@query("a12_production", WITH + "SELECT id, left(filename, 42) AS filename, left(coalesce(nullif(mineral_type, ''), '-'), 22) AS mineral_type, left(coalesce(nullif(quantity_extracted, ''), '-'), 22) AS quantity_extracted, "
       "left(coalesce(nullif(extraction_method, ''), '-'), 22) AS extraction_method FROM reports WHERE status = 'completed'")
def a12b(spark, d):
    return A.dossier_production(I.reports(spark, d))


@query("a12_findings", WITH + "SELECT id, filename, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos, unnest(f) AS finding FROM (SELECT id, filename, string_split(findings_text, '|') AS f FROM reports WHERE status = 'completed')")
def a12c(spark, d):
    return A.dossier_findings(I.reports(spark, d))


@query("a12_sources", WITH + "SELECT id, concat('[', id, '] ', filename, ' (2 pages)') AS line FROM reports WHERE status = 'completed'")
def a12d(spark, d):
    return A.dossier_sources(I.reports(spark, d))


@query("a15_analytics_export", WITH + f""", {HISTORY}, r AS (SELECT * FROM reports WHERE company_name = 'NATION_2') SELECT 0 AS part, 'Scope' AS section, 'Organisation' AS label, 'NATION_2' AS value
  UNION ALL SELECT 1, 'Totals', 'Documents', cast(count(*) AS varchar) FROM r UNION ALL SELECT 2, 'Totals', 'Completed', cast(count(*) FILTER (WHERE status = 'completed') AS varchar) FROM r
  UNION ALL SELECT 3, 'Totals', 'Errors', cast(count(*) FILTER (WHERE status = 'error') AS varchar) FROM r UNION ALL SELECT 4, 'Totals', 'Queries', cast(count(*) AS varchar) FROM history
  UNION ALL SELECT 5, 'Minerals', mineral_type, cast(count(*) AS varchar) FROM r WHERE status = 'completed' AND mineral_type <> '' GROUP BY mineral_type
  UNION ALL SELECT 6, 'Locations', location, cast(count(*) AS varchar) FROM r WHERE status = 'completed' AND location <> '' GROUP BY location""")
def a15(spark, d):
    return A.analytics_export(I.reports(spark, d), I.history(spark, d), "NATION_2")


@query("a17_summary_lines", WITH + """SELECT id, concat('District: ', x_district, CASE WHEN x_mineral_type <> '' THEN chr(10) || 'Mineral Type: ' || x_mineral_type ELSE '' END, chr(10) || 'Quantity Extracted: ' || x_quantity_extracted,
  CASE WHEN x_reserve_estimate <> '' THEN chr(10) || 'Reserve Estimate: ' || x_reserve_estimate ELSE '' END) AS lines FROM reports""")
def a17(spark, d):
    return A.report_summary_lines(I.reports(spark, d))


@query("a18_example_questions", WITH + f""", {DOC}, m AS (SELECT mineral_type AS v, row_number() OVER (ORDER BY min(id), mineral_type) AS n FROM docs WHERE mineral_type IS NOT NULL GROUP BY 1),
  i AS (SELECT mine_name AS v FROM docs WHERE mine_name IS NOT NULL GROUP BY 1 ORDER BY min(id), 1 LIMIT 1), l AS (SELECT location AS v FROM docs WHERE location IS NOT NULL GROUP BY 1 ORDER BY min(id), 1 LIMIT 1),
  o AS (SELECT organisation AS v FROM docs WHERE organisation IS NOT NULL GROUP BY 1 ORDER BY min(id), 1 LIMIT 1)
  SELECT CAST(0 AS INTEGER) AS place, concat('Compare the quantities reported for ', (SELECT v FROM m WHERE n = 1), ' and ', (SELECT v FROM m WHERE n = 2), '.') AS question
  UNION ALL SELECT 1, concat('Summarise the extraction method and reserves reported for ', v, '.') FROM i UNION ALL SELECT 2, concat('What do the indexed reports say about operations in ', v, '?') FROM l
  UNION ALL SELECT 3, concat('List the key findings reported by ', v, '.') FROM o""")
def a18(spark, d):
    return A.example_questions(V.to_document(I.reports(spark, d)))


# --- 2.7 passages, selection, retrieval, evidence -----------------------------------------------------------------------

CHUNKS = f"""{PAGES.replace('pages_of', 'raw_pages')}, pages_of AS (SELECT report_id, page, trim(regexp_replace(replace(text, chr(13), ''), '[ \\t]+', ' ', 'g'), chr(10) || chr(9) || chr(12) || ' ') AS t FROM raw_pages),
  steps AS (
    WITH RECURSIVE s AS (
      SELECT report_id, page, t, 0 AS k, 0 AS pos, CAST(NULL AS INTEGER) AS fin FROM pages_of WHERE length(t) > 0
      UNION ALL
      SELECT report_id, page, t, k + 1, CASE WHEN fin IS NULL THEN pos ELSE greatest(fin - 150, pos + 1) END, e FROM (
        SELECT *, CASE WHEN full_ = length(t) THEN full_ WHEN strpos(tail, ' .') > 0 THEN full_ - strpos(tail, ' .') WHEN strpos(tail, ' ') > 0 THEN full_ - strpos(tail, ' ') + 1 ELSE full_ END AS e FROM (
          SELECT *, least(st + 1200, length(t)) AS full_, reverse(substring(t, st + 601, greatest(least(st + 1200, length(t)) - st - 600, 0))) AS tail FROM (
            SELECT *, CASE WHEN fin IS NULL THEN 0 ELSE greatest(fin - 150, pos + 1) END AS st FROM s WHERE fin IS NULL OR fin < length(t))))
    ) SELECT * FROM s WHERE fin IS NOT NULL),
  chunks AS (SELECT report_id, page, content, CAST(row_number() OVER (PARTITION BY report_id ORDER BY page, k) - 1 AS INTEGER) AS chunk_index FROM (
    SELECT report_id, page, k, trim(substring(t, pos + 1, fin - pos), chr(10) || chr(9) || ' ') AS content FROM steps) WHERE length(content) > 0)"""


def _chunks(spark, d):
    return C.chunk_pages(I.pages(spark, d))


@query("c1_chunk_pages", f"WITH {CHUNKS} SELECT report_id, page, chunk_index, content FROM chunks")
def c1(spark, d):
    return _chunks(spark, d).select("report_id", "page", "chunk_index", "content")


@query("c2_chunk_paragraphs")
def c2(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return C.chunk_paragraphs(docs)


@query("c3_embed")
def c3(spark, d):
    return C.embed(_chunks(spark, d)).select("report_id", "chunk_index", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


HITS = """p AS (SELECT vec_id AS report_id, vec_id % 3 AS chunk_index, vec_id % 7 AS page, concat('file', vec_id) AS filename, concat('Text of ', vec_id % 90) AS content, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  ranked AS (SELECT q.report_id AS qid, p.*, list_cosine_similarity(q.e, p.e) AS sim, row_number() OVER (PARTITION BY q.report_id ORDER BY 1 - list_cosine_similarity(q.e, p.e), p.report_id, p.chunk_index) AS rank
    FROM p q JOIN p ON q.report_id % 20 = 0),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY qid, content ORDER BY rank) AS n FROM ranked WHERE rank <= 32),
  others AS (SELECT qid, content, list(report_id ORDER BY rank) AS ids FROM ranked WHERE rank <= 32 GROUP BY 1, 2),
  hits AS (SELECT f.qid, row_number() OVER (PARTITION BY f.qid ORDER BY f.rank) AS place, f.report_id, f.page, f.filename, f.content, f.sim, list_filter(o.ids, lambda x: x <> f.report_id) AS also_in
    FROM firsts f JOIN others o USING (qid, content) WHERE n = 1 QUALIFY place <= 8)"""


@also("c4_w5_cosine_search_20")
@query("c4_w5_cosine_search", f"WITH {HITS} SELECT qid, CAST(place AS INTEGER) AS place, report_id, filename, round(sim, 4) AS similarity, array_to_string(also_in, ',') AS also_in FROM hits")
def c4(spark, d):
    hits = Q.cosine_search(I.questions(spark, d), I.vector_passages(spark, d))
    return hits.select("qid", "place", "report_id", "filename", "similarity", F.array_join("also_in", ",").alias("also_in"))


@also("w4_top_k_per_query_20")
@query("w4_top_k_per_query", f"WITH {HITS} SELECT qid, CAST(rank AS INTEGER) AS rank, report_id FROM ranked WHERE rank <= 8")
def w4(spark, d):
    return Q.top_k_per_query(I.questions(spark, d), I.vector_passages(spark, d)).select("qid", "rank", "report_id")


@also("c5_retrieval_context_20")
@query("c5_retrieval_context", f"WITH {HITS} SELECT qid, string_agg(concat('[', filename, CASE WHEN page > 0 THEN concat(', page ', page) ELSE '' END, ']', chr(10), content), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context, count(*) AS cited FROM hits GROUP BY 1")
def c5(spark, d):
    return Q.retrieval_context(Q.cosine_search(I.questions(spark, d), I.vector_passages(spark, d))).select("qid", "context", "cited")


BLOCK = "concat('Report: ', filename, chr(10), 'Date: ', coalesce(report_date, ''), chr(10), 'Location: ', trim(coalesce(location, '')), chr(10), 'Mineral: ', trim(coalesce(mineral_type, '')), chr(10), 'Quantity: ', coalesce(quantity_extracted, ''), chr(10), 'Method: ', coalesce(extraction_method, ''), chr(10), 'Summary: ', trim(coalesce(summary, '')), chr(10), 'Topics: ', trim(replace(topics_text, '|', ', ')), chr(10))"


@query("c6_corpus_context", WITH + f"SELECT left(string_agg({BLOCK}, chr(10) || '---' || chr(10) ORDER BY id), 6000) AS context FROM reports WHERE status = 'completed' AND company_name = 'NATION_3'")
def c6(spark, d):
    return Q.corpus_context(I.reports(spark, d), "NATION_3")


@also("c7_answer_inputs_20")
@query("c7_answer_inputs", WITH + f""", {HITS}, c AS (SELECT qid, count(*) AS cited FROM hits GROUP BY 1), asked AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 20 = 0 UNION ALL SELECT -1)
  SELECT qid, CASE WHEN cited IS NULL THEN 'full-corpus' ELSE 'semantic' END AS mode, coalesce(cited, 0) AS cited FROM asked LEFT JOIN c USING (qid)""")
def c7(spark, d):
    asked = I.questions(spark, d).withColumn("question", F.lit("How much was produced?"))
    extra = spark.range(2).select((-F.col("id") - 1).alias("qid"), F.lit(None).cast("array<float>").alias("embedding"), F.when(F.col("id") == 0, "Why?").otherwise("  ").alias("question"))
    return Q.answer_inputs(asked.unionByName(extra), I.vector_passages(spark, d), I.reports(spark, d)).select("qid", "mode", "cited")


@query("c7_answer_contexts", WITH + f""", {HITS}, c AS (SELECT qid, string_agg(concat('[', filename, CASE WHEN page > 0 THEN concat(', page ', page) ELSE '' END, ']', chr(10), content), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context,
    array_to_string(list_sort(list_distinct(list(report_id))), ',') AS used FROM hits GROUP BY 1), asked AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 20 = 0 UNION ALL SELECT -1),
  f AS (SELECT left(string_agg({BLOCK}, chr(10) || '---' || chr(10) ORDER BY id), 6000) AS fallback FROM reports WHERE status = 'completed')
  SELECT qid, md5(coalesce(context, fallback)) AS context, coalesce(used, '') AS reports_used FROM asked LEFT JOIN c USING (qid), f""")
def c7_contexts(spark, d):
    asked = I.questions(spark, d).withColumn("question", F.lit("How much was produced?"))
    extra = spark.range(2).select((-F.col("id") - 1).alias("qid"), F.lit(None).cast("array<float>").alias("embedding"), F.when(F.col("id") == 0, "Why?").otherwise("  ").alias("question"))
    rows = Q.answer_inputs(asked.unionByName(extra), I.vector_passages(spark, d), I.reports(spark, d))
    return rows.select("qid", F.md5(F.col("context").cast("binary")).alias("context"), F.array_join("reports_used", ",").alias("reports_used"))


def _count(cue: str) -> str:
    return f"(length(l) - length(replace(l, '{cue}', ''))) // {len(cue)}"


HIT_SQL = {g: " + ".join(_count(c) for c in cues) for g, cues in C.FIELD_CUES.items()}


@query("c8_cue_score", f"WITH {CHUNKS}, g AS (SELECT report_id, chunk_index, content, " + ", ".join(f"{s} AS {g}" for g, s in HIT_SQL.items())
       + " FROM (SELECT *, lower(content) AS l FROM chunks)) SELECT report_id, chunk_index, round(" + " + ".join(f"CASE WHEN {g} > 0 THEN CAST(2 AS DOUBLE) ELSE 0 END" for g in HIT_SQL)
       + " + CAST(0.5 AS DOUBLE) * (" + " + ".join(f"least({g}, 3)" for g in HIT_SQL) + ") + CAST(len(regexp_extract_all(content, '\\p{Nd}')) AS DOUBLE) / length(content) * 12, 6) AS score FROM g")
def c8(spark, d):
    return C.with_cue_score(_chunks(spark, d)).select("report_id", "chunk_index", F.round("score", 6).alias("score"))


@query("c9_select_short", f"""WITH {CHUNKS} SELECT report_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS excerpt, count(DISTINCT page) AS pages FROM chunks GROUP BY 1 HAVING sum(length(content)) <= 8000""")
def c9(spark, d):
    chunks = _chunks(spark, d)
    short = chunks.groupBy("report_id").agg(F.sum(F.length("content")).alias("n")).where("n <= 8000")
    return L.select_passages(chunks).join(short, "report_id", "left_semi").select("report_id", F.md5(F.col("excerpt").cast("binary")).alias("excerpt"), F.size("pages").cast("bigint").alias("pages"))


@query("c9_select_passages")
def c9b(spark, d):
    return L.select_passages(_chunks(spark, d)).select("report_id", F.length("excerpt").alias("chars"), F.md5(F.col("excerpt").cast("binary")).alias("excerpt"), F.array_join("pages", ",").alias("pages"))


@query("e1_evidence_text", WITH + """SELECT concat('ev-', id, '-', field) AS id, id AS document_id, field, 2 AS page_number FROM (
    SELECT reports.id, v.field, CASE v.field WHEN 'reserve_estimate' THEN nullif(x_reserve_estimate, '') WHEN 'mineral_type' THEN coalesce(nullif(mineral_type, ''), nullif(x_mineral_type, '')) END AS value, page2
    FROM reports, (VALUES ('reserve_estimate'), ('mineral_type')) v(field)) WHERE value IS NOT NULL AND (field = 'reserve_estimate' OR contains(lower(page2), lower(trim(value))))""")
def e1(spark, d):
    r = I.reports(spark, d)
    found = E.locate_evidence(r, S.report_pages(r)).where(F.col("field").isin("reserve_estimate", "mineral_type"))
    return found.select("id", "document_id", "field", "page_number")


# The values, their variants and the patterns in SQL without lookarounds: what must stand around a figure is matched along and
# cut off again; a page's k-th match begins behind k pieces and k - 1 matches.
WANTED = f"""citable AS (
    SELECT reports.id, filename, v.field, v.label, trim(regexp_replace(CASE v.field WHEN 'quantity_extracted' THEN {QTY} WHEN 'reserve_estimate' THEN {RESERVE} WHEN 'mineral_type' THEN {MINERAL}
      WHEN 'extraction_method' THEN {METHOD} WHEN 'mine_name' THEN nullif(mine_name, '') ELSE nullif(location, '') END, '\\s+', ' ', 'g')) AS v,
      CASE v.field WHEN 'quantity_extracted' THEN {QTY} WHEN 'reserve_estimate' THEN {RESERVE} WHEN 'mineral_type' THEN {MINERAL}
      WHEN 'extraction_method' THEN {METHOD} WHEN 'mine_name' THEN nullif(mine_name, '') ELSE nullif(location, '') END AS value
    FROM reports, (VALUES {", ".join(f"('{f}', '{label}')" for f, label in CITABLE)}) v(field, label)),
  formed AS (SELECT *, regexp_extract(v, '[0-9][0-9,]*\\.?[0-9]*') AS figure,
    trim(regexp_extract(v, '(?i)[0-9][0-9,]*\\.?[0-9]*\\s*(?:million|billion|lakh|crore|thousand)?\\s*(?:tonnes?|tons?|mtpa|mt|cubic metres|cu\\.? ?m)\\b')) AS unit FROM citable WHERE v IS NOT NULL),
  forms AS (SELECT id, filename, field, label, value, unnest(list_filter(list_distinct([v, replace(v, ',', ''), unit, figure, replace(figure, ',', '')]), lambda x: length(x) >= 3)) AS variant FROM formed),
  wanted AS (SELECT *, CAST(row_number() OVER (PARTITION BY id, field ORDER BY length(variant) DESC, variant) - 1 AS INTEGER) AS rank,
    field IN ('quantity_extracted', 'reserve_estimate') AND regexp_matches(variant, '^[0-9,.\\s]+$') AS needs_cue,
    regexp_replace(regexp_replace(regexp_replace(variant, '([^\\p{{L}}\\p{{N}}\\s_])', '\\\\\\1', 'g'), '([0-9])([0-9])', '\\1[,[:space:]]*\\2', 'g'), '([0-9])([0-9])', '\\1[,[:space:]]*\\2', 'g') AS core FROM forms)"""
LOCATED = """tried AS (
    SELECT w.*, p.page, p.text, concat('(?i)', CASE WHEN regexp_matches(variant, '^[0-9]') THEN '(?:^|[^0-9.,])' ELSE '' END, core, CASE WHEN regexp_matches(variant, '[0-9]$') THEN '(?:[^0-9]|$)' ELSE '' END) AS whole
    FROM wanted w JOIN pages_of_reports p ON p.id = w.id),
  cut AS (SELECT *, regexp_extract_all(text, whole) AS hits, string_split_regex(text, whole) AS pieces FROM tried WHERE regexp_matches(text, whole)),
  each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM cut),
  spans AS (SELECT *, length(array_to_string(list_slice(pieces, 1, k), '')) + length(array_to_string(list_slice(hits, 1, k - 1), '')) + strpos(lower(hits[k]), lower(regexp_extract(hits[k], concat('(?i)', core)))) - 1 AS pos,
    length(regexp_extract(hits[k], concat('(?i)', core))) AS n FROM each),
  seen AS (SELECT *, greatest(pos - 220, 0) AS b, least(pos + n + 220, length(text)) AS e FROM spans),
  good AS (SELECT * FROM seen WHERE NOT needs_cue OR regexp_matches(lower(substring(text, b + 1, e - b)), CASE field WHEN 'reserve_estimate' THEN 'reserve|resource' ELSE 'production|produced|extracted|output' END)),
  evidence AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY rank, page, k) = 1)"""
EVIDENCE = """SELECT concat('ev-', id, '-', field) AS id, id AS document_id, filename AS document_name, field, label AS section_header, value AS extracted_value, CAST(page AS INTEGER) AS page_number,
  concat(CASE WHEN b > 0 THEN '… ' ELSE '' END, trim(regexp_replace(substring(text, b + 1, e - b), '\\s+', ' ', 'g')), CASE WHEN e < length(text) THEN ' …' ELSE '' END) AS original_context FROM evidence"""
SHORT = "pages_of_reports AS (SELECT id, 1 AS page, page1 AS text FROM reports UNION ALL SELECT id, 2, page2 FROM reports)"
LONG = f"long_pages AS ({I.duck(I.LONG_PAGES)}), " + SHORT.replace("FROM reports", "FROM long_pages")


@query("e1_locate_evidence", f"{WITH}, {WANTED}, {SHORT}, {LOCATED} {EVIDENCE}")
def e1b(spark, d):
    r = I.reports(spark, d)
    return E.locate_evidence(r, S.report_pages(r))


@query("e1_evidence_in_long_pages", f"{WITH}, {WANTED}, {LONG}, {LOCATED} {EVIDENCE}")
def e1_long(spark, d):
    return E.locate_evidence(I.reports(spark, d), I.long_pages(spark, d))


@query("j10_wanted_variants", f"{WITH}, {WANTED} SELECT id AS report_id, field, rank, variant, needs_cue FROM wanted")
def j10(spark, d):
    return E.wanted(I.reports(spark, d)).select("report_id", F.explode("wanted").alias("w")).select("report_id", "w.field", "w.rank", "w.variant", "w.needs_cue")


@query("n24_figures_in_text", f"""{WITH}, {WANTED}, {LONG}, {LOCATED} SELECT w.id AS report_id, w.page, w.field, w.variant, CAST(coalesce(s.pos + 1, 0) AS INTEGER) AS found_at
  FROM tried w LEFT JOIN spans s ON s.id = w.id AND s.page = w.page AND s.field = w.field AND s.rank = w.rank AND s.k = 1""")
def n24(spark, d):
    found = F.when(F.col("likely"), E.found_at()).otherwise(0)
    return E.tried(I.reports(spark, d), I.long_pages(spark, d)).select("report_id", "page", "field", "variant", found.alias("found_at"))


@query("s10_get_report", WITH + "SELECT min(id) AS id, CAST(2 AS INTEGER) AS page_count FROM reports WHERE id = 7")
def s10(spark, d):
    r = I.reports(spark, d)
    return S.get_report(r, E.locate_evidence(r.where("id = 7"), S.report_pages(r.where("id = 7"))), 7).select("id", "page_count")


@query("s10_get_report_evidence", f"{WITH}, {WANTED}, {SHORT}, {LOCATED}, e AS ({EVIDENCE}) SELECT r.id, r.status, CAST(2 AS INTEGER) AS page_count, coalesce((SELECT string_agg(e.id, ',' ORDER BY e.id) FROM e WHERE document_id = r.id), '') AS evidence FROM reports r WHERE r.id = (SELECT max(o_orderkey) FROM orders)")
def s10_evidence(spark, d):
    r = I.reports(spark, d)
    last = r.agg(F.max("id")).first()[0]
    return S.get_report(r, E.locate_evidence(r.where(F.col("id") == last), S.report_pages(r)), last).select("id", "status", "page_count", F.array_join("evidence", ",").alias("evidence"))


@query("a13_corpus_profile", f"""WITH {CHUNKS}, p AS (SELECT report_id, count(*) AS pages, CAST(sum(length(trim(text, chr(10) || chr(9) || ' '))) AS BIGINT) AS chars FROM raw_pages GROUP BY 1), c AS (SELECT report_id, count(*) AS passages FROM chunks GROUP BY 1)
  SELECT report_id, pages, chars, chars >= pages * 120 AS text_layer, coalesce(passages, 0) AS passages, 'Latin' AS script FROM p LEFT JOIN c USING (report_id)""")
def a13(spark, d):
    return A.corpus_profile(I.pages(spark, d), _chunks(spark, d)).drop("notes")


@query("a13_corpus_totals", f"""WITH {CHUNKS}, p AS (SELECT report_id, count(*) AS pages, sum(length(trim(text, chr(10) || chr(9) || ' '))) AS chars FROM raw_pages GROUP BY 1)
  SELECT (SELECT count(*) FROM p) AS documents, (SELECT CAST(sum(pages) AS BIGINT) FROM p) AS pages, count(*) AS passages, (SELECT count(*) FROM p WHERE chars < pages * 120) AS without_layer,
    CAST(ceil(CAST(count(*) AS DOUBLE) / 100) AS BIGINT) AS minutes FROM chunks""")
def a13b(spark, d):
    return A.corpus_totals(A.corpus_profile(I.pages(spark, d), _chunks(spark, d)))


@query("a14_capacity", f"""WITH {CHUNKS}, p AS (SELECT count(*) AS pages, count(DISTINCT report_id) AS documents FROM raw_pages), c AS (SELECT count(*) AS passages, sum(length(content)) AS chars FROM chunks)
  SELECT pages, documents, passages, round(CAST(passages AS DOUBLE) / pages, 4) AS per_page, round(CAST(chars AS DOUBLE) / passages, 2) AS chars_per_passage, round(CAST(passages AS DOUBLE) / documents, 4) AS per_document FROM p, c""")
def a14(spark, d):
    return A.capacity(I.pages(spark, d), _chunks(spark, d))


@query("a14_latency", "SELECT quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, max(value) AS max FROM events")
def a14b(spark, d):
    return A.latency(spark.read.parquet(f"{d}/events.parquet"), "value")


# --- scoring --------------------------------------------------------------------------------------------------------------

def _labels(spark: SparkSession, d: str) -> DataFrame:
    r = I.flat_reports(spark, d).where("status = 'completed'")
    doc = F.concat(F.lit("doc"), F.col("id").cast("string"))
    return r.select("id", doc.alias("document"), F.when(F.col("id") % 5 == 0, "hi").otherwise("en").alias("language"), F.when(F.col("id") % 3 == 0, "real").otherwise("synthetic").alias("corpus"),
                    F.when(F.col("id") % 4 == 0, "draft").otherwise("verified").alias("status"), F.when(F.col("id") % 7 != 0, "auditor").alias("labelled_by"),
                    F.struct(F.lit("https://x.org/a.pdf").alias("url"), F.sha2(F.col("id").cast("string"), 256).alias("sha256")).alias("source"),
                    F.map_filter(F.create_map(F.lit("mineral_type"), F.lit("Coal"), F.lit("extraction_method"), F.lit("opencast"), F.lit("location"), F.when(F.col("id") % 11 != 0, F.col("location")).otherwise(" ")),
                                 lambda k, v: v.isNotNull()).alias("expected"),
                    F.create_map(F.lit("mineral_type"), F.struct((F.col("id") % 3).cast("int").alias("page"), F.lit("coal seam").alias("quote"))).alias("evidence"))


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    r = I.flat_reports(spark, d).where("status = 'completed'")
    return r.select(F.concat(F.lit("doc"), F.col("id").cast("string")).alias("document"), F.explode(F.array(
        F.struct(F.lit("mineral_type").alias("field"), F.col("mineral_type").alias("actual")), F.struct(F.lit("extraction_method").alias("field"), F.col("extraction_method").alias("actual")))).alias("x")).select("document", "x.*")


VERDICTS = f"""v AS (SELECT concat('doc', id) AS document, CASE WHEN id % 3 = 0 THEN 'real' ELSE 'synthetic' END AS corpus, field,
    CASE WHEN coalesce(trim(actual), '') = '' THEN 'missing' WHEN {canon('actual')} = {canon('expected')} THEN 'exact'
      WHEN field = 'mineral_type' AND {canon('actual')} = 'bituminous coal' THEN 'equivalent' WHEN field = 'extraction_method' AND {canon('actual')} = 'open cast' THEN 'equivalent' ELSE 'wrong' END AS verdict
  FROM (SELECT id, v.field, CASE v.field WHEN 'mineral_type' THEN 'Coal' WHEN 'extraction_method' THEN 'opencast' ELSE CASE WHEN id % 11 <> 0 THEN location ELSE ' ' END END AS expected,
      CASE v.field WHEN 'mineral_type' THEN mineral_type WHEN 'extraction_method' THEN extraction_method END AS actual
    FROM reports, (VALUES ('mineral_type'), ('extraction_method'), ('location')) v(field) WHERE status = 'completed'))"""


@query("j5_n27_verdicts", WITH + f", {VERDICTS} SELECT document, corpus, field, verdict FROM v")
def j5(spark, d):
    return X.verdicts(_labels(spark, d), _extractions(spark, d)).select("document", "corpus", "field", "verdict")


@query("a6_score_per_field", WITH + f", {VERDICTS} SELECT field, " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in X.VERDICTS) + " FROM v GROUP BY 1")
def a6(spark, d):
    return X.score_per_field(X.verdicts(_labels(spark, d), _extractions(spark, d)))


BY_CORPUS = "s AS (SELECT corpus, count(*) AS scored, count(*) FILTER (WHERE verdict IN ('exact', 'equivalent')) AS correct FROM v GROUP BY ROLLUP (corpus))"


@query("a7_score_by_corpus", WITH + f", {VERDICTS}, {BY_CORPUS} SELECT corpus, scored, correct, round(CAST(correct AS DOUBLE) / scored, 6) AS accuracy FROM s")
def a7(spark, d):
    return X.score_by_corpus(X.verdicts(_labels(spark, d), _extractions(spark, d))).select("corpus", "scored", "correct", F.round("accuracy", 6).alias("accuracy"))


@query("a8_headline_accuracy", WITH + f", {VERDICTS}, {BY_CORPUS} SELECT 'real' AS corpus, (SELECT round(CAST(correct AS DOUBLE) / scored, 6) FROM s WHERE corpus = 'real') AS accuracy, (SELECT round(CAST(correct AS DOUBLE) / scored, 6) FROM s WHERE corpus = 'synthetic') AS beside")
def a8(spark, d):
    row = X.headline_accuracy(X.score_by_corpus(X.verdicts(_labels(spark, d), _extractions(spark, d))))
    return row.select("corpus", F.round("accuracy", 6).alias("accuracy"), F.round("beside", 6).alias("beside"))


@query("s8_measurement", WITH + f", {VERDICTS}, {BY_CORPUS} SELECT corpus, round(CAST(correct AS DOUBLE) / scored, 6) AS accuracy, true AS measured FROM s")
def s8(spark, d):
    path = f"{shared_dir(spark)}/measurement-{uuid.uuid4().hex}"
    K.write_measurement(X.score_by_corpus(X.verdicts(_labels(spark, d), _extractions(spark, d))).select("corpus", "scored", "correct", "accuracy"), path)
    return K.read_measurement(spark, path).select("corpus", F.round("accuracy", 6).alias("accuracy"), "measured")


@query("a16_label_census", WITH + "SELECT CASE WHEN id % 3 = 0 THEN 'real' ELSE 'synthetic' END AS corpus, count(*) AS labels, count(*) FILTER (WHERE id % 4 = 0) AS drafts FROM reports WHERE status = 'completed' GROUP BY 1")
def a16(spark, d):
    return A.label_census(_labels(spark, d))


@query("f7_label_problems", WITH + """, c AS (SELECT *, concat('doc', id) AS document, id % 3 = 0 AS real FROM reports WHERE status = 'completed')
  SELECT document, CAST(NULL AS VARCHAR) AS field, 'a verified label must say who checked it (labelled_by)' AS problem FROM c WHERE real AND id % 4 <> 0 AND id % 7 = 0
  UNION ALL SELECT document, 'location', 'is blank - delete fields the document does not state' FROM c WHERE id % 11 = 0
  UNION ALL SELECT document, field, 'needs evidence.page - the page it was read on' FROM c, (VALUES ('extraction_method'), ('location'), ('mineral_type')) v(field) WHERE real
  UNION ALL SELECT document, field, 'needs evidence.quote - the words on that page' FROM c, (VALUES ('extraction_method'), ('location')) v(field) WHERE real
  UNION ALL SELECT document, 'location', 'is blank - delete fields the document does not state' FROM c WHERE id % 11 <> 0 AND location = ''""")
def f7(spark, d):
    return X.label_problems(_labels(spark, d))


def _shelf(spark, d):
    return _labels(spark, d).where("id % 13 <> 0").select("document", F.when(F.col("id") % 10 == 0, F.lit("0")).otherwise(F.col("source.sha256")).alias("sha256"))


@query("j9_absent_documents", WITH + "SELECT concat('doc', id) AS document FROM reports WHERE status = 'completed' AND id % 13 = 0")
def j9(spark, d):
    return X.absent_documents(_labels(spark, d), _shelf(spark, d))


@query("j9_changed_documents", WITH + "SELECT concat('doc', id) AS document, sha256(cast(id AS varchar)) AS pinned FROM reports WHERE status = 'completed' AND id % 13 <> 0 AND id % 10 = 0")
def j9b(spark, d):
    return X.changed_documents(_labels(spark, d), _shelf(spark, d)).select("document", "pinned")


@query("f8_scoreable_labels", WITH + "SELECT concat('doc', id) AS document FROM reports WHERE status = 'completed' AND id % 4 <> 0")
def f8(spark, d):
    return X.scoreable_labels(_labels(spark, d)).select("document")


GATE = WITH + ("SELECT 'documents changed since they were labelled' AS reason, count(*) AS n FROM reports WHERE status = 'completed' AND id % 13 <> 0 AND id % 10 = 0 UNION ALL SELECT 'documents are absent', count(*) FROM reports WHERE status = 'completed' AND id % 13 = 0 "
               f"UNION ALL SELECT 'extractions came from the fallback', count(*) FROM reports WHERE status = 'completed' AND id % 6 = 0 UNION ALL SELECT 'labels are malformed', count(*) FROM ({ORACLES['f7_label_problems']})")


@query("f8_run_gate", GATE)
@query("f8_run_gate_all", GATE)
def f8_gate(spark, d):
    labels = _labels(spark, d)
    source = labels.select("document", F.when(F.col("id") % 6 == 0, "mock").otherwise("real").alias("provider"))
    return X.run_gate(labels, _shelf(spark, d), source)


# --- 2.9 streaming operators in batch form ------------------------------------------------------------------------------

def _calls(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), "ts")


# A call's decision depends on earlier decisions: the walk takes every key's next call in each round and carries the accepted times.
WALK = """WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS call_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  walk AS (
    SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS call_id, CAST(NULL AS DOUBLE) AS t, CAST([] AS DOUBLE[]) AS kept, CAST(NULL AS BOOLEAN) AS allowed, CAST(0 AS BIGINT) AS held, CAST(0 AS DOUBLE) AS oldest FROM c WHERE n = 1
    UNION ALL
    SELECT key, n, call_id, t, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END, len(live) < 2, len(live), coalesce(live[1], 0)
    FROM (SELECT c.key, c.n, c.call_id, c.t, list_filter(walk.kept, lambda x: x > c.t - 86400) AS live FROM walk JOIN c ON c.key = walk.key AND c.n = walk.n + 1))
  SELECT key, call_id, t AS called_at, allowed, CAST(CASE WHEN allowed THEN 1 - held ELSE 0 END AS INTEGER) AS remaining,
    CAST(CASE WHEN allowed THEN 0 ELSE greatest(trunc(oldest + 86400 - t) + 1, 1) END AS INTEGER) AS retry_after FROM walk WHERE n > 0"""


@query("t1_rate_audit", WALK)
def t1(spark, d):
    return T.rate_audit(_calls(spark, d), limit=2, window=86_400).withColumnRenamed("at", "called_at")


def _streamed(rows: DataFrame, name: str) -> DataFrame:
    """A stream of a derived table. The table's column `part` says in which order its rows come; a batch holds at most four files, which
    may be of two parts."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    parts = sorted(r[0] for r in rows.select("part").distinct().collect())  # a few numbers
    for part in parts:
        rows.where(F.col("part") == part).drop("part").coalesce(4).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 4).parquet(path)


@query("t1_rate_audit_stream", WALK)
def t1b(spark, d):
    """The calls come in four parts without order; a last call a day after them moves the watermark past all."""
    calls = _calls(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    ends = calls.agg(F.max("ts").alias("ts"), F.min("ts").alias("first"))
    last = ends.select(F.lit(None).cast(calls.schema["key"].dataType).alias("key"), F.lit(-1).cast("long").alias("call_id"), (F.col("ts") + F.expr("INTERVAL 4000 DAYS")).alias("ts"), F.lit(9).alias("part"))
    live = _streamed(staged(calls.withColumn("part", F.pmod(F.hash("call_id"), F.lit(4))).unionByName(last), "calls"), "calls-in")
    return T.run_to_table(T.rate_audit_stream(live, 2, 86_400, "3999 days"), "rate-audit").where("call_id >= 0").withColumnRenamed("at", "called_at")


@query("t2_ingest", f"""WITH {PAGES} SELECT report_id AS id, min(filename) AS filename, count(*) AS pages, CAST(least(sum(length(text)) + count(*) - 1, 50000) AS BIGINT) AS chars FROM pages_of GROUP BY 1""")
def t2(spark, d):
    return T.ingest(I.pages(spark, d)).select("id", "filename", F.size("page_texts").cast("bigint").alias("pages"), F.length("raw_text").cast("bigint").alias("chars"))


INGESTED = f"""WITH {PAGES} SELECT report_id AS id, min(filename) AS filename, count(*) AS pages, CAST(least(sum(length(text)) + count(*) - 1, 50000) AS BIGINT) AS chars,
  md5(substring(string_agg(replace(text, chr(0), ''), chr(10) ORDER BY page), 1, 50000)) AS raw_text FROM pages_of GROUP BY 1 HAVING length(trim(string_agg(text, '' ORDER BY page), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) > 0"""


@query("t2_ingest_stream", INGESTED)
def t2_stream(spark, d):
    """The pages of every report come over three batches, those of every third report without their number; a last page moves the
    watermark on."""
    pages = I.pages(spark, d)
    counts = pages.groupBy("report_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    sent = pages.join(counts, "report_id").select(
        "report_id", "filename", "page", "text", F.when(F.col("report_id") % 3 > 0, F.col("page_count")).alias("page_count"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page")).alias("uploaded_at"), F.pmod(F.hash("report_id", "page"), F.lit(3)).alias("part"))
    last = spark.range(2).select((-F.col("id") - 1).alias("report_id"), F.lit("last").alias("filename"), F.lit(1).alias("page"), F.lit("").alias("text"), F.lit(1).alias("page_count"),
                                 F.timestamp_seconds(F.lit(1_800_000_000) + F.col("id")).alias("uploaded_at"), (F.col("id") + 8).cast("int").alias("part"))
    live = _streamed(staged(sent.unionByName(last), "sent"), "pages-in")
    out = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    T.ingest_stream(live, out, f"{out}-log").awaitTermination()
    return spark.read.parquet(f"{out}/reports").where("id >= 0").select(
        "id", "filename", F.size("page_texts").cast("bigint").alias("pages"), F.length("raw_text").cast("bigint").alias("chars"), F.md5(F.col("raw_text").cast("binary")).alias("raw_text"))


@query("t3_passages", WITH + f"SELECT id AS report_id, page, chunk_index FROM (SELECT id, 1 AS page, 0 AS chunk_index FROM reports UNION ALL SELECT id, 2, 1 FROM reports)")
def t3(spark, d):
    return C.embed(C.chunk_pages(C.pages_or_raw(I.reports(spark, d)))).select("report_id", "page", "chunk_index")


@query("t3_passage_stream", WITH + """, t AS (SELECT id, filename, CASE WHEN id % 5 = 0 THEN concat('Revised. ', page1) ELSE page1 END AS page1, page2 FROM reports WHERE status = 'completed')
  SELECT id AS report_id, filename, CAST(1 AS INTEGER) AS page, CAST(0 AS INTEGER) AS chunk_index, page1 AS content FROM t UNION ALL SELECT id, filename, 2, 1, page2 FROM t""")
def t3_stream(spark, d):
    """Reports come in three batches, every fifth one again in a last batch with a revised page; the passages table is read whole."""
    r = I.reports(spark, d)
    again = r.where("id % 5 = 0").withColumn("page_texts", F.transform("page_texts", lambda t, k: F.when(k == 0, F.concat(F.lit("Revised. "), t)).otherwise(t)))
    both = r.withColumn("part", F.pmod(F.hash("id"), F.lit(3))).unionByName(again.withColumn("part", F.lit(9)))
    live = _streamed(staged(both.withColumn("arrived", F.col("part")), "arrived"), "reports-in")
    out = f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}"
    T.passage_stream(live, out, f"{out}-log", order="arrived").awaitTermination()
    return K.read_passages(spark, out).select("report_id", "filename", "page", "chunk_index", "content")


@query("s12_write_passages", f"""WITH {PAGES} SELECT report_id, page, CASE WHEN report_id % 7 = 0 THEN 'third' WHEN report_id % 2 = 0 THEN 'second' ELSE 'first' END AS version
  FROM pages_of WHERE report_id % 7 = 0 OR report_id % 2 = 1 OR page = 1""")
def s12_write(spark, d):
    """Three writes, each replacing the passages of its reports, into a table whose buckets split as it grows."""
    p = I.pages(spark, d).select("report_id", "page")
    root = f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}"
    for version, rows in (("first", p), ("second", p.where("report_id % 2 = 0 AND page = 1")), ("third", p.where("report_id % 7 = 0"))):
        K.write_passages(rows.withColumn("version", F.lit(version)), root, rows_per_bucket=10_000)
    return K.read_passages(spark, root).select("report_id", "page", "version")


@query("t4_latest_decisions", f"WITH {DECISIONS} SELECT finding_id, status, note, resolved_by FROM latest")
def t4(spark, d):
    return D.latest_decisions(I.decisions(spark, d)).drop("resolved_at")


@query("t4_decision_stream", f"WITH {DECISIONS} SELECT finding_id, status, note, resolved_by FROM latest")
def t4_stream(spark, d):
    """Later decisions come first for some findings, over three batches and two checkpoints."""
    rows = I.decisions(spark, d).select("finding_id", "status", "note", "resolved_by", "resolved_at", F.pmod(F.hash("finding_id", "note"), F.lit(4)).alias("part"))
    rows = staged(rows, "decided")
    store = f"{shared_dir(spark)}/decisions-{uuid.uuid4().hex}"
    for k, some in enumerate((rows.where("part < 3"), rows.where("part = 3"))):
        T.decision_stream(_streamed(some, "decisions-in"), store, f"{store}-log{k}").awaitTermination()
    return T.current_decisions(spark, store).drop("resolved_at")


def _account(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("account"), F.col("ts").alias("created_at"))


@query("t5_query_counts", "SELECT user_id AS account, cast(epoch(ts) AS bigint) // 86400 AS day, count(*) AS queries FROM events GROUP BY 1, 2")
def t5(spark, d):
    return T.query_counts(_account(spark, d), "1 day").select("account", F.floor(F.unix_timestamp("start") / 86400).alias("day"), "queries")


@query("t5_query_sessions", """WITH s AS (SELECT user_id AS account, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY account ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s) SELECT account, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS queries FROM g GROUP BY account, n""")
def t5b(spark, d):
    return T.query_sessions(_account(spark, d), "6 hours").select("account", F.unix_timestamp("start").alias("started"), "queries")
