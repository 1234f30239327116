"""Inputs of the registered queries, derived from the given tables by SQL that runs unchanged on Spark and DuckDB.

Names in braces are tables. Reports come from orders, customers and line items; pages from documents; decisions, labels,
questions and replies from reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXTRACTED_LISTS, EXTRACTED_ONLY, EXTRACTED_TEXT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

REPORTS = """
SELECT b.id, concat(CASE WHEN b.id % 2 = 0 THEN 'Report_' ELSE 'REPORT_' END, cast(b.file_no AS varchar(20)),
         CASE b.file_no % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.png' WHEN 3 THEN '.PDF' ELSE '.pdf' END) AS filename,
  b.upload_date,
  CASE b.id % 5 WHEN 0 THEN cast(b.day AS varchar(20)) WHEN 1 THEN concat('Q', cast(b.quarter AS varchar(1)), ' ', cast(b.year AS varchar(4)))
    WHEN 2 THEN concat('March ', cast(b.year AS varchar(4))) WHEN 3 THEN cast(b.year AS varchar(4)) END AS report_date,
  CASE b.id % 5 WHEN 4 THEN NULL ELSE b.year END AS p_year,
  CASE b.id % 5 WHEN 0 THEN b.quarter WHEN 1 THEN b.quarter WHEN 2 THEN 1 END AS p_quarter,
  CASE WHEN b.id % 11 = 0 THEN '' ELSE b.nation END AS location,
  CASE b.id % 7 WHEN 0 THEN 'Coal' WHEN 1 THEN 'Bituminous Coal' WHEN 2 THEN 'coal' WHEN 3 THEN 'Iron Ore' WHEN 4 THEN '' WHEN 5 THEN 'Coal ' END AS mineral_type,
  CASE b.id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(cast(b.figure AS varchar(20)), ' t')
    WHEN 3 THEN concat('Q1 1998: ', b.grouped, ' t') WHEN 4 THEN concat(cast(b.figure AS varchar(20)), '.0 MT')
    WHEN 5 THEN concat('FY1998: ', b.grouped, ' tonnes') ELSE concat(b.grouped, ' MT') END AS quantity_extracted,
  CASE WHEN b.id % 9 < 2 THEN NULL ELSE b.figure END AS q_num,
  CASE b.id % 6 WHEN 0 THEN 'Open Cast' WHEN 1 THEN 'opencast' WHEN 2 THEN 'Open-cast' WHEN 3 THEN 'Underground' WHEN 4 THEN 'sub-surface' END AS extraction_method,
  CASE WHEN b.id % 13 = 0 THEN NULL WHEN b.id % 13 = 1 THEN concat(' ', b.nation, ' ') ELSE b.nation END AS company_name,
  CASE WHEN b.id % 23 = 0 THEN NULL ELSE CASE b.id % 4 WHEN 0 THEN concat('Block ', b.mine, ' Mine') WHEN 1 THEN concat('BLOCK ', b.mine, ' Colliery Ltd')
    WHEN 2 THEN concat('Colliery, Block-', b.mine) ELSE concat('block  ', b.mine) END END AS mine_name,
  concat('Summary of ', b.nation, ': ', b.priority) AS summary,
  CASE WHEN b.state = 'P' THEN CASE b.id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'processing' ELSE 'queued' END ELSE 'completed' END AS status,
  CASE WHEN b.state = 'P' AND b.id % 3 = 0 AND b.id % 2 = 0 THEN CASE b.id % 4 WHEN 0 THEN 'HTTP 429 quota' ELSE 'request timed out' END END AS error_message,
  concat('coal reserves|', b.nation, ' block', CASE WHEN b.id % 3 = 0 THEN '|mine safety' ELSE '' END, CASE WHEN b.id % 4 = 0 THEN '| |haulage' ELSE '' END) AS topics_text,
  CASE WHEN b.id % 7 = 0 THEN NULL ELSE concat(cast(500 + 10 * (b.id % 4) AS varchar(20)), ' million tonnes') END AS x_reserve_estimate,
  CASE WHEN b.id % 7 = 0 THEN NULL ELSE 500 + 10 * (b.id % 4) END AS r_num,
  CASE WHEN b.id % 2 = 0 THEN 'Limestone' ELSE '' END AS x_mineral_type,
  CASE WHEN b.id % 4 = 1 THEN concat(cast(b.figure AS varchar(20)), ' t') ELSE '  ' END AS x_quantity_extracted,
  CASE WHEN b.id % 4 = 1 THEN b.figure END AS xq_num,
  concat('District ', cast(b.id % 40 AS varchar(3))) AS x_district,
  CASE WHEN b.id % 5 = 0 THEN NULL ELSE concat('Output of block ', b.mine, ' rose|Safety drills held') END AS findings_text,
  concat('Annual report of ', b.nation, '. The mine block ', b.mine, ' lies in District ', cast(b.id % 40 AS varchar(3)), '.') AS page1,
  concat('The production of the year was ', CASE WHEN b.id % 3 = 0 THEN b.grouped ELSE cast(b.figure AS varchar(20)) END, ' tonnes of coal. Proved reserves: ',
    cast(500 + 10 * (b.id % 4) AS varchar(20)), ' million tonnes, worked by opencast in ', b.nation, '.') AS page2
FROM (
  SELECT o.o_orderkey AS id, cast(floor(o.o_orderkey / 3) AS bigint) AS file_no, o.o_orderdate AS upload_date, cast(o.o_orderdate AS date) AS day,
    year(o.o_orderdate) AS year, quarter(o.o_orderdate) AS quarter, n.n_name AS nation, o.o_orderpriority AS priority, o.o_orderstatus AS state,
    cast(cast(floor(o.o_custkey / 4) AS bigint) AS varchar(20)) AS mine, 45000 + 3500 * (o.o_orderkey % 3) AS figure,
    concat(cast(cast(floor((45000 + 3500 * (o.o_orderkey % 3)) / 1000) AS bigint) AS varchar(20)), ',',
      lpad(cast((45000 + 3500 * (o.o_orderkey % 3)) % 1000 AS varchar(3)), 3, '0')) AS grouped
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
) b
"""

#: Pages of the reports with long stretches around what is looked for, and a figure first where no cue stands.
LONG_PAGES = """
SELECT r.id, concat(repeat('Survey notes of the region. ', 12), r.page1, repeat(' Further remarks follow here.', 15)) AS page1,
  concat('Plate ', CASE r.id % 3 WHEN 0 THEN '45,000' WHEN 1 THEN '48500' ELSE '52000' END, ' shows the pit. ', repeat('Nothing else is said on this. ', 12), r.page2,
    repeat(' More in the annex.', 14)) AS page2
FROM ({reports}) r
""".replace("{reports}", REPORTS)

#: Values in Hindi and Telugu, texts in several scripts, and sentences for the keyword rules; figure, period and term as they are meant.
INDIC = """
SELECT b.id, CASE b.id % 6 WHEN 0 THEN concat('पहली तिमाही 1998: ', b.deva, ' टन') WHEN 1 THEN concat('త్రైమాసికం 2 1998: ', b.telu, ' టన్నులు') WHEN 2 THEN concat('वित्तीय वर्ष 1998 में ', b.latin, ' टन')
    WHEN 3 THEN concat(b.telu, ' టన్నులు') WHEN 4 THEN 'पहली तिमाही 1998' ELSE concat('मार्च 1998: ', b.deva, ' टन') END AS quantity,
  CASE WHEN b.id % 6 = 4 THEN NULL ELSE b.figure END AS figure,
  CASE b.id % 7 WHEN 0 THEN 'दूसरी तिमाही १९९८' WHEN 1 THEN 'మూడవ త్రైమాసికం ౧౯౯౮' WHEN 2 THEN 'दिसंबर 1998' WHEN 3 THEN 'ఆగస్టు ౧౯౯౮' WHEN 4 THEN '१९९८' WHEN 5 THEN 'తెలియదు' END AS reported,
  CASE WHEN b.id % 7 < 5 THEN 1998 END AS p_year, CASE b.id % 7 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 3 END AS p_quarter,
  CASE b.id % 8 WHEN 0 THEN ' कोयला ' WHEN 1 THEN 'బొగ్గు' WHEN 2 THEN 'लौह-अयस्क' WHEN 3 THEN 'खुली  खदान' WHEN 4 THEN 'భూగర్భ' WHEN 5 THEN 'चूना पत्थर.' WHEN 6 THEN 'చలువరాయి' END AS stated,
  CASE b.id % 8 WHEN 0 THEN 'coal' WHEN 1 THEN 'coal' WHEN 2 THEN 'iron ore' WHEN 3 THEN 'opencast' WHEN 4 THEN 'underground' WHEN 5 THEN 'limestone' END AS term,
  concat(CASE WHEN b.id % 2 = 0 THEN 'coal कोयला ' ELSE 'Report ' END, CASE WHEN b.id % 3 = 0 THEN 'బొగ్గు గని ' ELSE '' END, CASE WHEN b.id % 5 = 0 THEN 'தமிழ் ' ELSE '' END, CASE WHEN b.id % 7 = 0 THEN 'বাংলা ગુજરાતી ' ELSE '' END,
    CASE WHEN b.id % 11 = 0 THEN 'ଓଡ଼ିଆ' ELSE '' END) AS body,
  concat('The ', CASE b.id % 7 WHEN 0 THEN 'Lignite and coal' WHEN 1 THEN 'iron' WHEN 2 THEN 'BAUXITE' WHEN 3 THEN 'copper, gold' WHEN 4 THEN 'Gold' WHEN 5 THEN 'coal' ELSE 'stone' END, ' of ',
    CASE b.id % 6 WHEN 0 THEN 'Jharkhand and Bihar' WHEN 1 THEN 'ODISHA' WHEN 2 THEN 'madhya pradesh' WHEN 3 THEN 'Telangana' WHEN 4 THEN 'Bihar' ELSE 'the plain' END, ' is worked ',
    CASE b.id % 5 WHEN 0 THEN 'under ground' WHEN 1 THEN 'Underground, formerly opencast' WHEN 2 THEN 'by Open Cast' WHEN 3 THEN 'OPENCAST' ELSE 'by hand' END) AS told
FROM (SELECT o_orderkey AS id, 45000 + 3500 * (o_orderkey % 3) AS figure, cast(45000 + 3500 * (o_orderkey % 3) AS varchar(20)) AS latin,
  concat(translate(substring(cast(45000 + 3500 * (o_orderkey % 3) AS varchar(20)), 1, 2), '0123456789', '०१२३४५६७८९'), ',', translate(substring(cast(45000 + 3500 * (o_orderkey % 3) AS varchar(20)), 3, 3), '0123456789', '०१२३४५६७८९')) AS deva,
  translate(cast(45000 + 3500 * (o_orderkey % 3) AS varchar(20)), '0123456789', '౦౧౨౩౪౫౬౭౮౯') AS telu FROM {orders}) b
"""

DECISIONS = """
SELECT concat('missing:mineral_type:', cast(o_orderkey AS varchar(20))) AS finding_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'flagged' WHEN 2 THEN 'pending' ELSE 'dismissed' END AS status,
  concat('note ', cast(v AS varchar(2))) AS note, concat('auditor', cast((o_orderkey + v) % 5 AS varchar(2))) AS resolved_by, v AS step
FROM (SELECT o_orderkey, 1 AS v FROM {orders} UNION ALL SELECT o_orderkey, 2 AS v FROM {orders}) s WHERE o_orderkey % 3 < v
"""

PAGES = """
SELECT d.doc_id AS report_id, d.source AS organisation, concat(d.source, '_', cast(d.doc_id AS varchar(20)), '.pdf') AS filename,
  cast(p.k + 1 AS int) AS page, substring(d.text, cast(p.k * 2000 + 1 AS int), 2000) AS text
FROM {documents} d JOIN (SELECT a.k * 8 + b.k AS k FROM
  (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) a
  CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) b
) p ON p.k * 2000 < length(d.text)
"""

HISTORY = """
SELECT u.conv_id * 100 + u.turn AS id, u.conv_id, u.text AS question, a.text AS answer, u.conv_id % 97 AS r1, (u.conv_id * 7) % 997 AS r2, u.turn AS turn
FROM {conversations} u JOIN {conversations} a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'
"""

REPLIES = """
SELECT o_orderkey AS id, CASE o_orderkey % 6
  WHEN 0 THEN concat('{{"mine_name": "Block ', cast(o_custkey AS varchar(20)), '", "location": null}}')
  WHEN 1 THEN concat('```json\n{{"mine_name": "Block ', cast(o_custkey AS varchar(20)), '", "state": "x"}}\n```')
  WHEN 2 THEN concat('<think>set {{a}}</think>Here it is: {{"mine_name": "Block ', cast(o_custkey AS varchar(20)), '"}} and that is all')
  WHEN 3 THEN concat('{{"mine_name": "Block ', cast(o_custkey AS varchar(20)))
  WHEN 4 THEN 'No JSON today'
  ELSE concat('First {{"a": 1}} then {{"mine_name": "brace }} in ', cast(o_custkey AS varchar(20)), '", "location": "y"}}') END AS reply,
  CASE o_orderkey % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN concat('brace }} in ', cast(o_custkey AS varchar(20)))
    ELSE concat('Block ', cast(o_custkey AS varchar(20))) END AS want_mine
FROM {orders}
"""


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    sql = sql.replace("varchar(", "varchar(")
    for width in ("20", "4", "3", "2", "1"):
        sql = sql.replace(f"varchar({width})", "string")
    return spark.sql(sql.format_map({t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def duck(sql: str) -> str:
    """The same SQL on DuckDB, where tables are views of their names."""
    return sql.format_map({t: t for t in TABLES})


def flat_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, REPORTS)


def to_reports(flat: DataFrame) -> DataFrame:
    """The engine's reports table out of the flat fixture."""
    have = {"reserve_estimate": "x_reserve_estimate", "mineral_type": "x_mineral_type", "quantity_extracted": "x_quantity_extracted",
            "district": "x_district"}
    lists = {"key_findings": F.split("findings_text", r"\|")}
    fields = [(F.col(have[f]) if f in have else F.lit(None).cast("string")).alias(f) for f in EXTRACTED_TEXT]
    fields += [(lists[f] if f in lists else F.lit(None).cast("array<string>")).alias(f) for f in EXTRACTED_LISTS]
    return flat.select("id", "filename", "upload_date", F.concat_ws("\n", "page1", "page2").alias("raw_text"), "report_date", "location",
                       "mineral_type", "quantity_extracted", "extraction_method", "company_name", "mine_name", "summary", "status",
                       "error_message", F.split("topics_text", r"\|").alias("topics"), F.array("page1", "page2").alias("page_texts"),
                       F.struct(*fields).alias("extracted_data"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_reports(flat_reports(spark, sf_dir))


def long_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, page, text of LONG_PAGES."""
    return (spark_sql(spark, sf_dir, LONG_PAGES).select(F.col("id").alias("report_id"), F.posexplode(F.array("page1", "page2")).alias("pos", "text"))
            .select("report_id", (F.col("pos") + 1).alias("page"), "text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, organisation, filename, page, text over documents; pages of 2,000 characters, 64 at most in SQL form,
    all of them here."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.ceil(F.length("text") / 2000).cast("int")
    return (docs.where(F.length("text") > 0)
            .select(F.col("doc_id").alias("report_id"), F.col("source").alias("organisation"),
                    F.concat("source", F.lit("_"), "doc_id", F.lit(".pdf")).alias("filename"), "text",
                    F.posexplode(F.sequence(F.lit(1), n)).alias("k", "page"))
            .select("report_id", "organisation", "filename", "page", F.substring("text", F.col("k") * 2000 + 1, F.lit(2000)).alias("text")))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (spark_sql(spark, sf_dir, DECISIONS)
            .withColumn("resolved_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("step") * 3600)))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (spark_sql(spark, sf_dir, HISTORY)
            .select("id", "question", "answer", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("created_at"),
                    F.array("r1", "r2").alias("report_ids_used")))


def questions(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    """qid, embedding: vectors whose id is divisible by `every`, as questions over the embeddings table."""
    return (spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") % every == 0)
            .select(F.col("vec_id").alias("qid"), "embedding"))


def vector_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with the embeddings table's vectors; copies of content by modulus."""
    return (spark.read.parquet(f"{sf_dir}/embeddings.parquet")
            .select(F.col("vec_id").alias("report_id"), F.col("label").cast("string").alias("organisation"),
                    F.concat(F.lit("file"), "vec_id").alias("filename"), (F.col("vec_id") % 7).cast("int").alias("page"),
                    (F.col("vec_id") % 3).cast("int").alias("chunk_index"), F.concat(F.lit("Text of "), (F.col("vec_id") % 90).cast("string")).alias("content"),
                    "embedding"))


assert EXTRACTED_ONLY
