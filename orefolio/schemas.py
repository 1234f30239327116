"""Explicit schemas of the engine's tables. Nothing is inferred."""

# Names of the fields that are read from a report.
EXTRACTED_TEXT = ["report_date", "location", "district", "state", "mineral_type", "quantity_extracted", "extraction_method",
                  "company_name", "mine_name", "area_sq_km", "reserve_estimate", "summary", "financial_data", "environmental_notes"]
EXTRACTED_LISTS = ["key_findings", "topics", "minerals_mentioned", "locations_mentioned"]
EXTRACTED_FIELDS = EXTRACTED_TEXT + EXTRACTED_LISTS

EXTRACTED = ("STRUCT<" + ", ".join([f"{f}: STRING" for f in EXTRACTED_TEXT] + [f"{f}: ARRAY<STRING>" for f in EXTRACTED_LISTS]) + ">")

REPORTS = f"""id BIGINT, filename STRING, upload_date TIMESTAMP, raw_text STRING, report_date STRING, location STRING,
mineral_type STRING, quantity_extracted STRING, extraction_method STRING, company_name STRING, mine_name STRING, summary STRING,
status STRING, error_message STRING, topics ARRAY<STRING>, page_texts ARRAY<STRING>, extracted_data {EXTRACTED}"""

REPORT_PAGES = "report_id BIGINT, page INT, text STRING"
PASSAGES = ("report_id BIGINT, organisation STRING, filename STRING, page INT, chunk_index INT, content STRING, "
            "embedding ARRAY<FLOAT>")
INDEX_META = "model STRING, dimension INT"
HISTORY = "id BIGINT, question STRING, answer STRING, created_at TIMESTAMP, report_ids_used ARRAY<BIGINT>"
DECISIONS = "finding_id STRING, status STRING, note STRING, resolved_by STRING, resolved_at TIMESTAMP"
LABELS = """document STRING, language STRING, corpus STRING, status STRING, labelled_by STRING, note STRING,
source STRUCT<title: STRING, publisher: STRING, url: STRING, retrieved: STRING, sha256: STRING, pages: INT>,
expected MAP<STRING, STRING>, evidence MAP<STRING, STRUCT<page: INT, quote: STRING>>"""
CALLS = "key STRING, ts TIMESTAMP"
SOURCE = "STRUCT<document_id: BIGINT, document_name: STRING, value: STRING>"

# Fields in which reports of one mine are compared: field, label, severity, whether the period matters.
COMPARABLE = [("quantity_extracted", "Quantity extracted", "high", True), ("reserve_estimate", "Reserve estimate", "high", True),
              ("extraction_method", "Extraction method", "medium", False), ("mineral_type", "Mineral type", "medium", False)]
# Fields a report must state, and fields looked for in its pages, with their labels.
REQUIRED = [("mineral_type", "Mineral type"), ("quantity_extracted", "Quantity extracted"), ("location", "Location")]
DEPENDED_ON = sorted({f for f, _ in REQUIRED} | {f for f, *_ in COMPARABLE})
CITABLE = [("quantity_extracted", "Quantity extracted"), ("reserve_estimate", "Reserve estimate"), ("mineral_type", "Mineral type"),
           ("extraction_method", "Extraction method"), ("mine_name", "Mine name"), ("location", "Location")]
#: Fields that exist only in the extracted data.
EXTRACTED_ONLY = {"reserve_estimate", "district", "state"}
