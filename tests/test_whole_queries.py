"""Queries over all rows of their operators, on Spark and DuckDB."""

import pytest

from orefolio.plans import fixtures, registry

WHOLE = [
    "n23_n24_variants_all", "j10_wanted_variants", "n24_figures_in_text", "n_indic_numbers", "n16_n17_scripts", "n26_rules_in_text",
    "w2_order_all_findings", "s18_quarantine_both", "f8_run_gate_all", "p6_explore_by_production", "s1_read_old_reports", "s16_append_history",
    "c4_w5_cosine_search_20", "w4_top_k_per_query_20", "c5_retrieval_context_20", "c7_answer_inputs_20", "c7_answer_contexts",
    "n25_words_all", "s3_clean_text", "e1_locate_evidence", "e1_evidence_in_long_pages", "s10_get_report_evidence",
    "t1_rate_audit", "t1_rate_audit_stream", "t2_ingest_stream", "t3_passage_stream", "t4_decision_stream", "s12_write_passages",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", WHOLE)
def test_rows_equal_sql(spark, sf_dir, duck, name):
    found = registry.QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    got = [tuple(r) for r in found.select(names).collect()]
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLES[name]})").fetchall()
    assert len(want) > 0 and sorted(map(repr, got)) == sorted(map(repr, want))
