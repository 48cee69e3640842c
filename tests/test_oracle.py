"""Registered queries against DuckDB; all of them with REELSHELF_FULL=1."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from workload.queries import QUERIES

FOLDER = os.environ.get("REELSHELF_DATA", "/root/testdata/sf0.001")
QUICK = ["file_inventory", "clean_title", "classify_media", "size_units", "fold_audio_lists", "search_fallback",
         "state_lookup", "csv_roundtrip", "stream_ingest", "build_catalog", "ref_details_odd", "enrich_details", "errors_table",
         "row_errors", "state_compaction", "state_table_lookup", "stream_dead_letters", "csv_catalog", "listing_changes",
         "table_readers", "run_stats_written", "incremental_enriched", "quality_kept", "export_changed"]
NAMES = list(QUERIES) if os.environ.get("REELSHELF_FULL") else QUICK


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_duckdb(spark, name):
    assert compare(spark, connect(FOLDER), name, FOLDER) is None
