"""A part of the registered queries next to their SQL; `compare.py` runs all of them."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ("attr_characters", "asset_name_parse", "metadata_trim", "net_asset_delta", "current_owner", "net_block_effect", "facet_audit",
          "search_conjunctive", "search_slot_page", "owners_with_defaults", "holder_ranking", "reverse_lookup_key", "listings_price",
          "attribute_diff", "ownership_audit", "coverage_cursor", "repair_precheck", "set_fingerprint", "snapshot_cutoff", "blocks_to_state", "canonical_key_dedup")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_its_sql(spark, con, key):
    assert difference(entry.queries()[key](spark, SF_DIR), con, entry.oracle_sql()[key]) is None


def test_every_query_but_the_random_page_has_sql():
    own = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert own - set(entry.oracle_sql()) == {"search_random"}


def test_flagship(spark):
    assert entry.entry(spark).count() == 168


@pytest.mark.parametrize("key", ["repair_records_whole", "facet_index_whole", "facet_audit_whole"])
def test_whole_inputs_equal_their_sql(spark, con, key):
    assert difference(entry.queries()[key](spark, SF_DIR), con, entry.oracle_sql()[key]) is None


def test_the_sql_without_double_mints_differs_from_that_with_them():
    from namefold.plans import audit_queries, ledger_queries

    assert "f.amount + 1" in ledger_queries.FOLD_ORACLE and "f.amount + 1" not in audit_queries._NO_DOUBLE_MINTS
