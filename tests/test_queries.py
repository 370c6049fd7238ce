"""Registered queries against their checking SQL. All of them with PATHLOOM_ALL=1, else a selection."""

import os

import pytest

from pathloom.plans import load_queries
from pathloom.plans.check import difference, duck

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = load_queries()
SELECTED = [
    "operator_summary", "kpi_stats", "session_features", "cart_state", "resolve_intents", "rage_clicks", "semantic_sequences",
    "sequence_audit", "build_vocab", "encode_sequences_left", "external_sequences_by_url", "labelled_sessions", "undersample",
    "assign_nearest", "classify_vectors", "silhouette", "davies_bouldin", "auc_metrics", "classify_sessions", "exit_hotspots_all",
    "cluster_profiles", "merge_profiles", "unique_labels", "profile_stability", "funnel_by_type", "clean_urls", "attribution",
    "json_batches_source", "snapshot_modes", "ordered_collection", "density_clusters", "refresh_moved", "site_report", "quality_summary", "stream_sessions",
    "live_behaviour", "live_exit_records", "intent_outcomes", "late_sessions", "follow_events",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(CHECKS) if os.environ.get("PATHLOOM_ALL") else SELECTED)
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, CHECKS[name]) is None


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name, length, limit", [
    ("external_sequences", "length", 11), ("external_sequences_by_url", "length", 8), ("merge_sequences", "length", 11),
    ("encode_sequences", "used_length", 16), ("encode_sequences_left", "used_length", 16),
])
def test_whole_sequences(spark, con, name, length, limit):
    """Long sequences are there, with more tokens than a first page of them."""
    found = QUERIES[name](spark, SF).cache()
    assert difference(found, con, CHECKS[name]) is None
    assert found.agg({length: "max"}).first()[0] > limit
