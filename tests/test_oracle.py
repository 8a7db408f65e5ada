"""A sample of the queries next to their SQL twins; tools/compare.py runs all."""

import pytest

from nomenlink.checks import ORACLES, QUERIES
from tools.compare import compare

SAMPLE = [
    "coverage",
    "diagnostics_report",
    "order_priority",
    "enrich_offers",
    "silver_positives",
    "silver_positives_city_zipcode",
    "hard_negatives",
    "random_negatives",
    "ambiguity_report",
    "ambiguous_names",
    "rank_candidates",
    "candidate_blocking",
    "best_match",
    "consortium_resolve",
    "provider_chain",
    "cache_lookup",
    "resolve_offers",
    "classification_report",
    "roc_auc",
    "parse_address",
    "split_consortium",
    "flatten_establishment",
    "prepare_register",
    "scan_offers",
    "row_id",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin(spark, sf, name):
    good, note = compare(spark, sf, name)
    assert good, note


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["report", "item", "measure", "value"]
