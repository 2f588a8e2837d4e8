"""Registered queries against their SQL on the smallest tables, and the entry point.

By default one query per group runs; PACTSPARK_ALL_QUERIES=1 runs every one, as does
``python tests/oracle.py <table folder>``.
"""

import os

import pytest

from oracle import compare, duck
from pactspark.plans import registry

registry.load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


SOME = (
    "text_normalised", "numerals_read", "sections_cut", "sections_from_pages", "boxes_of_lines", "metadata_extracted",
    "quotes_without_space", "passages_located", "clauses_anchored", "rules_all", "rule_table_audit", "verdicts_replayed",
    "judges_merged", "risks_in_order", "contract_list", "risks_nested", "check_orphan_anchors", "check_suite",
    "task_transitions", "upsert_planned", "comments_added", "writeback_sent", "comments_built", "expected_matched",
    "new_by_content", "stream_deduplicated", "stream_call_volume",
)
NAMES = sorted(registry.QUERIES) if os.environ.get("PACTSPARK_ALL_QUERIES") else SOME


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, _, _, _, note = compare(spark, con, name, SF)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_expectations_read_the_lines_once(spark):
    """The grouped lines are written, and all branches of the matching read what was written."""
    plan = registry.QUERIES["expected_placed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "judged-lines" in plan
