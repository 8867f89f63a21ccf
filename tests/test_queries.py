"""Every registered query against its SQL twin on the smallest supplied tables.

`ALL_QUERIES=1` runs them all; by default one query per operator family runs."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
#: At the smallest size these would only see samples below the minimum.
LARGER = {"drift_psi", "drift_ks", "drift_numeric_run", "chk_unit", "bl_bins"}
FAMILIES = """src_web_jsonl src_payments_jsonl src_batch_stream dedup_keep_first dedup_keep_earliest web_daily_metrics behavior_user_rollup
payments_reconcile payments_sql_feed chk_schema chk_range chk_key_set chk_unit chk_segment_volume drift_psi drift_ks drift_oov drift_template
drift_text_documents chk_contract contract_for_decisions guard_enforce batch_outcome bl_numeric bl_bins bl_sample bl_segment_volume alert_episodes
alert_changes alert_latest alert_lineage alert_stream_events inj_text_change inj_null_half score_scenario score_system score_by_check chk_key_set_values chk_range_text bl_templates drift_numeric_run sink_alerts_upsert sink_baseline_profiles
lineage_downstream lineage_stage_summary lineage_merge_report profile_stage equivalence_diff review_status""".split()
NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else FAMILIES


@pytest.fixture(scope="module")
def con():
    return {f: duck(f) for f in (FOLDER, FOLDER.replace("0.001", "0.01"))}


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    folder = FOLDER.replace("0.001", "0.01") if name in LARGER else FOLDER
    count, diff = compare(spark, con[folder], name, folder)
    assert not diff, diff
    assert count > 0


def test_every_query_has_a_twin():
    from oracles.catalog import ORACLES
    from tidegauge.plans.catalog import QUERIES
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
