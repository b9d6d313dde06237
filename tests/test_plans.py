"""Plan regressions: properties found with explain() that keep the flow fast."""
import os
import re

import __spark_entry__ as E
from conftest import SF001

N_RULE_CONTAINS = 80 + 12 + 8  # class keywords (without the fallback class) + pair terms + ambiguity phrases


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyword_scan_not_copied_into_filters(spark):
    for name in ["process_messages", "overdue_escalations"]:
        plan = optimized(E.queries()[name](spark, SF001))
        assert plan.count("Contains(") <= N_RULE_CONTAINS + 10, name


def test_reports_that_read_the_flow_twice_read_it_stored(spark):
    """One JSON parse per report: in the write of the flow, none in the report's plan."""
    for name in ["complaint_trends", "unaudited_messages", "recurring_complaints", "rolling_complaints", "maintenance_tickets",
                 "pre_arrival_checklist", "check_foreign_keys"]:
        plan = optimized(E.queries()[name](spark, SF001))
        assert "parseJson" not in plan and plan.count("Contains(") < N_RULE_CONTAINS, name  # topics only
    for name in ["sla_alerts", "create_escalations"]:
        assert optimized(E.queries()[name](spark, SF001)).count("parseJson") == 1, name


def test_json_parsed_once(spark):
    plan = optimized(E.queries()["process_messages"](spark, SF001))
    assert plan.count("parseJson") == 1 and "json_tuple(" not in plan and "from_json(" not in plan
    plan = optimized(E.queries()["check_string_types"](spark, SF001))
    assert plan.count("parseJson") == 1


def test_flagship_needs_no_shuffle(spark):
    plan = executed(E.queries()["process_messages"](spark, SF001))
    assert not re.search(r"Exchange (hashpartitioning|rangepartitioning)", plan)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_rolling_sweep_reads_each_input_once_per_branch(spark):
    # the +1/-1 events come from one pass (explode), so the complaint join
    # (messages and audit rows, two scans) appears once in the sweep and once
    # in the per-bucket carry branch: four scans, not eight
    plan = executed(E.queries()["recurring_complaints"](spark, SF001))
    assert plan.count("FileScan parquet") <= 4, plan


def test_stored_flow_is_read_pruned_by_branch_and_column(spark):
    from guestflow.plans.store import store_flow
    from guestflow.sources.sinks import scratch_path
    with store_flow(spark, SF001, scratch_path(spark, "flow-test")) as flow:
        plan = executed(flow.ai_metadata().select("id", "created_at"))
        read = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
        assert [c.split("#")[0] for c in read.split(",")] == ["event_id", "sent_at", "branch"], plan
        assert "PartitionFilters: [isnotnull(branch" in plan or "branch#" in plan.split("PartitionFilters: [")[1].split("]")[0], plan
        assert "ExistingRDD" not in plan


def test_foreign_key_antijoin_stays_above_the_count(spark):
    # pushed below the map-side count, the anti-join would be copied into
    # every child branch with the whole parent-key union (six copies here)
    # (properties come from nation and are only ever a parent)
    plan = executed(E.queries()["check_foreign_keys"](spark, SF001))
    assert 1 <= len(re.findall(r"nation\.parquet", plan)) <= 2, plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
