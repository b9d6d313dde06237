"""Driver contract: entry runs, every query has a callable, oracle keys are
a subset of the queries, and a sample of queries equals its DuckDB oracle."""
import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_check import compare, duck


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["message_id", "query_type", "drafted_reply", "confidence_score", "action"]
    assert df.count() == 891


def test_registry_shape():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 90


@pytest.mark.parametrize("name", ["process_messages", "error_details", "unify_guests", "overdue_escalations",
                                  "complaint_trends", "rolling_complaints", "maintenance_tickets",
                                  "conversation_history", "check_foreign_keys", "processing_latency"])
def test_oracle_sample(spark, name):
    con = duck(SF001)
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF001)
    assert r["ok"], r
