"""The registry is whole, and a few queries run on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import norm

SMALL = "/root/testdata/sf0.001"


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


# quick ones of each family; tools/check.py compares all of them
NAMES = [
    "rebuild_customer_metrics", "chat_metrics", "settled_threads_stream", "windowed_counts", "promise_timer",
    "job_state_fold", "job_states_stream", "followup_module", "close_promises", "stage_transitions",
    "unmerged_customers", "scan_since", "resolve_deal", "contract_violations", "load_scored_transcript",
]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(norm(v) for _, v in sorted(zip(names, r, strict=True))) for r in cursor.fetchall()]
    df = entry.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(norm(v) for _, v in sorted(r.asDict().items())) for r in df.collect()]
    assert sorted(got) == sorted(want) and got
