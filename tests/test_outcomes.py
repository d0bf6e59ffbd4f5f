"""Results that a registered query could leave out and still agree with its SQL."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_scorecard_has_response_times(spark):
    rows = entry.queries()["agent_scorecard"](spark, SMALL).collect()
    assert rows and any(r.avg_first_response_sec is not None for r in rows)


def test_shared_extensions_and_aliases_keep_one_row(spark):
    from parley.operators import identity

    calls = spark.createDataFrame([("1", "7", "out"), ("2", "7", "q"), ("3", None, "out"), ("4", "9", "out")], "id string, agent_extension string, kind string")
    agents = spark.createDataFrame([(5, "7"), (4, "7"), (6, None)], "agent_id long, phone_extension string")
    assert {r.id: r.agent_id for r in identity.agent_by_extension(calls, agents).collect()} == {"1": 4, "2": None, "3": None, "4": None}
    assert identity.agent_by_extension(calls, agents).count() == 4
    legs = spark.createDataFrame([("a", "PARIS "), ("b", "Rome"), ("c", None)], "leg string, raw_name string")
    aliases = spark.createDataFrame([("paris", 2), ("Paris", 1), (None, 3)], "alias string, destination_id long")
    found = identity.alias_lookup(legs, aliases).collect()
    assert sorted((r.leg, r.destination_id) for r in found if r.leg != "c") == [("a", 1), ("b", None)] and len(found) == 3
