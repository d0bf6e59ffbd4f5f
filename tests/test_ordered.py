"""Hot-key results must equal the plain windows at any threshold."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parley import ordered
from parley.operators import conversations as co
from parley.operators import hygiene as hy
from parley.operators import promises as pr


@pytest.fixture(scope="module")
def line(spark):
    rnd = random.Random(7)
    rows = [
        (
            rnd.choice(["hot", "hot", None, f"k{rnd.randint(0, 30)}", f"k{rnd.randint(0, 30)}"]),
            rnd.choice([None, *[rnd.randint(0, 5000)] * 5]), i, rnd.choice([None, i]),
        )
        for i in range(1500)
    ]
    return spark.createDataFrame(rows, "k string, at long, id long, v long")


@pytest.mark.parametrize("hot_rows", [1, 40, 10**6])
def test_primitives_equal_plain_windows(line, hot_rows):
    keys, order = ["k"], ["at", "id"]
    df = ordered.with_slots(line, keys, F.col("at"), 60, hot_rows)
    df = ordered.nearest(df, keys, order, F.col("v"), "back")
    df = ordered.nearest(df, keys, order, F.col("v"), "ahead", ahead=True)
    df = ordered.numbered(df, keys, order, "rank", total="n")
    w = Window.partitionBy("k").orderBy("at", "id")
    df = (
        df.withColumn("back2", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("ahead2", F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
        .withColumn("rank2", F.row_number().over(w))
        .withColumn("n2", F.count("*").over(Window.partitionBy("k")))
    )
    assert ordered.bare(df).columns == [*line.columns, "back", "ahead", "rank", "n", "back2", "ahead2", "rank2", "n2"]
    wrong = df.where("NOT (back <=> back2) OR NOT (ahead <=> ahead2) OR rank <> rank2 OR n <> n2")
    assert df.count() == 1500 and wrong.count() == 0


def test_few_keys_count_as_hot(line):
    hot = [r.k for r in ordered.hot_keys(line, ["k"], 200).collect()]
    assert set(hot) == {None, "hot"}


def _loop_gaps(rows):
    gaps, pending = [], None
    for _, sender, at in rows:
        if sender == "customer":
            pending = at if pending is None else pending
        elif sender == "agent" and pending is not None:
            gaps.append(at - pending)
            pending = None
    return gaps


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_response_gaps_equal_a_loop(spark, hot_rows):
    rnd = random.Random(3)
    threads, rows = {}, []
    for t in range(40):
        at = 0
        for i in range(rnd.randint(0, 40)):
            at += rnd.randint(0, 200)
            row = (i, rnd.choice(["customer", "agent", "bot", "system"]), at)
            threads.setdefault(f"t{t}", []).append(row)
            rows.append((f"t{t}", *row))
    df = spark.createDataFrame(rows, "interaction_id string, message_id long, sender string, s long").withColumn(
        "sent_at", F.timestamp_seconds("s")
    )
    gaps = co.response_gaps(df, hot_rows)
    got = {}
    for r in gaps.orderBy("interaction_id", "turn").collect():
        got.setdefault(r.interaction_id, []).append(int(r.gap_seconds))
    assert got == {t: g for t, g in ((t, _loop_gaps(r)) for t, r in threads.items()) if g}
    for r in co.response_metrics(gaps, hot_rows).collect():
        g = sorted(got[r.interaction_id])
        mid = (g[(len(g) - 1) // 2] + g[len(g) // 2]) / 2
        assert (r.first_response_seconds, r.median_response_seconds, r.max_response_gap_seconds) == (
            got[r.interaction_id][0], int(mid), g[-1])


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_longest_span_and_token_run_over_hot_calls(spark, hot_rows):
    flags = [0, 1, 1, 0, 1, 1, 1, 0, 1]
    chunks = spark.createDataFrame([("c", i, 10.0, bool(f)) for i, f in enumerate(flags)], "call_id string, seq int, seconds double, bad boolean")
    assert hy.longest_invalid_spans(chunks, ["bad"], hot_rows).first().longest_bad == 30.0
    texts = ["a b b", "b b", "b c b b b b", None, "", "b x", "y"]
    seg = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "call_id string, seq int, text string")
    assert hy.max_token_run(seg, hot_rows).first().max_token_run == 5
    assert hy.max_token_run(seg.where("seq < 3"), hot_rows).first().max_token_run == 5


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_promises_and_followups(spark, hot_rows):
    ts = lambda h: F.timestamp_seconds(F.lit(h * 3600))
    contacts = spark.createDataFrame(
        [("i1", 1, 1, 10, "+1"), ("i2", 1, 1, 20, "+1"), ("i3", 1, 2, 11, "+1"), ("i4", 2, 1, 90, "+2")],
        "interaction_id string, customer_id long, agent_id long, h long, customer_phone_e164 string",
    ).withColumn("started_at", F.timestamp_seconds(F.col("h") * 3600))
    promises = spark.createDataFrame(
        [(1, 1, 1, 10, None), (2, 1, 1, 20, None), (3, 2, 1, 0, 50), (4, 2, 1, 80, 200)],
        "follow_up_id long, customer_id long, agent_id long, h long, d long",
    ).select("follow_up_id", "customer_id", "agent_id", F.timestamp_seconds(F.col("h") * 3600).alias("promised_at"),
             F.timestamp_seconds(F.col("d") * 3600).alias("due_at"))
    got = {r.follow_up_id: (r.status, r.fulfilled_in) for r in pr.close_promises(promises, contacts, ts(100), hot_rows=hot_rows).collect()}
    # a contact at the time of the promise does not count
    assert got == {1: ("fulfilled", "i2"), 2: ("missed", None), 3: ("late", "i4"), 4: ("fulfilled", "i4")}
    module = {r.interaction_id: (r.followup_count, r.timing, r.frequency) for r in pr.followup_module(contacts, contacts, ts(400), hot_rows=hot_rows).collect()}
    assert module == {"i1": (2, 40, 30), "i3": (1, 40, 15), "i2": (0, None, None), "i4": (0, None, None)}


def test_merge_chains_of_any_length(spark):
    from parley.operators import rollups as ro

    rows = [(i, i - 1 if i else None) for i in range(12)] + [(20, 21), (21, 20), (30, None)]
    df = spark.createDataFrame(rows, "customer_id long, is_merged_into long")
    got = {r.customer_id: (r.canonical_id, r.resolved) for r in ro.canonical_customers(df).collect()}
    assert all(got[i] == (0, True) for i in range(12)) and got[30] == (30, True)
    assert {got[20][1], got[21][1]} == {False} and {got[20][0], got[21][0]} <= {20, 21}


def test_listing_a_call_again_changes_nothing(spark):
    from parley.operators import calls as ca

    steps = {
        "a": ["discovered", "transcribed", "evaluated", "discovered"],
        "b": ["discovered", "asr_failed"] + ["judge_failed"] * 4 + ["discovered"],
        "c": ["discovered", "gate_red", "discovered"],
        "d": ["discovered"],
        "e": ["discovered", "asr_failed", "discovered"],
    }
    rows = [(k, i, 100 * i, s) for k, l in steps.items() for i, s in enumerate(l)]
    df = spark.createDataFrame(rows, "uniqueid string, event_id long, s long, step string")
    df = df.withColumn("logged_at", F.timestamp_seconds("s")).withColumn("error", F.lit(None).cast("string"))
    got = {r.uniqueid: r.status for r in ca.job_state_fold(df).collect()}
    assert got == {"a": "evaluated", "b": "dead_letter", "c": "dead_letter", "d": "discovered", "e": "asr_failed"}


def test_token_runs_walk_each_text_once(spark, monkeypatch):
    texts = ["a", "a a", "a b", "b b c c c d", " x\tx  x ", None, "", " \n", "y y z z z z w w", "e e e"]
    rows = [(f"c{i}", 0, t) for i, t in enumerate(texts)] + [("both", 0, "p q q"), ("both", 1, None), ("both", 2, "q q r r r")]
    stored, keep = [], hy.session.persist
    df = keep(spark.createDataFrame(rows, "call_id string, seq int, text string"), "segments")
    monkeypatch.setattr(hy.session, "persist", lambda d, name: stored.append(d) or keep(d, name))
    got = {r.call_id: r.max_token_run for r in hy.max_token_run(df).collect()}
    assert got == {"c0": 1, "c1": 2, "c2": 1, "c3": 3, "c4": 3, "c8": 4, "c9": 3, "both": 4}
    plan = stored[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
