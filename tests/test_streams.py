"""Streams over several micro-batches, their state, and the keyed table they write."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from parley.operators import calls
from parley.operators import promises as pr
from parley.sources.table import Conflict, KeyedTable
from parley.streaming import jobs, keyed

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(hours: float) -> dt.datetime:
    return DAY + dt.timedelta(hours=hours)


def feed(spark, folder, schema, *batches):
    """A stream with one micro-batch for each list of rows."""
    for i, rows in enumerate(batches):
        path = f"{folder}/in/{i:03d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            # files are taken in order of their times
            os.utime(f"{path}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/in")


MESSAGES = "interaction_id string, sender string, sent_at timestamp, body_hash string"


def test_late_rows_are_caught_up(spark, tmp_path):
    old = [("a", "customer", at(0), "x"), ("b", "agent", at(1), "y")]
    new = [("a", "customer", at(100), "x"), ("b", "agent", at(1), "y")]  # b comes again, in time for nobody
    late = [("a", "customer", at(0), "x"), ("c", "agent", at(2), "z"), ("c", "agent", at(2), "z"), ("d", "bot", at(99.5), "w")]
    more, end = [("e", "agent", at(100.2), "v")], [(None, None, at(1000), None)]
    arrivals = feed(spark, tmp_path, MESSAGES, old, new, more, late, end, end)
    spec, out = jobs.deduplicated("1 hour"), f"{tmp_path}/out"
    got = jobs.run_to_table(spec, arrivals, out).collect()
    want = set(old + new + more + late)
    assert sorted(map(tuple, got)) == sorted((i, s, t.replace(tzinfo=None), h) for i, s, t, h in want)
    # the stream itself has lost c, and only what came too late was looked at again
    streamed = {r.interaction_id for r in spec.streamed(spark, out, arrivals.schema).collect()}
    assert streamed == {"a", "b", "d", "e"}
    assert {r.interaction_id for r in spec.late_keys(spark, out, arrivals.schema).collect()} == {"a", "c"}
    # a micro-batch that is run again counts once
    both = spark.read.parquet(f"{out}/both").where("batch = 3").drop("batch")
    spec._land(spark.createDataFrame(both.collect(), both.schema), 3, out)
    assert sorted(map(tuple, spec.table(spark, out, arrivals.schema).collect())) == sorted(map(tuple, got))


def test_late_messages_join_settled_sessions(spark, tmp_path):
    schema = "interaction_id string, sent_at timestamp"
    first, second = [("a", at(0)), ("a", at(1)), ("b", at(0))], [("a", at(50)), ("c", at(200))]
    late, end = [("a", at(1.9)), ("b", at(30)), ("c", at(199.5))], [(None, at(5000))]
    arrivals = feed(spark, tmp_path, schema, first, second, late, end, end)
    got = jobs.run_to_table(jobs.settled_threads("1 hour", "1 hour"), arrivals, f"{tmp_path}/out").collect()
    # the last two messages of a are 0.9 hours apart, so they are one session
    want = [("a", 0, 2.9, 3), ("a", 50, 51, 1), ("b", 0, 1, 1), ("b", 30, 31, 1), ("c", 199.5, 201, 2)]
    assert sorted(map(tuple, got)) == [(i, at(s).replace(tzinfo=None), at(e).replace(tzinfo=None), n) for i, s, e, n in want]


ARRIVALS = "external_ref string, raw_id long, received_at timestamp"


def state_rows(query) -> list[int]:
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]


def test_debounce_rebuilds_threads_and_forgets_them(spark, tmp_path):
    minute = 1 / 60
    b1 = [("a", 1, at(0)), ("a", 2, at(0.5 * minute)), ("b", 3, at(0))]
    b2 = [("a", 4, at(1.2 * minute)), ("c", 5, at(30 * minute))]  # puts a off
    b3 = [("a", 7, at(40 * minute)), ("a", 6, at(39.5 * minute)), ("c", 8, at(29.5 * minute))]  # out of order
    end = [(None, None, at(100))]
    arrivals = feed(spark, tmp_path, ARRIVALS, b1, b2, b3, end, end)
    raw = spark.createDataFrame([(r, i, t, "customer", f"m{i}", "t") for r, i, t in b1 + b2 + b3], ARRIVALS + ", sender string, message string, timestamp string")
    got = jobs.thread_debounce(arrivals, f"{tmp_path}/out", "1 minute", "5 minutes", lambda s: raw).collect()
    told = {(r.external_ref, r.last_id): [x["message"] for x in json.loads(r.history)] for r in got}
    assert told == {("a", 4): ["m1", "m2", "m4"], ("a", 7): ["m1", "m2", "m4", "m6", "m7"], ("b", 3): ["m3"], ("c", 5): ["m5", "m8"]}
    assert {(r.external_ref, r.last_id): r.settled_at for r in got}["a", 4] == at(2.2 * minute).replace(tzinfo=None)
    # all has fired, so nothing is held
    query = keyed.settled_arrivals(arrivals, "1 minute", "5 minutes").writeStream.outputMode("append").foreachBatch(lambda rows, n: rows.count())
    query = query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    held = state_rows(query)
    assert held[0] > 0 and held[-1] == 0


def test_promise_timer_equals_the_batch_rule(spark, tmp_path):
    line = "customer_id long, agent_id long, at timestamp, follow_up_id long, due_at timestamp, contact_id string"
    promise = lambda c, h, i, due=None: (c, 7, at(h), i, None if due is None else at(due), None)
    contact = lambda c, h, i: (c, 7, at(h), None, None, i)
    batches = [
        [promise(1, 0, 1), promise(2, 0, 2), promise(3, 0, 3, 300), promise(4, 5, 4), contact(4, 5, "same time"), promise(6, 0, 6)],
        [contact(1, 10, "k"), contact(1, 11, "k2"), contact(2, 30, "late"), promise(5, 12, 5), contact(9, 20, "nobody")],
        [contact(9, 150, "nobody")],
        [contact(3, 290, "due"), contact(6, 400, "after it was missed"), promise(6, 401, 7)],
        [(None, None, at(2000), None, None, None)], [(None, None, at(2001), None, None, None)],
    ]
    table = jobs.promise_outcomes(feed(spark, tmp_path, line, *batches), f"{tmp_path}/out", lateness="1 hour")
    rows = spark.createDataFrame([r for b in batches for r in b if r[0]], line)
    promises = rows.where("follow_up_id IS NOT NULL").withColumnRenamed("at", "promised_at")
    contacts = rows.where("contact_id IS NOT NULL").select("customer_id", "agent_id", F.col("at").alias("started_at"), F.col("contact_id").alias("interaction_id"))
    want = pr.close_promises(promises, contacts, F.lit("2024-03-20").cast("timestamp")).select("follow_up_id", "status", "fulfilled_at", "fulfilled_in")
    got = table.read().select("follow_up_id", "status", "fulfilled_at", "fulfilled_in")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.follow_up_id: r.status for r in got.collect()} == {1: "fulfilled", 2: "late", 3: "fulfilled", 4: "missed", 5: "missed", 6: "late", 7: "missed"}
    # missed first, late by a later commit
    history = [{r.follow_up_id: r.status for r in table.read(v).collect()}.get(6) for v in range(1, table.version + 1)]
    assert history.index("missed") < history.index("late")


EVENTS = "uniqueid string, event_id long, logged_at timestamp, step string, error string"


def test_call_states_hold_open_calls_only(spark, tmp_path):
    batches = [
        [("a", 1, at(0), "discovered", None), ("b", 2, at(0), "discovered", None), ("c", 3, at(0), "asr_failed", "x")],
        [("a", 4, at(1), "transcribed", None), ("a", 5, at(2), "evaluated", None), ("c", 6, at(2), "gate_red", None)],
        [("d", 7, at(100), "judge_failed", "e1"), ("d", 8, at(99), "judge_failed", "e0")],
        [("a", 9, at(200), "discovered", None), ("d", 10, at(200), "transcribed", None)],
        [(None, None, at(201), None, None)],
    ]
    events = feed(spark, tmp_path, EVENTS, *batches)
    table = jobs.call_queue(events, f"{tmp_path}/out", lateness="1 hour", keep="10 hours")
    got = {r.uniqueid: (r.status, r.retries, r.last_error) for r in table.read().collect()}
    folded = calls.job_state_fold(spark.createDataFrame([r for b in batches for r in b if r[0]], EVENTS))
    assert got == {r.uniqueid: (r.status, r.retries, r.last_error) for r in folded.collect()}
    assert (got["a"][0], got["c"][0], got["d"][1:]) == ("evaluated", "dead_letter", (2, "e1"))
    # each commit rewrites the buckets of the calls it names
    folders = [table._manifest(v)["folders"] for v in range(1, table.version + 1)]
    changed = [{b for b in after if after[b] != before.get(b)} for before, after in zip([{}, *folders], folders)]
    assert all(len(c) <= 3 for c in changed) and len(changed[0]) > 0
    query = keyed.call_states(events, keep="10 hours", lateness="1 hour").writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.count())
    query = query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    values = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress]
    assert values and len({r for r in got}) == 4
    held = state_rows(query)
    # a and c were forgotten once they were over
    assert held[-1] < max(held)


SCHEMA = "k long, v string, w int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_commits_rewrite_touched_buckets_once(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=32)
    assert table.read().collect() == [] and table.version == 0
    assert table.rebuild(spark.range(1000).selectExpr("id AS k", "'old' AS v", "0 AS w"), "load", 1)
    before = table._manifest()["folders"]
    assert table.upsert(rows(spark, (5, "new", 1), (2000, "added", 2)), "job", 7, update=["v"])
    after = table._manifest()["folders"]
    assert len(before) == 32 and sum(before[b] != after[b] for b in before) <= 2
    kept = {r.k: (r.v, r.w) for r in table.read().collect()}
    assert kept[5] == ("new", 0) and kept[2000] == ("added", 2) and kept[6] == ("old", 0) and len(kept) == 1001
    # the same commit again, and an older one, change nothing
    assert not table.upsert(rows(spark, (5, "again", 1)), "job", 7) and not table.upsert(rows(spark, (5, "again", 1)), "job", 3)
    assert table.committed("job") == 7 and table.committed("nobody") is None
    # an older version can still be read
    assert {r.k: r.v for r in table.read(1).collect()}[5] == "old"
    assert table.insert_ignore(rows(spark, (5, "x", 9), (3000, "b", 1), (3000, "a", 1)), "job", 8)
    assert {r.k: r.v for r in table.read().where("k IN (5, 3000)").collect()} == {5: "new", 3000: "a"}
    assert table.upsert(rows(spark, (6, "no", 1), (7, "yes", 1)), "job", 9, when=F.col("old.k") == 7)
    assert {r.k: r.v for r in table.read().where("k IN (6, 7)").collect()} == {6: "old", 7: "yes"}
    assert table.drop_unused(keep=1) >= 1 and table.read().count() == 1002


def test_a_killed_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=4)
    table.upsert(rows(spark, (1, "a", 1)), "job", 1)
    snapshot = table.read()
    publish = KeyedTable._publish

    def killed(self, manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(KeyedTable, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(rows(spark, (1, "b", 2)), "job", 2)
    assert [tuple(r) for r in table.read().collect()] == [(1, "a", 1)] and table.committed("job") == 1
    monkeypatch.setattr(KeyedTable, "_publish", publish)
    assert table.upsert(rows(spark, (1, "b", 2)), "job", 2)
    assert [tuple(r) for r in table.read().collect()] == [(1, "b", 2)]
    # a reader keeps the version it opened
    assert [tuple(r) for r in snapshot.collect()] == [(1, "a", 1)]


def test_two_writers_and_bad_keys(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=4)
    table.upsert(rows(spark, (1, "a", 1)), "one", 1)
    stale = table._manifest()
    table.upsert(rows(spark, (2, "b", 1)), "two", 1)
    with pytest.raises(Conflict):
        table._publish({**stale, "version": stale["version"] + 1})
    with pytest.raises(Exception, match="key column is null"):
        table.upsert(rows(spark, (None, "c", 1)), "one", 2)
    assert table.upsert(table.read().limit(0), "one", 3)
    assert sorted(r.k for r in table.read().collect()) == [1, 2]


def test_a_key_settles_in_one_call_with_its_rows():
    """State, rows and timer of a key meet in one call; numbers beyond a double's reach stay exact."""
    number, day = 2**53 + 1, 86_400_000_000
    step = keyed._Promises(day, 2 * day, None)
    held, timer, given = step(7, None, [("1", "1000", str(number), None, None), ("1", "5000", None, None, "c")], 0)
    assert [(r[0], r[5]) for r in given] == [(number, "open")] and timer == 5 and len(held[0]) == 2
    held, timer, given = step(7, held, [], 5)
    assert held is None and timer is None and given == [(number, 7, 1, 1000, None, "fulfilled", 5000, "c")]
    held, timer, given = step(7, None, [("1", "1000", "3", "2000", None)], 3)
    assert [r[5] for r in given] == ["open", "missed"] and timer is None and held[0][0][4]


def test_keys_of_a_group_share_a_state_and_a_call():
    minute = 60_000_000
    group = keyed._Group(keyed._Debounce(minute))
    held, timer, given = group(None, {"a": [("1", "0")], "b": [("2", str(10 * minute))]}, 0)
    assert given == [] and timer == 60_001
    # a settles by its timer while only b has rows
    held, timer, given = group(held, {"b": [("3", str(10 * minute + 1))]}, 60_001)
    assert given == [("a", 1, 0, minute)] and timer == 660_001
    # a timer that is not due leaves its key alone
    held, timer, given = group(held, {}, 660_000)
    assert given == [] and timer == 660_001
    assert group(held, {}, timer) == (None, None, [("b", 3, 10 * minute + 1, 11 * minute + 1)])


def test_files_of_a_slice_come_in_one_micro_batch(spark, tmp_path):
    from types import SimpleNamespace

    from parley.plans.catalog import streams

    many = spark.range(0, 5000, 1, 12).selectExpr("timestamp_seconds(id * 60) AS at", "id AS k")
    arrivals, lateness, groups = streams._feed(SimpleNamespace(spark=spark), many, "at", "many-files", "k % 53 = 0")
    seen = []
    query = arrivals.writeStream.foreachBatch(lambda rows, n: seen.append(rows.where("k IS NOT NULL").count()))
    query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == 5000 and len(seen) <= streams.SLICES + 3 and sum(n > 0 for n in seen) == streams.SLICES + 1
