import json

import pytest
from pyspark.sql import functions as F

from parley.functions import clock, phone
from parley.operators import calls
from parley.sources import payloads, sinks

PHONES = [
    ("0500000000", "SA", "+966500000000"), ("500000000", "SA", "+966500000000"), ("966500000000", "SA", "+966500000000"),
    ("+966 50 000 0000", "SA", "+966500000000"), ("00966500000000", "SA", "+966500000000"),
    ("01012345678", "EG", "+201012345678"), ("00201012345678", "EG", "+201012345678"), ("0500000000", "EG", None),
    (None, "SA", None), ("", "SA", None),
]


def test_phones(spark):
    df = spark.createDataFrame(PHONES, "raw string, region string, want string")
    for r in df.withColumn("p", phone.normalize_phone(F.col("raw"), F.col("region"))).collect():
        assert r.p.e164 == r.want
        assert (r.p.error is not None) == (r.want is None and bool(r.raw))


def _parse(spark, *docs):
    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "n int, payload string")
    return payloads.parse_chats(df).orderBy("n").collect()


def test_both_vocabularies(spark):
    old = {"dialog_id": "chat1", "crm_entity_id": "77", "phone": "0500000000", "deal_info": {"ID": "9", "SOURCE_ID": "54|WHATSAPP"},
           "conversation_history": [{"sender": "client", "message": "hi", "timestamp": "2026-07-19 19:24:59+00:00"},
                                    {"sender": "x", "message": "yo", "timestamp": "2026-07-19T22:25:59+03:00", "is_bot": True}]}
    new = {"conversation_id": "c2", "channel": "telegram", "message_count": 9,
           "messages": [{"sender_role": "Customer", "content": "[]", "timestamp": "2026-07-19T10:00:00Z", "content_type": "text"},
                        {"sender_role": "agent", "content": "", "content_type": "image", "timestamp": None, "deal_id": 5},
                        {"sender_role": "agent", "content": " ok ", "timestamp": "later"}]}
    a, b, c = _parse(spark, {"body": old}, [new], {"nothing": 1})
    assert (a.external_id, a.channel, a.deal_id, a.customer_phone_e164) == ("chat1", "whatsapp", "77", "+966500000000")
    assert [m.sender for m in a.messages] == ["customer", "bot"] and a.is_bot_only and not a.should_evaluate
    assert (a.messages[1].sent_at - a.messages[0].sent_at).total_seconds() == 60
    assert (b.external_id, b.channel, b.deal_id, b.truncated) == ("c2", "telegram", "5", True)
    assert [(m.seq, m.body) for m in b.messages] == [(1, "[]"), (2, "ok")] and b.dropped_non_text == ["image"]
    assert b.messages[1].sent_at is None and b.should_evaluate
    assert c.external_id is None


def test_after_hours_depends_on_the_portal(spark):
    df = spark.createDataFrame([("2026-07-19 19:24:59",), ("2026-07-19 12:00:00",), ("2026-07-19 18:00:00",)], "t string")
    got = [r.a for r in df.select(clock.is_after_hours(F.col("t").cast("timestamp")).alias("a")).collect()]
    assert got == [True, False, False]


def test_recording_names(spark):
    names = ["q-3009-0500000000-20260705-101112-1783235472.5.wav", "q-3009-0500000000-20260705-101112-1783235472.5 (1).wav",
             "random-recording.wav", "q-3009-05000-2026070a-101112-1.wav", "q-3009-0500000000-20260705-101112-1783239072.5.wav"]
    df = spark.createDataFrame([(str(i), n, 2000 + i) for i, n in enumerate(names)], "file_id string, name string, size_bytes long").withColumn(
        "modified_at", F.lit("2026-07-05").cast("timestamp"))
    got = calls.decode_recording_name(df)
    assert sorted(r.clock_drift_seconds for r in got.collect()) == [0, 0, 3600]
    assert calls.rejected_names(df).count() == 2
    assert {r.uniqueid: r.file_id for r in calls.best_copy_per_call(got).collect()} == {"1783235472.5": "1", "1783239072.5": "4"}


def test_landing_again_adds_nothing(spark):
    df = spark.createDataFrame([(i, f"p{i % 3}") for i in range(9)], "arrival_id long, payload string")
    none = payloads.hashed(df.limit(0), "w")
    first = payloads.land_raw(df, none, "w")
    assert first.count() == 3 and first.where("is_new").count() == 3
    assert payloads.land_raw(df, payloads.hashed(df, "w"), "w").where("is_new").count() == 0


def test_upsert_touches_only_its_columns(spark):
    old = spark.createDataFrame([("a", 1, "{}"), ("b", 2, "x")], "k string, n int, meta string")
    new = spark.createDataFrame([("a", 9, "y"), ("b", 9, "y"), ("c", 9, "y")], "k string, n int, meta string")
    got = {tuple(r) for r in sinks.upsert(old, new, ["k"], ["n"]).collect()}
    assert got == {("a", 9, "{}"), ("b", 9, "x"), ("c", 9, "y")}
    held = {tuple(r) for r in sinks.upsert(old, new, ["k"], ["n", "meta"], F.col("old.meta") == "{}").collect()}
    assert held == {("a", 9, "y"), ("b", 2, "x"), ("c", 9, "y")}


@pytest.mark.parametrize("failures,status", [(4, "asr_failed"), (5, "dead_letter")])
def test_retry_budget(spark, failures, status):
    rows = [("u", 0, "discovered", None)] + [("u", i + 1, "asr_failed", f"e{i}") for i in range(failures)]
    df = spark.createDataFrame(rows, "uniqueid string, event_id int, step string, error string").withColumn(
        "logged_at", F.timestamp_seconds("event_id"))
    r = calls.job_state_fold(df).first()
    assert (r.status, r.retries, r.last_error) == (status, failures, f"e{failures - 1}")
