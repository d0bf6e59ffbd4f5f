"""Streams over tables that arrive in several micro-batches, run to the end and checked against batch SQL.

Each query first lays its table out as arrivals: slices of time, one after another, some rows
far behind their time, and a last row without keys that moves the watermark past the end. What
it returns is what the stream and its catch-up have written, nothing from a batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley import session
from parley.plans.catalog.base import FOLLOW_UPS_SQL, cte, query
from parley.streaming import jobs

SLICES = 3
#: rows of a file of arrivals, about
FILE_ROWS = 1 << 20
#: rows of a group of keys of a keyed stream, about
GROUP_ROWS = 1 << 16


def _feed(t, rows: DataFrame, at: str, name: str, late: str = "false") -> tuple[DataFrame, str, int]:
    """``rows`` as a stream of their arrivals, a lateness that covers a slice, and groups for their keys; ``late`` rows come after all slices."""
    folder, rows = session.shared_folder(t.spark, name), session.persist(rows, f"{name}-rows")
    low, high, n = rows.agg(F.min(F.unix_seconds(at)), F.max(F.unix_seconds(at)), F.count(F.lit(1))).first()
    if low is None:
        low = high = 0
    width = (high - low) // SLICES + 1
    when = F.when(F.expr(late), SLICES).otherwise(F.floor((F.unix_seconds(at) - low) / width))
    # as many files for each slice as a micro-batch takes, so that larger tables do not come in more micro-batches
    files = n // (SLICES * FILE_ROWS) + 1
    for i in range(SLICES + 1):
        rows.where(when == i).repartition(files).write.mode("append").parquet(folder)
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != at]
    for after in (0, 1):
        ended = F.timestamp_seconds(F.lit(high + 90 * 86_400 + width + after))
        t.spark.range(0, files, 1, files).select(ended.alias(at), *rest).select(*rows.columns).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder), f"{width} seconds", max(64, n // GROUP_ROWS)


def _path(t, name: str) -> str:
    return session.shared_folder(t.spark, name)


#: rows that arrive after the watermark has long passed them
LATE = "message_id % 53 = 0"


@query(
    "stream_land",
    cte("messages") + " SELECT sha256(payload) AS payload_hash, 'webhook' AS source FROM "
    "(SELECT DISTINCT sender || ' ' || CAST(message_id % 1000 AS STRING) AS payload FROM messages)",
)
def stream_land(t):
    payload = F.concat_ws(" ", "sender", (F.col("message_id") % 1000).cast("string"))
    sent = t.messages.select(payload.alias("payload"), F.col("sent_at").alias("received_at"))
    arrivals, _, _ = _feed(t, jobs.hashed(sent, "webhook"), "received_at", "arrivals", "substr(payload_hash, 1, 1) = 'a'")
    # copies come again all through the month, some after the state of the first is gone
    return jobs.run_to_table(jobs.landing("60 days"), arrivals, _path(t, "stream-land"))


@query(
    "stream_messages_dedup",
    cte("messages") + " SELECT DISTINCT interaction_id, sender, date_trunc('hour', sent_at) AS sent_at, sha256(sender) AS body_hash FROM messages",
)
def stream_messages_dedup(t):
    # every message is sent twice, with its time cut to the hour
    sent = t.messages.select(
        "interaction_id", "sender", F.date_trunc("hour", "sent_at").alias("sent_at"), F.sha2("sender", 256).alias("body_hash"), "message_id",
        F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"),
    )
    arrivals, _, _ = _feed(t, sent, "sent_at", "messages", LATE)
    return jobs.run_to_table(jobs.deduplicated(), arrivals, _path(t, "stream-dedup"))


_SESSIONS = (
    "g AS (SELECT *, CASE WHEN sent_at - lag(sent_at) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS cut "
    "FROM messages WINDOW w AS (PARTITION BY interaction_id ORDER BY sent_at, message_id)), "
    "s AS (SELECT *, sum(cut) OVER (PARTITION BY interaction_id ORDER BY sent_at, message_id) AS n FROM g), "
    "z AS (SELECT interaction_id, min(sent_at) AS session_start, max(sent_at) + INTERVAL 12 HOUR AS settled_at, count(*) AS messages "
    "FROM s GROUP BY interaction_id, n)"
)


@query("settled_threads_stream", cte("messages") + ", " + _SESSIONS + " SELECT * FROM z")
def settled_threads_stream(t):
    arrivals, _, _ = _feed(t, t.messages.select("interaction_id", "sent_at", "message_id"), "sent_at", "messages", LATE)
    return jobs.run_to_table(jobs.settled_threads("12 hours"), arrivals, _path(t, "settled-threads"))


@query(
    "windowed_counts",
    cte("messages") + ", z AS (SELECT time_bucket(INTERVAL 15 MINUTE, sent_at) AS period_start, sender, count(*) AS n FROM messages GROUP BY ALL) "
    "SELECT * FROM z",
)
def windowed_counts(t):
    period = F.timestamp_seconds(F.floor(F.unix_seconds("sent_at") / 900) * 900)
    rows = t.messages.select(period.alias("period_start"), "sender", "sent_at", "message_id")
    arrivals, _, _ = _feed(t, rows, "sent_at", "messages", LATE)
    return jobs.run_to_table(jobs.windowed_counts(), arrivals, _path(t, "windowed-counts"))


@query(
    "job_states_stream",
    cte("job_events") + ", l AS (SELECT uniqueid, arg_max(step, event_id) FILTER (WHERE step <> 'discovered') AS step, bool_or(step = 'evaluated') AS done, "
    "count(*) FILTER (WHERE step IN ('asr_failed', 'judge_failed')) AS retries, "
    "arg_max(error, event_id) FILTER (WHERE error IS NOT NULL) AS last_error, max(logged_at) AS updated_at FROM job_events GROUP BY uniqueid) "
    "SELECT uniqueid, CASE WHEN done THEN 'evaluated' WHEN retries >= 5 THEN 'dead_letter' ELSE coalesce(step, 'discovered') END AS status, "
    "retries, last_error, updated_at FROM l",
)
def job_states_stream(t):
    events, lateness, groups = _feed(t, t.job_events, "logged_at", "job-events")
    return jobs.call_queue(events, _path(t, "call-queue"), lateness=lateness, keep="60 days", groups=groups).read()


@query(
    "promise_timer",
    cte("interactions", "promises") + ", " + FOLLOW_UPS_SQL
    # at the end of the stream all have lapsed
    + " SELECT follow_up_id, customer_id, agent_id, promised_at, due_at, CASE status WHEN 'open' THEN 'missed' ELSE status END AS status, "
    "fulfilled_at, fulfilled_in FROM follow_ups",
)
def promise_timer(t):
    line = jobs.keyed.promise_line(t.promises, t.interactions)
    arrivals, lateness, groups = _feed(t, line, "at", "promise-line")
    return jobs.promise_outcomes(arrivals, _path(t, "promises"), lateness=lateness, groups=groups).read()


@query(
    "thread_debounce",
    cte("messages") + ", o AS (SELECT *, lead(sent_at) OVER (PARTITION BY interaction_id ORDER BY sent_at, message_id) AS next_at FROM messages), "
    "m AS (SELECT interaction_id, message_id AS last_id, sent_at AS last_at FROM o WHERE next_at IS NULL OR next_at - sent_at > INTERVAL 12 HOUR) "
    "SELECT interaction_id AS external_ref, last_id, last_at + INTERVAL 12 HOUR AS settled_at, 0 AS page, "
    "'[' || string_agg('{\"sender\":\"' || sender || '\",\"message\":\"' || replace(body, '\"', '\\\"') || '\",\"timestamp\":\"' || "
    "strftime(sent_at, '%Y-%m-%d') || '\"}', ',' ORDER BY message_id) || ']' AS history "
    "FROM m JOIN messages USING (interaction_id) WHERE sent_at < last_at OR sent_at = last_at AND message_id <= last_id GROUP BY ALL",
)
def thread_debounce(t):
    raw = t.messages.select(
        F.col("interaction_id").alias("external_ref"), F.col("message_id").alias("raw_id"), F.col("sent_at").alias("received_at"), "sender",
        F.col("body").alias("message"), F.date_format("sent_at", "yyyy-MM-dd").alias("timestamp"),
    )
    landed = session.persist(raw, "landed")
    arrivals, lateness, groups = _feed(t, landed.select("external_ref", "raw_id", "received_at"), "received_at", "arrivals")
    return jobs.thread_debounce(arrivals, _path(t, "debounce"), "12 hours", lateness, lambda spark: landed, groups)
