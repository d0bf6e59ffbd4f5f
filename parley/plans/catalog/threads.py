"""Message threads and call segments: metrics, renderings, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import conversations as co
from parley.plans.catalog.base import cte, query

_GAPS = (
    "told AS (SELECT * FROM messages WHERE sender IN ('customer', 'agent')), "
    "lagged AS (SELECT *, lag(sender) OVER w AS before FROM told WINDOW w AS (PARTITION BY interaction_id ORDER BY sent_at, message_id)), "
    "starts AS (SELECT *, lag(sent_at) OVER w AS opened FROM lagged WHERE before IS DISTINCT FROM sender "
    "WINDOW w AS (PARTITION BY interaction_id ORDER BY sent_at, message_id)), "
    "gaps AS (SELECT interaction_id, opened AS asked_at, sent_at AS replied_at, "
    "(epoch_us(sent_at) - epoch_us(opened)) / 1e6::DOUBLE AS gap_seconds FROM starts WHERE sender = 'agent' AND opened IS NOT NULL)"
)
_METRICS = (
    "measured AS (SELECT interaction_id, CAST(trunc(arg_min(gap_seconds, asked_at)) AS INT) AS first_response_seconds, "
    "CAST(trunc(median(gap_seconds)) AS INT) AS median_response_seconds, "
    "CAST(trunc(max(gap_seconds)) AS INT) AS max_response_gap_seconds FROM gaps GROUP BY interaction_id)"
)
_COUNTS = (
    "counted AS (SELECT interaction_id, count(*) FILTER (WHERE sender = 'customer') AS customer_message_count, "
    "count(*) FILTER (WHERE sender = 'agent') AS agent_message_count, count(*) FILTER (WHERE sender = 'bot') AS bot_message_count, "
    "CAST(trunc((epoch_us(max(sent_at)) - epoch_us(min(sent_at))) / 1e6::DOUBLE) AS INT) AS conversation_span_seconds, "
    "min(sent_at) AS first_at, max(sent_at) AS last_at FROM messages GROUP BY interaction_id)"
)
_LANGUAGE = (
    "said AS (SELECT interaction_id, regexp_replace(string_agg(body, ' ') FILTER (WHERE sender = 'customer'), '[^\\p{L}]', '', 'g') AS c, "
    "regexp_replace(string_agg(body, ' ') FILTER (WHERE sender = 'agent'), '[^\\p{L}]', '', 'g') AS a FROM messages GROUP BY interaction_id), "
    "spoke AS (SELECT interaction_id, (length(regexp_replace(c, '[^\\x{0600}-\\x{06FF}]', '', 'g')) * 2 > length(c)) = "
    "(length(regexp_replace(a, '[^\\x{0600}-\\x{06FF}]', '', 'g')) * 2 > length(a)) AS language_matched FROM said)"
)


@query("response_gaps", cte("messages") + ", " + _GAPS + " SELECT * FROM gaps")
def response_gaps(t):
    return co.response_gaps(t.messages).drop("turn")


@query("response_metrics", cte("messages") + ", " + _GAPS + ", " + _METRICS + " SELECT * FROM measured")
def response_metrics(t):
    return co.response_metrics(co.response_gaps(t.messages))


@query("message_counts", cte("messages") + ", " + _COUNTS + " SELECT * FROM counted")
def message_counts(t):
    return co.message_counts(t.messages)


@query(
    "chat_metrics",
    cte("messages") + ", " + ", ".join((_GAPS, _METRICS, _COUNTS, _LANGUAGE))
    + " SELECT counted.*, spoke.language_matched, first_response_seconds, median_response_seconds, max_response_gap_seconds, "
    "NOT (CAST(first_at + INTERVAL 3 HOUR AS TIME) BETWEEN TIME '09:00:00' AND TIME '21:00:00') AS after_hours "
    "FROM counted LEFT JOIN spoke USING (interaction_id) LEFT JOIN measured USING (interaction_id)",
)
def chat_metrics(t):
    return co.chat_metrics(t.messages)


@query(
    "talk_ratio",
    cte("segments") + " SELECT call_id, round_even(coalesce(sum(seconds) FILTER (WHERE speaker = 'agent'), 0) / "
    "nullif(sum(seconds) FILTER (WHERE speaker IN ('agent', 'customer')), 0), 3) AS agent_talk_ratio FROM segments GROUP BY call_id",
)
def talk_ratio(t):
    return co.talk_ratio(t.segments)


@query(
    "resequence",
    cte("messages") + " SELECT interaction_id, message_id, row_number() OVER (PARTITION BY interaction_id ORDER BY sent_at, message_id) AS seq "
    "FROM messages WHERE sender <> 'system'",
)
def resequence(t):
    return co.resequence(t.messages.where("sender <> 'system'")).select("interaction_id", "message_id", "seq")


@query(
    "is_latest_version",
    cte("messages") + " SELECT message_id AS raw_id, interaction_id AS external_ref, "
    "message_id = max(message_id) OVER (PARTITION BY interaction_id) AS is_latest FROM messages",
)
def is_latest_version(t):
    arrivals = t.messages.select(F.col("message_id").alias("raw_id"), F.col("interaction_id").alias("external_ref"))
    return co.latest_version(arrivals).select("raw_id", "external_ref", "is_latest")


@query(
    "chat_transcript",
    cte("messages") + " SELECT interaction_id, 0 AS page, string_agg('[' || strftime(sent_at, '%Y-%m-%d %H:%M:%S') || '] ' || "
    "upper(sender) || ': ' || body, chr(10) ORDER BY sent_at, message_id) AS transcript_text FROM messages GROUP BY interaction_id",
)
def chat_transcript(t):
    return co.chat_transcript(t.messages)


_MMSS = "lpad(CAST(s // 60 AS STRING), CAST(greatest(2, length(CAST(s // 60 AS STRING))) AS INT), '0') || ':' || lpad(CAST(s % 60 AS STRING), 2, '0')"


@query(
    "call_dialogue",
    cte("segments") + ", p AS (SELECT *, seq * 40 AS s FROM segments WHERE length(text) > 0) SELECT call_id, seq // 1000 AS page, "
    "string_agg('[' || " + _MMSS + " || ']' || CASE WHEN speaker = 'unknown' THEN '' ELSE ' ' || upper(speaker) || ':' END || ' ' || text, "
    "chr(10) ORDER BY seq) AS dialogue FROM p GROUP BY ALL",
)
def call_dialogue(t):
    return co.call_dialogue(t.segments.withColumn("start_sec", F.col("seq") * 40.0))


@query(
    "collect_thread",
    cte("messages") + " SELECT interaction_id AS external_ref, 0 AS page, '[' || string_agg('{\"sender\":\"' || sender || '\",\"message\":\"' || "
    "replace(body, '\"', '\\\"') || '\",\"timestamp\":\"' || strftime(sent_at, '%Y-%m-%d') || '\"}', ',' ORDER BY message_id) || ']' AS history "
    "FROM messages GROUP BY interaction_id",
)
def collect_thread(t):
    arrivals = t.messages.select(
        F.col("interaction_id").alias("external_ref"), F.col("message_id").alias("raw_id"), "sender",
        F.col("body").alias("message"), F.date_format("sent_at", "yyyy-MM-dd").alias("timestamp"),
    )
    return co.collect_thread(arrivals)


_FAULTS = (
    "SELECT interaction_id, count(*) FILTER (WHERE sender = 'agent') = 0 AS is_bot_only, "
    "count(*) FILTER (WHERE sender = 'customer') = 0 AS has_no_customer_turn, "
    "count(*) FILTER (WHERE sender = 'agent') > 0 AND count(*) FILTER (WHERE sender = 'customer') > 0 AS should_evaluate "
    "FROM messages GROUP BY interaction_id"
)


@query("thread_faults", cte("messages") + " " + _FAULTS)
def thread_faults(t):
    return co.thread_faults(t.messages)


@query(
    "settled_threads",
    cte("messages") + ", g AS (SELECT *, CASE WHEN sent_at - lag(sent_at) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS cut "
    "FROM messages WINDOW w AS (PARTITION BY interaction_id ORDER BY sent_at, message_id)), "
    "s AS (SELECT *, sum(cut) OVER (PARTITION BY interaction_id ORDER BY sent_at, message_id) AS n FROM g) "
    "SELECT interaction_id, min(sent_at) AS session_start, max(sent_at) + INTERVAL 12 HOUR AS settled_at, count(*) AS messages "
    "FROM s GROUP BY interaction_id, n HAVING max(sent_at) + INTERVAL 12 HOUR <= TIMESTAMP '2024-01-25 00:00:00'",
)
def settled_threads(t):
    return co.settled_threads(t.messages, F.lit("2024-01-25 00:00:00").cast("timestamp"), "12 hours")
