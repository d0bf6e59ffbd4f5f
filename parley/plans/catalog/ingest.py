"""Landing, parsing and writing: sources and sinks run over the tables."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from parley import session
from parley.operators import calls as ca
from parley.operators import rollups as ro
from parley.plans.catalog.base import cte, query
from parley.sources import payloads as pl
from parley.sources import recordings as rec
from parley.sources import sinks

_BODY = (
    "b AS (SELECT arrival_id, CASE arrival_id % 5 WHEN 0 THEN payload->'$.body' WHEN 1 THEN payload->'$[0]' ELSE payload::JSON END AS b, "
    "arrival_id % 2 = 0 AS modern FROM payloads), "
    "h AS (SELECT arrival_id, modern, b, CAST(unnest(range(4)) AS INT) AS i, "
    "unnest(CASE WHEN modern THEN json_extract(b, '$.messages[*]') ELSE json_extract(b, '$.conversation_history[*]') END) AS m FROM b), "
    "r AS (SELECT arrival_id, modern, b, i, lower(CASE WHEN modern THEN m->>'$.sender_role' ELSE m->>'$.sender' END) AS who, "
    "coalesce(m->>'$.is_bot' = 'true', false) AS bot, trim(CASE WHEN modern THEN m->>'$.content' ELSE m->>'$.message' END) AS body, "
    "coalesce(m->>'$.content_type', '') AS kind, m->>'$.timestamp' AS stamp, m->>'$.deal_id' AS row_deal FROM h), "
    "msgs AS (SELECT *, CASE WHEN who IN ('customer','client','user') THEN 'customer' WHEN who = 'bot' OR bot THEN 'bot' "
    "WHEN who IN ('agent','operator','manager','employee') THEN 'agent' ELSE 'unknown' END AS sender, kind IN ('', 'text') AND body <> '' AS kept, "
    "CASE WHEN stamp <> 'soon' THEN strptime(substr(stamp, 1, 19), '%Y-%m-%dT%H:%M:%S') - CASE WHEN stamp LIKE '%+03:00' THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END END AS sent_at FROM r)"
)
_PARSED = (
    ", g AS (SELECT arrival_id, any_value(b) AS b, any_value(modern) AS modern, count(*) FILTER (WHERE kept) AS n_messages, "
    "count(*) FILTER (WHERE kept AND sender = 'agent') AS n_agent, count(*) FILTER (WHERE kept AND sender = 'customer') AS n_customer, "
    "arg_min(sent_at, i) FILTER (WHERE kept) AS s1, min(i) FILTER (WHERE kept) AS i1, max(i) FILTER (WHERE kept) AS i2, "
    "arg_min(row_deal, i) FILTER (WHERE row_deal IS NOT NULL) AS row_deal, count(*) FILTER (WHERE NOT kept) AS dropped FROM msgs GROUP BY arrival_id) "
)


@query(
    "parse_chats",
    cte("payloads") + ", " + _BODY + _PARSED
    + "SELECT g.arrival_id, coalesce(b->>'$.conversation_id', b->>'$.Dialog') AS external_id, n_messages, "
    "(SELECT m.sent_at FROM msgs m WHERE m.arrival_id = g.arrival_id AND m.i = g.i1) AS started_at, "
    "(SELECT m.sent_at FROM msgs m WHERE m.arrival_id = g.arrival_id AND m.i = g.i2) AS ended_at, "
    "CASE WHEN modern THEN '+966' || substr(b->>'$.customer_phone', 2) WHEN b->>'$.phone' LIKE '+%' THEN b->>'$.phone' END AS customer_phone_e164, "
    "CASE WHEN modern THEN coalesce(row_deal, 'synthetic:' || (b->>'$.conversation_id')) "
    "WHEN b->>'$.crm_entity_id' <> '' THEN b->>'$.crm_entity_id' ELSE b->>'$.deal_info.ID' END AS deal_id, "
    "modern AND row_deal IS NULL AS deal_id_is_synthetic, nullif(b->>'$.deal_info.ASSIGNED_BY_ID', '') AS agent_external_id, "
    "coalesce(CAST(b->>'$.message_count' AS INT) > 4, false) AS truncated, dropped AS n_dropped, n_agent = 0 AS is_bot_only, "
    "n_messages > 0 AND n_customer = 0 AS has_no_customer_turn, n_agent > 0 AND n_customer > 0 AS should_evaluate FROM g",
)
def parse_chats(t):
    return pl.parse_chats(t.payloads, synthetic_deals=True).select(
        "arrival_id", "external_id", F.size("messages").alias("n_messages"), "started_at", "ended_at", "customer_phone_e164",
        "deal_id", "deal_id_is_synthetic", "agent_external_id", "truncated", F.size("dropped_non_text").alias("n_dropped"),
        "is_bot_only", "has_no_customer_turn", "should_evaluate",
    )


@query(
    "scoreable_messages",
    cte("payloads") + ", " + _BODY + " SELECT coalesce(b->>'$.conversation_id', b->>'$.Dialog') AS interaction_id, "
    "CAST(row_number() OVER (PARTITION BY arrival_id ORDER BY i) AS INT) AS seq, sender, body, sent_at FROM msgs WHERE kept",
)
def scoreable_messages(t):
    return pl.messages_of(pl.parse_chats(t.payloads)).drop("body_hash")


@query(
    "fetch_since",
    cte("contacts") + " SELECT interaction_id AS external_id, started_at FROM contacts WHERE started_at >= TIMESTAMP '2000-01-01'",
)
def fetch_since(t):
    stored = t.contacts.select(F.col("interaction_id").alias("external_id"), "started_at")
    return pl.fetch_since(stored, F.lit("2000-01-01").cast("timestamp"))


@query(
    "land_raw",
    cte("payloads") + ", a AS (SELECT arrival_id, payload FROM payloads UNION ALL SELECT arrival_id + 1000000000, payload FROM payloads WHERE arrival_id % 3 = 0) "
    "SELECT sha256(payload) AS payload_hash, min(arrival_id) AS arrival_id, count(*) AS copies, min(arrival_id) % 4 <> 1 AS is_new FROM a GROUP BY 1",
)
def land_raw(t):
    again = t.payloads.where("arrival_id % 3 = 0").withColumn("arrival_id", F.col("arrival_id") + 1_000_000_000)
    landed = pl.hashed(t.payloads.where("arrival_id % 4 = 1"), "webhook")
    return pl.land_raw(t.payloads.unionByName(again), landed, "webhook").drop("source")


@query(
    "unwrap_rows",
    cte("contacts") + ", c AS (SELECT *, length(interaction_id) % 4 AS k FROM contacts) SELECT interaction_id, p AS position, 'v' || CAST(p AS STRING) AS value "
    "FROM c, LATERAL (VALUES (0), (1)) t(p) WHERE k <> 3",
)
def unwrap_rows(t):
    rows = F.lit('[{"x": "v0"}, {"x": "v1"}]')
    k = F.length("interaction_id") % 4
    payload = (
        F.when(k == 0, rows).when(k == 1, F.concat(F.lit('{"items": '), rows, F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"data": '), rows, F.lit(', "n": 2}'))).otherwise('{"other": [1]}')
    )
    df = t.contacts.select("interaction_id", payload.alias("payload"))
    return pl.unwrap_rows(df).select("interaction_id", "position", F.try_variant_get("row", "$.x", "string").alias("value"))


_NAMES = (
    "p AS (SELECT file_id, size_bytes, modified_at, regexp_extract(regexp_replace(name, '\\s*\\([0-9]+\\)\\.', '.'), "
    "'^([a-z]+)-([0-9]+)-([0-9]+)-([0-9]{8})-([0-9]{6})-([0-9.]+)\\.wav$', ['kind','ext','number','d','t','u']) AS x FROM recordings), "
    "s AS (SELECT file_id, size_bytes, modified_at, x.kind AS kind, x.ext AS agent_extension, x.number AS customer_phone_raw, x.u AS uniqueid, "
    "strptime(x.d || x.t, '%Y%m%d%H%M%S') - INTERVAL 3 HOUR AS started_at FROM p WHERE x.u <> '')"
)


@query("decode_recording_name", cte("recordings") + ", " + _NAMES + " SELECT file_id, kind, agent_extension, customer_phone_raw, uniqueid, started_at FROM s")
def decode_recording_name(t):
    return ca.decode_recording_name(t.recordings).select(
        "file_id", "kind", "agent_extension", "customer_phone_raw", "uniqueid", "started_at"
    )


@query("rejected_names", cte("recordings") + " SELECT file_id, name FROM recordings WHERE name LIKE 'memo-%'")
def rejected_names(t):
    return ca.rejected_names(t.recordings).select("file_id", "name")


@query(
    "best_copy_per_call",
    cte("recordings") + ", " + _NAMES + " SELECT split_part(uniqueid, '.', 1) AS uniqueid, file_id, size_bytes FROM s "
    "QUALIFY row_number() OVER (PARTITION BY split_part(uniqueid, '.', 1) ORDER BY coalesce(size_bytes, 0) DESC, modified_at, file_id) = 1",
)
def best_copy_per_call(t):
    decoded = ca.decode_recording_name(t.recordings).withColumn("uniqueid", F.split_part("uniqueid", F.lit("."), F.lit(1)))
    return ca.best_copy_per_call(decoded).select("uniqueid", "file_id", "size_bytes")


@query(
    "too_small_audio",
    cte("recordings") + ", " + _NAMES + " SELECT file_id, CASE WHEN size_bytes < 1024 THEN 'dead_letter' ELSE 'discovered' END AS status FROM s",
)
def too_small_audio(t):
    return ca.register(ca.decode_recording_name(t.recordings)).select("file_id", "status")


@query(
    "scan_since",
    cte("recordings") + " SELECT file_id, modified_at FROM recordings WHERE modified_at > TIMESTAMP '1998-01-01'",
)
def scan_since(t):
    return rec.scan_since(t.recordings, F.lit("1998-01-01").cast("timestamp")).select("file_id", "modified_at")


@query(
    "load_scored_transcript",
    cte("segments") + ", c AS (SELECT call_id, round_even(count(*) FILTER (WHERE NOT failed) / CAST(count(*) AS DOUBLE), 2) AS confidence FROM segments GROUP BY 1) "
    "SELECT s.call_id, s.seq, c.confidence, s.text FROM segments s JOIN c USING (call_id)",
)
def load_scored_transcript(t):
    # a stored transcript is one document with all its segments
    stored = t.segments.groupBy("call_id").agg(
        F.to_json(
            F.struct(
                F.sum("seconds").alias("duration_sec"),
                F.sort_array(
                    F.collect_list(F.struct(F.col("seq").alias("idx"), "text", F.when(F.col("failed"), "timeout").alias("error")))
                ).alias("segments"),
            )
        ).alias("payload")
    )
    return rec.load_scored_transcript(stored).select("call_id", "seq", "confidence", "text")


@query(
    "insert_ignore",
    cte("messages") + " SELECT interaction_id, sender, count(*) AS added FROM (SELECT DISTINCT interaction_id, sender, date_trunc('hour', sent_at) AS h "
    "FROM messages WHERE date_trunc('hour', sent_at) NOT IN (SELECT date_trunc('hour', sent_at) FROM messages WHERE message_id % 50 = 0)) GROUP BY ALL",
)
def insert_ignore(t):
    rows = t.messages.select("interaction_id", "sender", F.date_trunc("hour", "sent_at").alias("h"), "message_id")
    stored = rows.where("message_id % 50 = 0").select("h").distinct()
    # every stored hour counts as present for all threads and senders
    known = rows.join(stored, "h", "left_semi").select("interaction_id", "sender", "h").distinct()
    return sinks.insert_ignore(known, rows, ["interaction_id", "sender", "h"]).groupBy("interaction_id", "sender").agg(
        F.count(F.lit(1)).alias("added")
    )


@query(
    "upsert_interactions",
    cte("contacts") + ", o AS (SELECT interaction_id, channel, agent_id, started_at FROM contacts WHERE agent_id % 3 <> 0), "
    "n AS (SELECT interaction_id, 'other' AS channel, agent_id + 1000 AS agent_id, started_at + INTERVAL 1 DAY AS started_at FROM contacts WHERE agent_id % 2 = 0) "
    "SELECT coalesce(o.interaction_id, n.interaction_id) AS interaction_id, CASE WHEN o.interaction_id IS NULL THEN n.channel ELSE o.channel END AS channel, "
    "coalesce(n.agent_id, o.agent_id) AS agent_id, coalesce(o.started_at, n.started_at) AS started_at FROM o FULL JOIN n ON o.interaction_id = n.interaction_id",
)
def upsert_interactions(t):
    cols = ["interaction_id", "channel", "agent_id", "started_at"]
    old = t.contacts.where("agent_id % 3 <> 0").select(*cols)
    new = t.contacts.where("agent_id % 2 = 0").select(
        "interaction_id", F.lit("other").alias("channel"), (F.col("agent_id") + 1000).alias("agent_id"),
        (F.col("started_at") + F.expr("INTERVAL 1 DAY")).alias("started_at"),
    )
    return sinks.upsert(old, new, ["interaction_id"], ["agent_id"])


@query(
    "conditional_upsert_jobs",
    cte("contacts") + ", o AS (SELECT interaction_id AS uniqueid, CASE WHEN agent_id % 2 = 0 THEN '{}' ELSE '{\"a\":1}' END AS meta, 'evaluated' AS status FROM contacts WHERE agent_id % 3 <> 0), "
    "n AS (SELECT interaction_id AS uniqueid, '{\"b\":2}' AS meta, 'discovered' AS status FROM contacts WHERE agent_id % 5 <> 0) "
    "SELECT coalesce(o.uniqueid, n.uniqueid) AS uniqueid, CASE WHEN o.uniqueid IS NULL OR (o.meta = '{}' AND n.uniqueid IS NOT NULL) THEN n.meta ELSE o.meta END AS meta, "
    "coalesce(o.status, n.status) AS status FROM o FULL JOIN n ON o.uniqueid = n.uniqueid",
)
def conditional_upsert_jobs(t):
    blank = {c: F.lit("") for c in ("filename", "audio_uri", "updated_at")}
    old = t.contacts.where("agent_id % 3 <> 0").select(
        F.col("interaction_id").alias("uniqueid"),
        F.when(F.col("agent_id") % 2 == 0, "{}").otherwise('{"a":1}').alias("meta"), F.lit("evaluated").alias("status"),
    ).withColumns(blank)
    new = t.contacts.where("agent_id % 5 <> 0").select(
        F.col("interaction_id").alias("uniqueid"), F.lit('{"b":2}').alias("meta"), F.lit("discovered").alias("status")
    ).withColumns(blank)
    return sinks.register_jobs(old, new).select("uniqueid", "meta", "status")


@query(
    "rebuild_and_log",
    cte("customers") + " SELECT 'nightly_aggregate' AS job_name, 'succeeded' AS status, count(*) AS items_in, "
    "count(*) FILTER (WHERE is_merged_into IS NULL) AS items_ok, count(*) FILTER (WHERE primary_phone_e164 IS NULL) AS items_failed, "
    "CAST(NULL AS VARCHAR) AS error, '{\"customers\":' || count(*) || ',\"rebuilt\":' || count(*) FILTER (WHERE is_merged_into IS NULL) || '}' AS detail "
    "FROM customers UNION ALL SELECT 'nightly_aggregate', 'failed', count(*), 0, count(*) FILTER (WHERE primary_phone_e164 IS NULL), "
    "'RuntimeError: the store is full', '{\"customers\":' || count(*) || '}' FROM customers",
)
def rebuild_and_log(t):
    log, path = session.shared_folder(t.spark, "job-runs"), session.shared_folder(t.spark, "customer-metrics")
    with sinks.JobRun(t.spark, log, "nightly_aggregate") as run:
        customers = session.persist(run.stage(t.customers, "customers", failed=F.col("primary_phone_e164").isNull()), "customers")
        run.ran("customers")
        run.stage(ro.unmerged(customers), "rebuilt").write.parquet(path)
        run.ran("rebuilt")
    # a second run, which fails after its first stage
    try:
        with sinks.JobRun(t.spark, log, "nightly_aggregate") as run:
            session.persist(run.stage(t.customers, "customers", failed=F.col("primary_phone_e164").isNull()), "customers")
            run.ran("customers")
            raise RuntimeError("the store is full")
    except RuntimeError:
        pass
    return sinks.job_runs(t.spark, log).select("job_name", "status", "items_in", "items_ok", "items_failed", "error", "detail")


def _tasks(t) -> int:
    """Tasks that write many small files: set, as the adaptive size of partitions counts bytes, not files."""
    return 4 * t.spark.sparkContext.defaultParallelism


def _many_files(writer):
    """Tasks put their files in place; the driver would rename them one after another."""
    return writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")


@query(
    "list_recordings",
    cte("recordings_base") + " SELECT 'ext=' || ext || '-' || kind AS folder, count(DISTINCT file_id) > 0 AS has_rows, 1 AS files, 'once' AS streamed "
    "FROM recordings_base GROUP BY ext, kind",
)
def list_recordings(t):
    # one file for each folder of recordings; the stream is stopped and started again
    path, state = session.shared_folder(t.spark, "recordings"), session.shared_folder(t.spark, "listing-state")
    base = t.recordings_base
    rows = base.select("file_id", F.concat_ws("-", "ext", "kind").alias("ext"))
    _many_files(rows.repartition(_tasks(t), "ext").write.partitionBy("ext")).parquet(path)
    seen = session.shared_folder(t.spark, "listed")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{seen}/batch={number}")

    for _ in range(2):
        # the clock has to pass the files' times
        time.sleep(1.5)
        stream = rec.stream_recordings(t.spark, path, suffix=".parquet").writeStream.foreachBatch(keep).option("checkpointLocation", state)
        stream.trigger(once=True).start().awaitTermination()
    listed = rec.list_recordings(t.spark, path, suffix=".parquet")
    found = listed.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.max(F.col("size_bytes") > 0).alias("has_rows"))
    once = t.spark.read.schema(listed.schema).parquet(seen).groupBy("folder").agg(F.count(F.lit(1)).alias("times"))
    return found.join(once, "folder", "left").select(
        "folder", "has_rows", F.col("files").cast("int").alias("files"), F.when(F.col("times") == F.col("files"), "once").alias("streamed")
    )


#: files of a folder of payloads, at most
FOLDER_FILES = 256


@query(
    "read_raw_payloads",
    cte("payloads") + ", f AS (SELECT arrival_id // 49 AS file, arg_min(payload::JSON, arrival_id) AS b FROM payloads WHERE arrival_id % 5 >= 2 GROUP BY 1) "
    "SELECT coalesce(b->>'$.conversation_id', b->>'$.Dialog') AS external_id, nullif(b->>'$.deal_info.ASSIGNED_BY_ID', '') AS agent_external_id FROM f",
)
def read_raw_payloads(t):
    # a file for each forty-nine arrivals, an array of their payloads of which the first is read
    path = session.shared_folder(t.spark, "payloads")
    bare = t.payloads.where("arrival_id % 5 >= 2").groupBy(F.floor(F.col("arrival_id") / 49).alias("file"))
    arrays = bare.agg(F.array_sort(F.collect_list(F.struct("arrival_id", "payload"))).alias("rows"))
    text = F.concat(F.lit("["), F.array_join("rows.payload", ",\n"), F.lit("]"))
    # folders of a bounded number of files each
    files = arrays.select("file", F.floor(F.col("file") / FOLDER_FILES).alias("folder"), text.alias("value")).repartition(_tasks(t), "file").drop("file")
    _many_files(files.write.option("maxRecordsPerFile", 1).partitionBy("folder")).text(path)
    return pl.parse_chats(pl.read_raw_payloads(t.spark, path).select("payload")).select("external_id", "agent_external_id")
