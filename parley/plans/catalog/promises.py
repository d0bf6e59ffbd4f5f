"""Identity, deals, promises and the call queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import clock
from parley.functions import text as T
from parley.operators import calls as ca
from parley.operators import identity as idn
from parley.operators import promises as pr
from parley.plans.catalog.base import AS_OF_TEXT, FOLLOW_UPS_SQL, cte, query

_MADE = (
    "made AS (SELECT a.interaction_id AS promised_in, i.customer_id, i.agent_id, p->>'$.promise' AS promise_text, "
    "i.started_at AS promised_at, CASE WHEN p->>'$.due_hint' IS NOT NULL THEN i.started_at + INTERVAL 24 HOUR END AS due_at, i.channel "
    "FROM (SELECT interaction_id, unnest(json_extract(payload, '$.promises_made_by_agent[*]')) AS p FROM analyses) a "
    "JOIN interactions i USING (interaction_id) WHERE i.agent_id IS NOT NULL)"
)


@query(
    "fuzzy_name_candidates",
    cte("customers") + ", w AS (SELECT customer_id, '  ' || unnest(regexp_extract_all(lower(display_name), '[\\p{L}\\p{N}]+')) || ' ' AS w FROM customers), "
    "g AS (SELECT DISTINCT customer_id, substr(w, i, 3) AS g FROM (SELECT customer_id, w, unnest(range(1, length(w) - 1)) AS i FROM w)), "
    "n AS (SELECT customer_id, count(*) AS n FROM g GROUP BY 1), "
    "c AS (SELECT a.customer_id AS a, b.customer_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.customer_id < b.customer_id GROUP BY ALL) "
    "SELECT a AS customer_id_a, b AS customer_id_b, round_even(c / CAST(x.n + y.n - c AS DOUBLE), 4) AS similarity "
    "FROM c JOIN n x ON x.customer_id = a JOIN n y ON y.customer_id = b WHERE c * 100 >= 85 * (x.n + y.n - c)",
)
def fuzzy_name_candidates(t):
    return idn.fuzzy_name_candidates(t.customers, "customer_id", "display_name", 0.85)


@query(
    "resolve_identity",
    cte("interactions", "customers") + ", created AS (SELECT customer_phone_e164 AS p, sha256(customer_phone_e164) AS id "
    "FROM interactions i WHERE customer_id IS NULL AND customer_phone_e164 IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM customers c WHERE c.primary_phone_e164 = i.customer_phone_e164) GROUP BY 1, 2), "
    "book AS (SELECT primary_phone_e164 AS p, CAST(customer_id AS STRING) AS id FROM customers WHERE primary_phone_e164 IS NOT NULL "
    "UNION ALL SELECT p, id FROM created) SELECT i.interaction_id, coalesce(CAST(i.customer_id AS STRING), b.id) AS customer_id "
    "FROM interactions i LEFT JOIN book b ON b.p = i.customer_phone_e164",
)
def resolve_identity(t):
    return idn.resolve_identity(t.interactions, t.customers).select("interaction_id", "customer_id")


@query(
    "new_customers",
    cte("interactions", "customers") + " SELECT sha256(customer_phone_e164) AS customer_id, customer_phone_e164 AS value, 'phone' AS kind, "
    "min(started_at) AS first_seen_at, max(started_at) AS last_seen_at FROM interactions i WHERE customer_id IS NULL "
    "AND customer_phone_e164 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customers c WHERE c.primary_phone_e164 = i.customer_phone_e164) "
    "GROUP BY customer_phone_e164",
)
def new_customers(t):
    created = idn.new_customers(t.interactions, t.customers)
    return created.join(idn.identities(created).select("customer_id", "kind", "value"), "customer_id").select(
        "customer_id", "value", "kind", "first_seen_at", "last_seen_at"
    )


@query("materialise_promises", cte("analyses", "interactions") + ", " + _MADE + " SELECT * FROM made WHERE agent_id % 7 <> 3 OR promise_text <> 'send the offer'")
def materialise_promises(t):
    stored = t.interactions.where("agent_id % 7 = 3").select(
        F.col("interaction_id").alias("promised_in"), F.lit("send the offer").alias("promise_text")
    )
    return pr.materialise_promises(t.analyses, t.interactions, stored)


@query(
    "close_promises",
    cte("interactions", "promises") + ", " + FOLLOW_UPS_SQL
    + " SELECT follow_up_id, customer_id, agent_id, promised_at, due_at, fulfilled_in, fulfilled_at, hours_to_fulfil, status FROM follow_ups",
)
def close_promises(t):
    return t.follow_ups


@query(
    "followup_status",
    cte("interactions", "promises") + ", " + FOLLOW_UPS_SQL + " SELECT follow_up_id, CASE WHEN fulfilled_at IS NULL THEN "
    "CASE WHEN TIMESTAMP '2001-06-01' > due_at THEN 'missed' ELSE 'open' END "
    "WHEN fulfilled_at <= coalesce(due_at, promised_at + INTERVAL 24 HOUR) THEN 'fulfilled' ELSE 'late' END AS row_status FROM follow_ups",
)
def followup_status(t):
    status = clock.followup_status(F.col("promised_at"), F.col("due_at"), F.col("fulfilled_at"), t.as_of)
    return t.follow_ups.select("follow_up_id", status.alias("row_status"))


@query(
    "followup_history",
    cte("interactions", "agents") + " SELECT c.interaction_id AS call_id, coalesce(string_agg('  - [' || "
    "strftime(i.started_at, '%Y-%m-%d %H:%M:%S') || '+00] ' || i.channel || ' by ' || coalesce(a.full_name, 'unknown') || ', ' || "
    "CAST(CAST(round(CAST(epoch(i.started_at - c.started_at) AS BIGINT) / 3600, 1) AS DECIMAL(12,1)) AS VARCHAR) || 'h after this call', "
    "chr(10) ORDER BY i.started_at, i.interaction_id), '') AS history FROM interactions c LEFT JOIN interactions i "
    "ON i.customer_phone_e164 = c.customer_phone_e164 AND i.started_at > c.started_at AND i.started_at < c.started_at + INTERVAL 14 DAY "
    "LEFT JOIN agents a ON a.agent_id = i.agent_id AND i.kind <> 'q' WHERE c.channel = 'phone_call' GROUP BY c.interaction_id",
)
def followup_history(t):
    contacts = t.interactions.withColumn("agent_id", F.when(F.col("kind") != "q", F.col("agent_id")))
    return pr.followup_history(t.interactions.where("channel = 'phone_call'"), contacts, t.agents)


@query(
    "followup_module",
    cte("interactions") + ", p AS (SELECT c.interaction_id, c.started_at, c.customer_phone_e164 AS phone, count(i.interaction_id) AS n, "
    "round_even(min(epoch_us(i.started_at) - epoch_us(c.started_at)) / 3.6e9::DOUBLE, 2) AS hours_to_first_followup, "
    "min(i.started_at - c.started_at) AS first FROM interactions c LEFT JOIN interactions i "
    "ON i.customer_phone_e164 = c.customer_phone_e164 AND i.started_at > c.started_at AND i.started_at < c.started_at + INTERVAL 14 DAY "
    "WHERE c.channel = 'phone_call' GROUP BY ALL) "
    f"SELECT interaction_id, coalesce(started_at + INTERVAL 14 DAY <= TIMESTAMP '{AS_OF_TEXT}', false) AS window_over, "
    "CASE WHEN phone IS NOT NULL THEN n END AS followup_count, hours_to_first_followup, CASE WHEN n > 0 THEN CASE WHEN first <= INTERVAL 24 HOUR THEN 40 "
    "WHEN first <= INTERVAL 48 HOUR THEN 20 ELSE 0 END END AS timing, CASE WHEN n >= 2 THEN 30 WHEN n = 1 THEN 15 "
    "END AS frequency, CAST(NULL AS INT) AS message_quality FROM p",
)
def followup_module(t):
    return pr.followup_module(t.interactions.where("channel = 'phone_call'"), t.interactions, t.as_of)


@query(
    "agent_by_extension",
    cte("contacts", "agents") + " SELECT c.interaction_id, CASE WHEN c.kind <> 'q' THEN a.agent_id END AS agent_id "
    "FROM contacts c LEFT JOIN agents a ON a.phone_extension = c.agent_extension",
)
def agent_by_extension(t):
    calls = t.contacts.select("interaction_id", "kind", "agent_extension")
    return idn.agent_by_extension(calls, t.agents).select("interaction_id", "agent_id")


_JOBS = (
    "jobs AS (SELECT interaction_id AS uniqueid, CASE agent_id % 6 WHEN 0 THEN 'discovered' WHEN 1 THEN 'transcribed' WHEN 2 THEN 'asr_failed' "
    "WHEN 3 THEN 'judge_failed' WHEN 4 THEN 'evaluated' ELSE 'dead_letter' END AS status, agent_id % 9 AS retries, "
    "CASE WHEN agent_id % 11 = 0 THEN '{}' ELSE '{\"n\":1}' END AS meta, started_at AS discovered_at, "
    "started_at + INTERVAL 1 DAY AS updated_at FROM contacts)"
)


def _jobs(t):
    status = F.element_at(
        F.array(*[F.lit(s) for s in ("discovered", "transcribed", "asr_failed", "judge_failed", "evaluated", "dead_letter")]),
        (F.col("agent_id") % 6 + 1).cast("int"),
    )
    return t.contacts.select(
        F.col("interaction_id").alias("uniqueid"), status.alias("status"), (F.col("agent_id") % 9).alias("retries"),
        F.when(F.col("agent_id") % 11 == 0, "{}").otherwise('{"n":1}').alias("meta"),
        F.col("started_at").alias("discovered_at"), (F.col("started_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
    )


@query(
    "claim_work",
    cte("contacts") + ", " + _JOBS + " SELECT uniqueid, status, retries, discovered_at FROM jobs WHERE meta <> '{}' AND "
    "(status IN ('discovered', 'transcribed') OR (status IN ('asr_failed', 'judge_failed') AND retries < 5 AND "
    "updated_at < TIMESTAMP '2001-06-01' - INTERVAL 45 MINUTE)) ORDER BY discovered_at, uniqueid LIMIT 25",
)
def claim_work(t):
    return ca.claim_work(_jobs(t), t.as_of).select("uniqueid", "status", "retries", "discovered_at")


@query(
    "seed_jobs",
    cte("contacts", "transcripts") + " SELECT c.interaction_id AS uniqueid, CASE WHEN t.interaction_id IS NULL THEN '' ELSE 'store://' || "
    "t.interaction_id END AS audio_uri, CASE WHEN c.agent_id % 4 = 1 THEN 'evaluated' ELSE 'discovered' END AS status "
    "FROM contacts c LEFT JOIN transcripts t USING (interaction_id) WHERE c.external_source = 'pbx'",
)
def seed_jobs(t):
    audio = t.transcripts.withColumn("audio_uri", F.concat(F.lit("store://"), "interaction_id"))
    return ca.seed_jobs(t.contacts, audio, t.contacts.where("agent_id % 4 = 1"), "pbx")


@query(
    "job_state_fold",
    cte("job_events") + ", l AS (SELECT uniqueid, arg_max(step, event_id) FILTER (WHERE step <> 'discovered') AS step, bool_or(step = 'evaluated') AS done, "
    "count(*) FILTER (WHERE step IN ('asr_failed', 'judge_failed')) AS retries, "
    "arg_max(error, event_id) FILTER (WHERE error IS NOT NULL) AS last_error, max(logged_at) AS updated_at FROM job_events GROUP BY uniqueid) "
    "SELECT uniqueid, CASE WHEN done THEN 'evaluated' WHEN retries >= 5 THEN 'dead_letter' ELSE coalesce(step, 'discovered') END AS status, "
    "retries, last_error, updated_at FROM l",
)
def job_state_fold(t):
    return ca.job_state_fold(t.job_events)


@query(
    "dedup_model_calls",
    cte("judgements") + ", w AS (SELECT 'score' AS purpose, sha256(conversation || chr(0)) AS input_hash, CASE WHEN length(interaction_id) % 2 = 0 "
    "THEN 'v3' END AS prompt_version, interaction_id, CAST(split_part(interaction_id, '-', 4) AS INT) AS agent_no FROM judgements), d AS (SELECT DISTINCT purpose, input_hash, prompt_version FROM w "
    "WHERE agent_no % 3 = 0) SELECT interaction_id, prompt_version FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.purpose = w.purpose "
    "AND d.input_hash = w.input_hash AND d.prompt_version IS NOT DISTINCT FROM w.prompt_version)",
)
def dedup_model_calls(t):
    work = t.judgements.select(
        F.lit("score").alias("purpose"), T.input_hash(F.col("conversation")).alias("input_hash"),
        F.when(F.length("interaction_id") % 2 == 0, "v3").alias("prompt_version"), "interaction_id",
    )
    agent = F.split_part("interaction_id", F.lit("-"), F.lit(4)).cast("int")
    done = work.where(agent % 3 == 0).select("purpose", "input_hash", "prompt_version")
    return idn.dedup_model_calls(work, done).select("interaction_id", "prompt_version")


@query(
    "resolve_deal",
    cte("deals") + ", c AS (SELECT deal_id AS k, 'c' || CAST(deal_id AS STRING) AS conversation_id, "
    "CASE WHEN deal_id % 4 <> 0 THEN customer_phone END AS phone FROM deals), "
    "d AS (SELECT deal_id, CASE WHEN deal_id % 3 = 0 THEN 'c' || CAST(deal_id + 1 AS STRING) END AS conversation_id, "
    "CASE WHEN deal_id % 2 = 0 AND deal_id % 7 < 2 THEN customer_phone END AS phone FROM deals), "
    "p AS (SELECT phone, min(deal_id) AS deal_id, count(*) AS n FROM d WHERE phone IS NOT NULL GROUP BY phone) "
    "SELECT c.conversation_id, CASE WHEN k % 10 = 0 THEN 'e' || CAST(k AS STRING) WHEN k % 10 = 1 THEN 'r' || CAST(k AS STRING) "
    "WHEN k % 10 = 2 THEN 'm' || CAST(k AS STRING) WHEN d.deal_id IS NOT NULL THEN CAST(d.deal_id AS STRING) "
    "WHEN p.n = 1 THEN CAST(p.deal_id AS STRING) END AS deal_id, CASE WHEN k % 10 = 0 THEN 'deal_id on the messages response' "
    "WHEN k % 10 = 1 THEN 'crm_entity_id on the conversation response' WHEN k % 10 = 2 THEN 'deal_id on the message rows' "
    "WHEN d.deal_id IS NOT NULL THEN 'by conversation' WHEN p.n = 1 THEN 'by phone' "
    "WHEN p.n > 1 THEN 'several by phone: ' || CAST(p.n AS STRING) ELSE 'none' END AS route "
    "FROM c LEFT JOIN d ON d.conversation_id = c.conversation_id LEFT JOIN p ON p.phone = c.phone",
)
def resolve_deal(t):
    k = F.col("deal_id")
    text = k.cast("string")
    envelope = F.when(k % 10 == 0, F.concat(F.lit('{"deal_id": "e'), text, F.lit('"}'))).when(
        k % 10 == 2, F.concat(F.lit('{"deal_id": "", "messages": [{"content": "x"}, {"deal_id": "m'), text, F.lit('"}]}'))
    ).otherwise("{}")
    row = F.when(k % 10 == 1, F.concat(F.lit('{"crm_entity_id": "r'), text, F.lit('"}'))).otherwise("{}")
    conversations = t.deals.select(
        F.concat(F.lit("c"), text).alias("conversation_id"),
        F.when(k % 4 != 0, F.col("customer_phone")).alias("phone"),
        F.try_parse_json(envelope).alias("envelope"), F.try_parse_json(row).alias("row"),
    )
    deals = t.deals.select(
        text.alias("deal_id"), k.alias("position"),
        F.when(k % 3 == 0, F.concat(F.lit("c"), (k + 1).cast("string"))).alias("conversation_id"),
        F.when((k % 2 == 0) & (k % 7 < 2), F.col("customer_phone")).alias("phone"),
    )
    return idn.resolve_deal(conversations, deals)
