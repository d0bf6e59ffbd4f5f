"""Rollups per customer, agent and deal."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley import rubric
from parley.operators import conversations as co
from parley.operators import identity as idn
from parley.operators import promises as pr
from parley.operators import rollups as ro
from parley.plans.catalog.base import (
    AGENTS_SQL, ANALYSED_SQL, AS_OF_TEXT, FOLLOW_UPS_SQL, ORACLES, cte, query,
)
from parley.plans.catalog.judgement_sql import EVALUATIONS_SQL, SHORT
from parley.plans.catalog.threads import _GAPS, _METRICS

_CHILDREN = {
    "customer_interactions": (
        "SELECT customer_id, count(*) AS interaction_count, "
        "count(*) FILTER (WHERE channel = 'phone_call') AS call_count, "
        "count(*) FILTER (WHERE channel <> 'phone_call') AS chat_count, "
        "min(started_at) AS first_interaction_at, max(started_at) AS last_interaction_at "
        "FROM interactions WHERE customer_id IS NOT NULL GROUP BY customer_id"
    ),
    "customer_deals": (
        "SELECT customer_id, count(*) AS deal_count, "
        "count(*) FILTER (WHERE stage_semantic = 'S') AS won_deal_count, "
        "count(*) FILTER (WHERE stage_semantic = 'F') AS lost_deal_count, "
        "CAST(sum(amount) FILTER (WHERE stage_semantic = 'S') AS DOUBLE) AS lifetime_value, "
        "CAST(sum(amount) FILTER (WHERE stage_semantic = 'P') AS DOUBLE) AS open_pipeline_value "
        "FROM deals WHERE customer_id IS NOT NULL GROUP BY customer_id"
    ),
    "loyalty_balance": (
        "SELECT customer_id, CAST(sum(points) AS BIGINT) AS loyalty_points_balance FROM loyalty_ledger "
        "WHERE customer_id IS NOT NULL GROUP BY customer_id"
    ),
    "active_voucher_value": (
        "SELECT customer_id, CAST(sum(face_value) AS DOUBLE) AS active_voucher_value FROM vouchers "
        "WHERE status = 'active' AND customer_id IS NOT NULL GROUP BY customer_id"
    ),
    "open_followups": (
        "SELECT customer_id, count(*) AS open_follow_ups FROM follow_ups "
        "WHERE status = 'open' AND customer_id IS NOT NULL GROUP BY customer_id"
    ),
    "latest_analysis_per_customer": (
        "SELECT customer_id, lead_temp AS latest_lead_temp, buying_stage AS latest_buying_stage FROM ("
        "SELECT i.customer_id, a.lead_temp, a.buying_stage, row_number() OVER (PARTITION BY i.customer_id "
        "ORDER BY i.started_at DESC, i.interaction_id DESC) AS rn FROM interactions i "
        "JOIN analysed a ON a.interaction_id = i.interaction_id WHERE i.customer_id IS NOT NULL) WHERE rn = 1"
    ),
}


@query("customer_interactions", cte("interactions") + " " + _CHILDREN["customer_interactions"])
def customer_interactions(t):
    return ro.customer_interactions(t.interactions)


@query("customer_deals", cte("deals") + " " + _CHILDREN["customer_deals"])
def customer_deals(t):
    return ro.customer_deals(t.deals)


@query("loyalty_balance", cte("loyalty_ledger") + " " + _CHILDREN["loyalty_balance"])
def loyalty_balance(t):
    return ro.loyalty_balance(t.loyalty_ledger)


@query("active_voucher_value", cte("vouchers") + " " + _CHILDREN["active_voucher_value"])
def active_voucher_value(t):
    return ro.active_voucher_value(t.vouchers)


@query("open_followups", cte("interactions", "promises") + ", " + FOLLOW_UPS_SQL + " " + _CHILDREN["open_followups"])
def open_followups(t):
    return ro.open_followups(t.follow_ups)


@query(
    "latest_analysis_per_customer",
    cte("interactions", "analyses") + ", " + ANALYSED_SQL + " " + _CHILDREN["latest_analysis_per_customer"],
)
def latest_analysis_per_customer(t):
    return ro.latest_analysis_per_customer(t.interactions, t.analysed)


_METRICS_SQL = (
    cte("customers", "interactions", "deals", "loyalty_ledger", "vouchers", "promises", "analyses")
    + ", " + FOLLOW_UPS_SQL + ", " + ANALYSED_SQL + ", "
    + ", ".join(f"{name} AS ({sql})" for name, sql in _CHILDREN.items())
    + " SELECT c.customer_id, "
    + ", ".join(
        f"coalesce({x}, 0) AS {x}" for x in (
            "interaction_count", "call_count", "chat_count", "deal_count", "won_deal_count", "lost_deal_count",
            "lifetime_value", "open_pipeline_value", "loyalty_points_balance", "active_voucher_value",
            "open_follow_ups",
        )
    )
    + ", first_interaction_at, last_interaction_at, latest_lead_temp, latest_buying_stage, "
    f"datediff('day', CAST(last_interaction_at AS DATE), DATE '{AS_OF_TEXT[:10]}') AS days_since_last_contact "
    "FROM customers c "
    + " ".join(f"LEFT JOIN {name} USING (customer_id)" for name in _CHILDREN)
    + " WHERE c.is_merged_into IS NULL"
)


@query("rebuild_customer_metrics", _METRICS_SQL)
def rebuild_customer_metrics(t):
    return ro.rebuild_customer_metrics(
        t.customers, t.interactions, t.deals, t.loyalty_ledger, t.vouchers, t.follow_ups, t.analysed, t.as_of
    )


@query(
    "unmerged_customers",
    cte("customers") + ", hop AS (SELECT c.customer_id, coalesce(c.is_merged_into, c.customer_id) AS one "
    "FROM customers c) SELECT h.customer_id, coalesce(p.is_merged_into, h.one) AS canonical_id, "
    "h.customer_id = h.one AS is_unmerged FROM hop h LEFT JOIN customers p ON p.customer_id = h.one "
    "AND p.is_merged_into IS NOT NULL",
)
def unmerged_customers(t):
    customers = t.customers
    kept = ro.unmerged(customers).select("customer_id", F.lit(True).alias("kept"))
    return ro.canonical_customers(customers).join(kept, "customer_id", "left").select(
        "customer_id", "canonical_id", F.coalesce("kept", F.lit(False)).alias("is_unmerged")
    )


def _avg(column: str, alias: str, digits: int = 1) -> str:
    return f"round(CAST(sum({column}) AS DOUBLE) / count({column}), {digits}) AS {alias}"


@query(
    "agent_scorecard",
    cte("interactions", "agents", "judgements", "messages", "chat_threads") + ", " + AGENTS_SQL + ", " + EVALUATIONS_SQL + ", " + _GAPS + ", " + _METRICS
    + " SELECT a.agent_id, a.full_name, a.team, count(*) AS evaluated_interactions, "
    "count(*) FILTER (WHERE i.channel = 'phone_call') AS calls, "
    "count(*) FILTER (WHERE i.channel <> 'phone_call') AS chats, "
    + ", ".join(
        _avg(f"CAST(e.{c} AS DECIMAL(9,2))", a) for c, a in (
            ("final_score", "avg_score"), ("m1_reception", "avg_reception"), ("m2_offer", "avg_offer"),
            ("m3_objections", "avg_objections"), ("m4_followup", "avg_followup"), ("m5_closing", "avg_closing"),
        )
    )
    + ", count(e.m5_closing) AS n_closing_scored, " + _avg("f.first_response_seconds", "avg_first_response_sec", 0)
    + ", count(*) FILTER (WHERE e.n_flags > 0) AS flagged_conversations "
    "FROM evaluations e JOIN interactions i USING (interaction_id) JOIN people a ON a.agent_id = i.agent_id "
    "LEFT JOIN (SELECT h.interaction_id, m.first_response_seconds FROM chat_threads h "
    "JOIN measured m ON m.interaction_id = h.thread_id) f ON f.interaction_id = e.interaction_id WHERE NOT a.is_bot GROUP BY ALL",
)
def agent_scorecard(t):
    measured = co.response_metrics(co.response_gaps(t.messages)).select(F.col("interaction_id").alias("thread_id"), "first_response_seconds")
    metrics = t.chat_threads.join(measured, "thread_id")
    return ro.agent_scorecard(t.evaluations, t.contacts, t.agents, metrics)


@query(
    "quality_by_input",
    cte("judgements", "transcripts") + ", " + EVALUATIONS_SQL
    + " SELECT e.input_type, t.diarization, CASE WHEN coalesce(t.asr_confidence, 1) >= 1 THEN 6 "
    "ELSE CAST(floor(t.asr_confidence * 5) AS INT) + 1 END AS confidence_bucket, count(*) AS n, "
    + _avg("CAST(e.final_score AS DECIMAL(9,2))", "avg_score")
    + ", round(stddev_pop(e.final_score), 1) AS score_spread FROM evaluations e "
    "LEFT JOIN transcripts t USING (interaction_id) GROUP BY ALL",
)
def quality_by_input(t):
    return ro.quality_by_input(t.evaluations, t.transcripts)


@query(
    "followup_discipline",
    cte("interactions", "promises", "agents") + ", " + FOLLOW_UPS_SQL
    + " SELECT a.agent_id, a.full_name, count(*) AS promises_made, "
    "count(*) FILTER (WHERE f.status = 'fulfilled') AS kept, "
    "count(*) FILTER (WHERE f.status IN ('late', 'missed')) AS broken, "
    f"count(*) FILTER (WHERE f.status = 'open' AND f.due_at < TIMESTAMP '{AS_OF_TEXT}') AS overdue_now, "
    "round(CAST(sum(CAST(f.hours_to_fulfil AS DECIMAL(12,2))) FILTER (WHERE f.status = 'fulfilled') AS DOUBLE) "
    "/ count(*) FILTER (WHERE f.status = 'fulfilled'), 1) AS avg_hours_to_fulfil "
    "FROM follow_ups f JOIN agents a ON a.agent_id = f.agent_id GROUP BY ALL",
)
def followup_discipline(t):
    return ro.followup_discipline(t.follow_ups, t.agents, t.as_of)


@query(
    "funnel",
    cte("deals") + " SELECT category_id, stage_id, stage_semantic, currency, count(*) AS deals, "
    "CAST(sum(amount) AS DOUBLE) AS pipeline_value FROM deals GROUP BY ALL",
)
def funnel(t):
    return ro.funnel(t.deals)


@query(
    "first_seen_by_phone",
    cte("interactions") + " SELECT customer_phone_e164, min(started_at) AS first_seen_at, "
    "max(started_at) AS last_seen_at FROM interactions WHERE customer_phone_e164 IS NOT NULL GROUP BY 1",
)
def first_seen_by_phone(t):
    return ro.first_seen_by_phone(t.interactions)


@query(
    "unnormalised_phone_count",
    cte("interactions") + ", p AS (SELECT channel, customer_phone_raw AS raw, CASE WHEN customer_phone_raw "
    "LIKE '05%' AND agent_id % 6 = 1 THEN NULL ELSE customer_phone_e164 END AS e FROM interactions) "
    "SELECT channel, count(*) FILTER (WHERE raw IS NOT NULL AND e IS NULL) AS unnormalised, "
    "count(raw) AS with_phone FROM p GROUP BY channel",
)
def unnormalised_phone_count(t):
    from parley.functions import phone

    # an Egyptian reading of a Saudi number fails, so some numbers stay raw
    region = F.when((F.col("agent_id") % 6 == 1), "EG").otherwise("SA")
    rows = t.interactions.withColumn(
        "customer_phone_e164", phone.normalize_phone(F.col("customer_phone_raw"), region)["e164"]
    )
    return ro.unnormalised_phone_count(rows)


_ALIASES_SQL = (
    "aliases AS (SELECT n_name AS alias, n_nationkey AS destination_id FROM nation), "
    "legs AS (SELECT i.interaction_id, i.customer_id, d.raw_name, d.leg_order FROM interactions i, "
    "LATERAL (VALUES (' Nation_' || CAST(i.agent_id % 30 AS STRING) || '  ', 1), "
    "('NÀTION_' || CAST(length(i.interaction_id) AS STRING), 2)) d(raw_name, leg_order))"
)
_FOLD_SQL = "trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g'))"


def _legs(t):
    names = F.array(
        F.struct(F.concat(F.lit(" Nation_"), (F.col("agent_id") % 30).cast("string"), F.lit("  ")).alias("raw_name"), F.lit(1).alias("leg_order")),
        F.struct(F.concat(F.lit("NÀTION_"), F.length("interaction_id").cast("string")).alias("raw_name"), F.lit(2).alias("leg_order")),
    )
    return t.interactions.select("interaction_id", "customer_id", F.inline(names))


def _aliases(t):
    return t.scan("nation").select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("destination_id"))


@query(
    "alias_lookup",
    cte("interactions") + ", " + _ALIASES_SQL + " SELECT l.interaction_id, l.leg_order, l.raw_name, "
    "a.destination_id FROM legs l LEFT JOIN aliases a ON " + _FOLD_SQL.format("a.alias") + " = "
    + _FOLD_SQL.format("l.raw_name"),
)
def alias_lookup(t):
    return idn.alias_lookup(_legs(t), _aliases(t)).select("interaction_id", "leg_order", "raw_name", "destination_id")


@query(
    "top_destination",
    cte("interactions") + ", " + _ALIASES_SQL + ", n AS (SELECT l.customer_id, a.destination_id, count(*) AS mentions "
    "FROM legs l JOIN aliases a ON " + _FOLD_SQL.format("a.alias") + " = " + _FOLD_SQL.format("l.raw_name")
    + " WHERE l.customer_id IS NOT NULL GROUP BY ALL) SELECT customer_id, destination_id AS top_destination_id, mentions "
    "FROM n QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY mentions DESC, destination_id) = 1",
)
def top_destination(t):
    return ro.top_destination(idn.alias_lookup(_legs(t), _aliases(t)))


@query(
    "batch_observations",
    "SELECT event_type AS job_name, count(*) AS items_in, count(*) FILTER (WHERE value >= 5) AS items_ok, "
    "count(*) FILTER (WHERE value < 5) AS items_failed, CAST(sum(CAST(value AS DECIMAL(10,2))) AS DOUBLE) AS cost, "
    "CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY event_type",
)
def batch_observations(t):
    ok = F.col("value") >= 5
    runs = t.scan("events").select(
        F.col("event_type").alias("job_name"), F.lit(1).alias("items_in"),
        F.when(ok, 1).otherwise(0).alias("items_ok"), F.when(ok, 0).otherwise(1).alias("items_failed"),
        F.col("value").cast("decimal(10,2)").alias("cost"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
    )
    return ro.batch_observations(runs, ["job_name"])


_MODULES = list(rubric.WEIGHTS)


@query(
    "weight_exercised_distribution",
    cte("judgements") + ", " + EVALUATIONS_SQL + " SELECT input_type, count(*) AS n, "
    + ", ".join(
        f"round_even(CAST(count({s}) AS DOUBLE) / count(*), 4) AS share_{m}"
        for m, s in zip(_MODULES, ("m1_reception", "m2_offer", "m3_objections", "m4_followup", "m5_closing"))
    )
    + ", round_even(CAST(sum(CAST(weight_applied AS DECIMAL(9,3))) AS DOUBLE) / count(*), 4) AS avg_weight "
    "FROM evaluations GROUP BY input_type",
)
def weight_exercised_distribution(t):
    short = {s: m for m, s in SHORT.items()}
    return ro.weight_exercised_distribution(t.evaluations.withColumnsRenamed(short), _MODULES)


@query(
    "consent_current",
    "SELECT user_id AS customer_id, event_type AS kind, value > 20 AS granted, ts AS occurred_at FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
)
def consent_current(t):
    return ro.consent_current(
        t.scan("events").select(
            F.col("user_id").alias("customer_id"), F.col("event_type").alias("kind"),
            (F.col("value") > 20).alias("granted"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("consent_id"),
        )
    )


@query(
    "stage_transitions",
    cte("contacts") + ", h AS (SELECT split_part(interaction_id, '-', 1) AS deal_id, "
    "'C' || CAST(agent_id % 5 AS STRING) AS stage_id, started_at AS changed_at, interaction_id AS move_id FROM contacts), "
    "m AS (SELECT stage_id AS from_stage, lead(stage_id) OVER w AS to_stage, "
    "CAST(epoch(lead(changed_at) OVER w - changed_at) AS BIGINT) AS s FROM h "
    "WINDOW w AS (PARTITION BY deal_id ORDER BY changed_at, move_id)) "
    "SELECT from_stage, to_stage, count(*) AS moves, round(CAST(sum(s) AS DOUBLE) / count(*) / 3600, 2) AS avg_hours "
    "FROM m WHERE to_stage IS NOT NULL GROUP BY ALL",
)
def stage_transitions(t):
    history = t.contacts.select(
        F.split_part("interaction_id", F.lit("-"), F.lit(1)).alias("deal_id"),
        F.concat(F.lit("C"), (F.col("agent_id") % 5).cast("string")).alias("stage_id"),
        F.col("started_at").alias("changed_at"), F.col("interaction_id").alias("move_id"),
    )
    return pr.stage_moves(history)


@query(
    "real_asks",
    cte("analyses", "interactions") + " SELECT i.interaction_id, i.started_at, i.customer_phone_e164, "
    "i.customer_phone_raw, a.payload->>'$.summary_ar' AS summary_ar, "
    "CAST(a.payload->'$.real_ask.products' AS VARCHAR) AS products, "
    "a.payload->>'$.commercial.lead_temperature' AS lead_temperature, "
    "a.payload->>'$.commercial.buying_stage' AS buying_stage, "
    "a.payload->>'$.real_ask.evidence[0].quote' AS evidence_quote, a.updated_at AS analyzed_at "
    "FROM analyses a JOIN interactions i USING (interaction_id) "
    "WHERE a.payload->>'$.real_ask.is_real_inquiry' = 'true' ORDER BY i.started_at DESC",
)
def real_asks(t):
    return ro.real_asks(t.analyses, t.interactions)
