"""Constraint audits over the logical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import payload as P
from parley.operators import audits as au
from parley.operators import scoring as sc
from parley.operators import calls as ca
from parley.plans.catalog.base import cte, query
from parley.plans.catalog.judgement_sql import ITEMS_SQL
from parley.sources import payloads as pl


@query(
    "unique_violations",
    cte("contacts") + ", k AS (SELECT split_part(interaction_id, '-', 1) AS a, split_part(interaction_id, '-', 2) AS b FROM contacts) "
    "SELECT a AS order_ref, b AS line_ref, count(*) AS copies FROM k GROUP BY a, b HAVING count(*) > 1",
)
def unique_violations(t):
    part = lambda i: F.split_part("interaction_id", F.lit("-"), F.lit(i))
    keys = t.contacts.select(part(1).alias("order_ref"), part(2).alias("line_ref"))
    return au.unique_violations(keys, ["order_ref", "line_ref"])


@query(
    "orphan_keys",
    cte("loyalty_ledger", "vouchers") + " SELECT customer_id, count(*) AS n_rows FROM loyalty_ledger l WHERE customer_id IS NOT NULL "
    "AND NOT EXISTS (SELECT 1 FROM vouchers v WHERE v.customer_id = l.customer_id AND v.status = 'active') GROUP BY customer_id",
)
def orphan_keys(t):
    active = t.vouchers.where("status = 'active'").select("customer_id").distinct()
    return au.orphan_keys(t.loyalty_ledger, active, "customer_id", "customer_id")


@query(
    "check_violations",
    cte("interactions") + ", r AS (SELECT interaction_id AS row_key, channel IN ('whatsapp','facebook','instagram','telegram','webchat','email','other') "
    "AS channel_ok, regexp_matches(customer_phone_raw, '^\\+[1-9][0-9]{6,14}$') AS phone_ok FROM interactions) "
    "SELECT row_key, 'channel' AS rule FROM r WHERE NOT channel_ok UNION ALL SELECT row_key, 'phone_is_e164' FROM r WHERE NOT phone_ok",
)
def check_violations(t):
    # calls fail a list of chat channels; raw numbers fail the pattern of clean ones
    chats = [c for c in au.CHANNELS if c != "phone_call"]
    rules = {
        "channel": F.col("channel").isin(*chats),
        "phone_is_e164": F.col("customer_phone_raw").rlike(r"^\+[1-9][0-9]{6,14}$"),
    }
    return au.check_violations(t.interactions, F.col("interaction_id"), rules)


@query(
    "voucher_state_violations",
    cte("vouchers") + " SELECT status, count(*) AS n FROM vouchers WHERE status NOT IN ('active','redeemed','expired','cancelled') GROUP BY status",
)
def voucher_state_violations(t):
    bad = au.check_violations(t.vouchers, F.col("status"), {"status": F.col("status").isin(*au.VOUCHER_STATES)})
    return bad.groupBy(F.col("row_key").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "range_violations",
    cte("judgements") + ", " + ITEMS_SQL + " SELECT interaction_id AS row_key, 'price_objection' AS rule FROM items "
    "WHERE criterion = 'price_objection' AND value NOT BETWEEN 0 AND 25",
)
def range_violations(t):
    rows = t.parsed.select(
        "interaction_id",
        F.get(F.filter(sc.stored_items(), lambda c: c["criterion"] == "price_objection"), F.lit(0))["value"].alias("price_objection"),
    )
    return au.range_violations(rows, F.col("interaction_id"), {"price_objection": (0, 25)})


@query(
    "clock_drift_report",
    cte("recordings") + ", p AS (SELECT file_id, regexp_extract(regexp_replace(name, '\\s*\\([0-9]+\\)\\.', '.'), "
    "'^([a-z]+)-([0-9]+)-([0-9]+)-([0-9]{8})-([0-9]{6})-([0-9.]+)\\.wav$', ['kind','ext','number','d','t','u']) AS x FROM recordings), "
    "s AS (SELECT file_id, x.u AS uniqueid, strptime(x.d || x.t, '%Y%m%d%H%M%S') - INTERVAL 3 HOUR AS started_at FROM p WHERE x.u <> '') "
    "SELECT uniqueid, file_id, started_at, abs(CAST(split_part(uniqueid, '.', 1) AS BIGINT) - CAST(epoch(started_at) AS BIGINT)) AS clock_drift_seconds "
    "FROM s WHERE abs(CAST(split_part(uniqueid, '.', 1) AS BIGINT) - CAST(epoch(started_at) AS BIGINT)) > 5",
)
def clock_drift_report(t):
    return ca.clock_drift_report(ca.decode_recording_name(t.recordings))


@query(
    "denied_field_leaks",
    cte("payloads") + " SELECT count(*) AS leaks_before, 0 AS leaks_after FROM payloads WHERE contains(payload, 'UF_CRM_1781281581')",
)
def denied_field_leaks(t):
    rows = pl.first_element(t.payloads).select(F.coalesce(P.get(F.col("v"), "body"), F.col("v")).alias("b")).select(
        F.try_variant_get(P.pick(F.col("b"), *P.DEAL_KEYS), "$", "map<string,string>").alias("fields")
    )
    both = rows.select("fields", P.safe_deal_fields(F.col("fields")).alias("safe"))
    leaks = lambda c: F.coalesce(F.map_contains_key(c, P.DEAL_DENIED[0]), F.lit(False))
    return both.agg(
        F.count_if(leaks("fields")).alias("leaks_before"), F.count_if(leaks("safe")).cast("int").alias("leaks_after")
    )
