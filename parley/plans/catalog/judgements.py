"""Rubric scoring and validation over the judgement table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from parley import rubric
from parley.operators import scoring as sc
from parley.plans.catalog.base import cte, query
from parley.plans.catalog.judgement_sql import EVALUATIONS_SQL, ITEMS_SQL, LEVEL_SQL, SCORES_SQL, SHORT, scores
from parley.session import shared_folder
from parley.sources import scores as kept

_J = cte("judgements") + ", "
_M = list(rubric.WEIGHTS)


@query(
    "explode_breakdown",
    _J + ITEMS_SQL + " SELECT module, criterion, cap, state, count(*) AS n, sum(value) AS points FROM items GROUP BY ALL",
)
def explode_breakdown(t):
    return sc.explode_breakdown(t.parsed).groupBy("module", "criterion", "cap", "state").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("points")
    )


@query("module_scores", _J + SCORES_SQL + " SELECT interaction_id, " + ", ".join(_M) + " FROM scored_raw")
def module_scores(t):
    return sc.module_scores(t.parsed).select("interaction_id", *_M)


@query(
    "final_scores",
    _J + SCORES_SQL + " SELECT interaction_id, rejected, weight_applied, final_score, final_score IS NOT NULL AS gradeable, "
    + LEVEL_SQL + " AS performance_level FROM scored",
)
def final_scores(t):
    return sc.final_scores(t.parsed).select(
        "interaction_id", "rejected", "weight_applied", "final_score", "gradeable", "performance_level"
    )


_SAID = (
    "said AS (SELECT interaction_id, m.module, CAST(json_extract_string(payload, '$.modules.' || m.module || '.score') AS DOUBLE) AS stated "
    "FROM judgements, (VALUES " + ", ".join(f"('{m}')" for m in _M) + ") m(module)), "
    "derived AS (UNPIVOT (SELECT interaction_id, " + ", ".join(_M) + " FROM scored_raw) ON " + ", ".join(_M) + " INTO NAME module VALUE derived)"
)


@query(
    "stated_vs_derived",
    _J + SCORES_SQL + ", " + _SAID + " SELECT interaction_id, module, stated, derived FROM said JOIN derived USING (interaction_id, module) "
    "WHERE abs(stated - derived) > 1.0",
)
def stated_vs_derived(t):
    return sc.stated_vs_derived(t.parsed)


_NULLS = (
    "SELECT interaction_id, 'nullability' AS \"check\", module || '.' || criterion || ': a number up to ' || "
    "CAST(cap AS STRING) || ' is required here, not null' AS violation FROM items WHERE state = 'null' AND NOT may_null"
)
_RANGES = (
    "SELECT interaction_id, 'range' AS \"check\", module || '.' || criterion || ': ' || raw || ' is neither null nor a number up to ' || "
    "CAST(cap AS STRING) AS violation FROM items WHERE state NOT IN ('missing', 'null') AND (state <> 'number' OR value NOT BETWEEN 0 AND cap)"
)
_STAGES = (
    "SELECT j.interaction_id, 'stage' AS \"check\", 'an offer stage (' || (j.payload->>'$.stage_reached') || ') needs a value "
    "for offer_completeness in the offer module' AS violation FROM judgements j JOIN items i USING (interaction_id) "
    "WHERE i.criterion = 'offer_completeness' AND i.state = 'null' AND j.payload->>'$.stage_reached' IN "
    "('offer_presented', 'negotiation', 'closing_attempted', 'deal_closed')"
)


@query("nullability_violations", _J + ITEMS_SQL + " SELECT interaction_id, violation FROM (" + _NULLS + ")")
def nullability_violations(t):
    return sc.nullability_violations(t.parsed)


@query("contract_violations", _J + ITEMS_SQL + " " + " UNION ALL ".join((_NULLS, _RANGES, _STAGES)))
def contract_violations(t):
    return sc.contract_violations(t.parsed)


@query(
    "prompt_consistency",
    _J + ITEMS_SQL + ", f AS (SELECT interaction_id, bool_or(criterion IN ('price_objection', 'competitor_objection', 'thinking_time_objection') "
    "AND value IS NOT NULL) AS objected, bool_or(criterion = 'unavailable_service_objection' AND value IS NOT NULL) AS refusal_scored, "
    "bool_or(module = 'module5_closing' AND value IS NOT NULL) AS closed FROM items GROUP BY 1), "
    "s AS (SELECT f.*, payload->>'$.stage_reached' AS stage, payload->>'$.behavior_flags' AS flags FROM f JOIN judgements USING (interaction_id)) "
    "SELECT interaction_id, 'objection_before_negotiation' AS rule FROM s WHERE objected AND stage IN ('reception', 'offer_presented') "
    "UNION ALL SELECT interaction_id, 'refusal_without_score' FROM s WHERE flags LIKE '%service_refused%' AND NOT refusal_scored "
    "UNION ALL SELECT interaction_id, 'closing_without_score' FROM s WHERE stage IN ('closing_attempted', 'deal_closed') AND NOT closed",
)
def prompt_consistency(t):
    return sc.prompt_consistency(t.parsed)


_FOLD = "translate(trim(regexp_replace({0}, '\\s+', ' ', 'g')), 'أإآٱىة', 'اااايه')"
_PROBLEMS = (
    "cited AS (SELECT interaction_id, conversation, CAST(unnest(range(len(e))) AS INT) AS i, unnest(e) AS e FROM (SELECT interaction_id, conversation, "
    "json_extract(payload, '$.evidence[*]') AS e FROM judgements)), "
    "quoted AS (SELECT interaction_id, i, trim(regexp_replace(e->>'$.quote', '\\s+', ' ', 'g')) AS q, "
    "list_transform(string_split(conversation, '[[ASR_GAP]]'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS spans FROM cited), "
    "problems AS (SELECT interaction_id, i, 'evidence[' || CAST(i AS STRING) || ']: ' || CASE WHEN q = '' THEN 'empty quote' "
    "WHEN q LIKE '%ASR_GAP%' THEN 'quote contains the gap marker' ELSE 'quote not found in conversation: ' || substr(q, 1, 60) END AS problem "
    "FROM quoted WHERE q = '' OR q LIKE '%ASR_GAP%' OR (len(list_filter(spans, lambda s: contains(s, q))) = 0 AND "
    "len(list_filter(spans, lambda s: contains(" + _FOLD.format("s") + ", " + _FOLD.format("q") + "))) = 0))"
)


@query("evidence_problems", _J + _PROBLEMS + " SELECT interaction_id, problem FROM problems")
def evidence_problems(t):
    return sc.evidence_problems(t.parsed)


_UNCITED = (
    "kept AS (UNPIVOT (SELECT interaction_id, " + ", ".join(_M) + " FROM scored) ON " + ", ".join(_M) + " INTO NAME module VALUE score), "
    "uncited AS (SELECT k.interaction_id, k.module, k.module || ': no quote explains ' || printf('%.1f', k.score) AS warning "
    "FROM kept k JOIN judgements j USING (interaction_id) WHERE k.score < 100 AND NOT contains(payload->>'$.evidence', '\"' || k.module || '\"'))"
)


@query("uncited_deductions", _J + SCORES_SQL + ", " + _UNCITED + " SELECT interaction_id, warning FROM uncited")
def uncited_deductions(t):
    return sc.uncited_deductions(t.parsed)


def _place(module: str) -> str:
    return f"list_position([{', '.join(repr(m) for m in _M)}], {module})"


_WARNINGS = (
    "warned AS (SELECT s.interaction_id, 1 AS part, " + _place("module") + " AS place, module || ': stated ' || printf('%.1f', stated) "
    "|| ', summed from its criteria ' || printf('%.1f', derived) || ' (kept)' AS warning "
    "FROM said s JOIN derived d USING (interaction_id, module) JOIN scored k USING (interaction_id) "
    "WHERE abs(stated - derived) > 1.0 AND NOT k.rejected "
    "UNION ALL SELECT interaction_id, 2, 0, 'no grade: ' || printf('%.0f', round_even(weight_applied * 100, 0)) || "
    "' percent of the weights have a score, 40 are needed' FROM scored WHERE final_score IS NULL AND NOT rejected "
    "UNION ALL SELECT interaction_id, 3, i, problem FROM problems "
    "UNION ALL SELECT interaction_id, 4, " + _place("module") + ", warning FROM uncited "
    "UNION ALL SELECT interaction_id, part, place, 'UNRESOLVED after retry: ' || violation FROM ("
    + _NULLS.replace("SELECT ", "SELECT 5 AS part, pos AS place, ", 1) + " UNION ALL "
    + _RANGES.replace("SELECT ", "SELECT 6, pos, ", 1) + " UNION ALL " + _STAGES.replace("SELECT ", "SELECT 7, 0, ", 1)
    + ")), counted AS (SELECT interaction_id, count(*) AS n, string_agg(warning, chr(10) ORDER BY part, place) AS told "
    "FROM warned GROUP BY 1)"
)


@query(
    "merge_warnings",
    _J + SCORES_SQL + ", " + _SAID + ", " + _PROBLEMS + ", " + _UNCITED + ", " + _WARNINGS
    + " SELECT j.interaction_id, coalesce(n, 0) AS warnings, coalesce(told, '') AS told FROM judgements j LEFT JOIN counted USING (interaction_id)",
)
def merge_warnings(t):
    """The number of warnings, and all of them in order, one a line."""
    return sc.merge_warnings(t.parsed).select("interaction_id", F.size("warnings").alias("warnings"), F.array_join("warnings", "\n").alias("told"))


_REVISED = {"module1_reception": 0.10, "module2_offer": 0.30, "module3_objections": 0.25, "module4_followup": 0.20, "module5_closing": 0.15}


@query(
    "rescore_history",
    _J + (ITEMS_SQL + ", " + scores("scored")).replace("module1_reception * 0.15", "module1_reception * 0.1").replace(
        "module2_offer * 0.25", "module2_offer * 0.3").replace(
        "module1_reception IS NOT NULL THEN 0.15", "module1_reception IS NOT NULL THEN 0.1").replace(
        "module2_offer IS NOT NULL THEN 0.25", "module2_offer IS NOT NULL THEN 0.3")
    + " SELECT interaction_id, '1.1.0' AS rubric_version, weight_applied, final_score FROM scored",
)
def rescore_history(t):
    revised = replace(rubric.DEFAULT, weights=_REVISED, version="1.1.0")
    return sc.rescore_history(t.judgements, revised).select("interaction_id", "rubric_version", "weight_applied", "final_score")


@query(
    "stored_scores",
    _J + EVALUATIONS_SQL + " SELECT interaction_id, input_type, final_score, weight_applied, " + ", ".join(SHORT.values()) + " FROM evaluations",
)
def stored_scores(t):
    """Judgements of chats land and are scored first, those of calls in a second commit; all are read from the store."""
    table = kept.store(t.spark, shared_folder(t.spark, "score-store"))
    judgements = t.judgements
    kept.refresh(table, judgements.where("input_type = 'chat'"), 1)
    kept.refresh(table, judgements.where("input_type <> 'chat'"), 2)
    return kept.evaluations(judgements, table).select("interaction_id", "input_type", "final_score", "weight_applied", *SHORT.values())


@query(
    "as_written_comparison",
    _J + SCORES_SQL + ", " + scores("older", ("module3_objections", "module4_followup"))
    + " SELECT s.interaction_id, s.final_score, o.final_score AS as_written, round_even(o.final_score - s.final_score, 1) AS inflation "
    "FROM scored s JOIN older o USING (interaction_id) WHERE NOT s.rejected",
)
def as_written_comparison(t):
    return sc.as_written_comparison(t.parsed)


@query(
    "refusals",
    "SELECT conv_id || '-' || turn AS interaction_id, CAST(NULL AS DOUBLE) AS final_score, 0.0::DOUBLE AS weight_applied, false AS gradeable "
    "FROM conversations WHERE turn % 3 = 0 OR length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) < 20",
)
def refusals(t):
    rows = t.scan("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("interaction_id"), F.when(F.col("turn") % 3 == 0, "[00:00] AGENT: hello there").otherwise(F.col("text")).alias("transcript"),
    )
    return sc.refusals(rows).drop("reason")


def _texts(**paths: str) -> str:
    return ", ".join(f"payload->>'$.{p}' AS {n}" for n, p in paths.items())


def _ints(**paths: str) -> str:
    return ", ".join(f"CAST(payload->>'$.{p}' AS INT) AS {n}" for n, p in paths.items())


@query(
    "project_pass1",
    cte("analyses") + " SELECT interaction_id, substr(payload->>'$.language', 1, 2) AS language, "
    + _texts(intent="intent", service_raw="service_raw", customer_name="customer.name", customer_nationality="customer.nationality",
             residence_city="customer.residence_city", date_start="trip.date_start", date_end="trip.date_end", summary_ar="summary_ar",
             budget_currency="commercial.budget_currency", is_decision_maker="commercial.is_decision_maker")
    + ", " + _ints(nights="trip.nights", travelers_total="trip.travelers.total", travelers_adults="trip.travelers.adults",
                   travelers_children="trip.travelers.children", travelers_infants="trip.travelers.infants", group_count="trip.group_count")
    + ", CASE WHEN payload->>'$.trip.date_flexibility' IN ('fixed', 'flexible', 'unknown') THEN payload->>'$.trip.date_flexibility' END AS date_flexibility, "
    "CAST(payload->>'$.commercial.budget_amount' AS DOUBLE) AS budget_amount, "
    "CAST(payload->'$.commercial.objections' AS VARCHAR) AS objections, CAST(payload->'$.special_requests' AS VARCHAR) AS special_requests, "
    "coalesce(CAST(nullif(payload->'$.uncertain_fields', 'null'::JSON) AS VARCHAR), '[]') AS uncertain_fields, "
    "CASE WHEN payload->>'$.service' IN ('package','flight','hotel','cruise','visa','transfer','insurance','umrah','hajj','other') "
    "THEN payload->>'$.service' ELSE 'unknown' END AS service, "
    "CASE WHEN payload->>'$.commercial.buying_stage' IN ('awareness','consideration','decision','purchased','lost') "
    "THEN payload->>'$.commercial.buying_stage' ELSE 'unknown' END AS buying_stage, payload->>'$.commercial.lead_temperature' AS lead_temp, "
    "CAST(payload->>'$.confidence' AS DOUBLE) AS confidence, updated_at FROM analyses",
)
def project_pass1(t):
    text = {c: F.col(c).cast("string") for c in ("date_start", "date_end", "is_decision_maker")}
    return t.analysed.drop("payload").withColumns(text)


@query(
    "destinations",
    cte("analyses") + " SELECT interaction_id, d->>'$.name' AS raw_name, d->>'$.role' AS role, CAST(d->>'$.leg_order' AS INT) AS leg_order, "
    "CAST(d->>'$.nights' AS INT) AS nights FROM (SELECT interaction_id, unnest(json_extract(payload, '$.trip.destinations[*]')) AS d FROM analyses)",
)
def destinations(t):
    return sc.destinations(t.analyses)


@query(
    "evaluation_report",
    _J + SCORES_SQL + ", m AS (" + " UNION ALL ".join(
        f"SELECT interaction_id, '{m}' AS module, {m} AS value FROM scored WHERE NOT rejected" for m in _M
    ) + ") "
    "SELECT interaction_id, module, CAST(NULL AS VARCHAR) AS criterion, 100 AS cap, value, CASE WHEN value IS NULL THEN 'null' "
    "WHEN value >= 85 THEN 'hi' WHEN value >= 70 THEN 'mid' ELSE 'lo' END AS class FROM m "
    "UNION ALL SELECT i.interaction_id, i.module, i.criterion, i.cap, i.value, CASE WHEN i.value IS NULL THEN 'null' WHEN i.value = i.cap THEN 'full' "
    "WHEN i.value = 0 THEN 'zero' ELSE 'part' END AS class FROM items i JOIN m USING (interaction_id, module) "
    "WHERE m.value IS NOT NULL AND i.state <> 'missing'",
)
def evaluation_report(t):
    return sc.evaluation_report(t.parsed).drop("position", "reason")
