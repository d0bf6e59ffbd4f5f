"""Scores of the judgement table in plain SQL, for the checks."""

from __future__ import annotations

from parley import rubric

SHORT = dict(zip(rubric.WEIGHTS, ("m1_reception", "m2_offer", "m3_objections", "m4_followup", "m5_closing")))


def path(module: str, name: str) -> str:
    return f"'$.modules.{module}.breakdown.{name}'"


_ROWS = ", ".join(
    f"('{m}', '{c}', {cap}, {'true' if f'{m}.{c}' in rubric.NULLABLE else 'false'}, {path(m, c)}, {i})"
    for i, (m, c, cap) in enumerate((m, c, cap) for m, caps in rubric.CAPS.items() for c, cap in caps.items())
)
def half_even(x: str, digits: int) -> str:
    """Half-even rounding of the shortest decimal form of a double."""
    t = f"(CAST(CAST(v AS VARCHAR) AS DECIMAL(38,20)) * {10 ** digits})"
    body = (
        f"CASE WHEN {t} - floor({t}) < 0.5 THEN floor({t}) WHEN {t} - floor({t}) > 0.5 THEN floor({t}) + 1 "
        f"ELSE floor({t}) + CAST(floor({t}) AS BIGINT) % 2 END"
    )
    return f"(list_transform([{x}], lambda v: CAST({body} AS DOUBLE) / {10 ** digits})[1])"


# One row per judgement and criterion.
ITEMS_SQL = (
    f"rub(module, criterion, cap, may_null, jp, pos) AS (VALUES {_ROWS}), "
    "items AS (SELECT j.interaction_id, r.module, r.criterion, r.cap, r.may_null, r.pos, "
    "CASE json_type(j.payload, r.jp) WHEN 'NULL' THEN 'null' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' "
    "WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' ELSE CASE WHEN json_type(j.payload, r.jp) IS NULL "
    "THEN 'missing' ELSE 'other' END END AS state, "
    "CASE WHEN json_type(j.payload, r.jp) IN ('UBIGINT', 'BIGINT', 'DOUBLE') "
    "THEN CAST(json_extract_string(j.payload, r.jp) AS DOUBLE) "
    "WHEN json_type(j.payload, r.jp) = 'BOOLEAN' THEN 1.0::DOUBLE END AS value, "
    "CAST(json_extract(j.payload, r.jp) AS VARCHAR) AS raw FROM judgements j CROSS JOIN rub r)"
)


def _module(m: str, full: bool = False) -> str:
    v = "coalesce(value, cap)" if full else "value"
    return (
        f"round_even(sum({v}) FILTER (WHERE module = '{m}') / "
        f"nullif(CAST(sum(CASE WHEN {v} IS NOT NULL THEN cap END) FILTER (WHERE module = '{m}') AS DOUBLE), 0) * 100, 2)"
    )


def scores(name: str, full: tuple[str, ...] = ()) -> str:
    """Module and final scores per judgement, as CTEs ending in ``name``."""
    cols = ", ".join(f"{_module(m, m in full)} AS {m}" for m in rubric.WEIGHTS)
    weight = " + ".join(f"CASE WHEN {m} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for m, w in rubric.WEIGHTS.items())
    total = " + ".join(f"coalesce({m} * {w}::DOUBLE, 0)" for m, w in rubric.WEIGHTS.items())
    nulled = ", ".join(f"CASE WHEN NOT rejected THEN {m} END AS {m}" for m in rubric.WEIGHTS)
    return (
        f"{name}_raw AS (SELECT interaction_id, {cols}, "
        "bool_or(state = 'other' OR (value IS NOT NULL AND value NOT BETWEEN 0 AND cap)) AS rejected "
        "FROM items GROUP BY interaction_id), "
        f"{name}_ok AS (SELECT interaction_id, rejected, {nulled} FROM {name}_raw), "
        f"{name}_w AS (SELECT *, round_even({weight}, 3) AS weight_applied FROM {name}_ok), "
        f"{name} AS (SELECT *, CASE WHEN weight_applied >= 0.40 THEN {half_even(f"({total}) / weight_applied", 1)} END "
        f"AS final_score FROM {name}_w)"
    )


LEVEL_SQL = (
    "CASE WHEN final_score >= 85 THEN 'Excellent' WHEN final_score >= 70 THEN 'Good' "
    "WHEN final_score >= 55 THEN 'Average' WHEN final_score IS NOT NULL THEN 'Below Average' END"
)
SCORES_SQL = ITEMS_SQL + ", " + scores("scored")
EVALUATIONS_SQL = (
    SCORES_SQL + ", evaluations AS (SELECT s.interaction_id, j.input_type, s.final_score, s.weight_applied, "
    + ", ".join(f"s.{m} AS {s}" for m, s in SHORT.items())
    + ", json_array_length(j.payload, '$.behavior_flags') AS n_flags "
    "FROM scored s JOIN judgements j USING (interaction_id) WHERE NOT s.rejected)"
)
