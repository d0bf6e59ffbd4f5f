"""Validation and weighted scoring of model judgements held as JSON text.

The model's own arithmetic is never used: scores are recomputed from the stored
breakdown. Parsing, scoring and every check read one judgement at a time, so these
are projections over the judgement table without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import rubric as R
from parley.functions import score as S
from parley.functions import text as T

KEY = "interaction_id"
STAGE_ORDER = (
    "reception", "offer_presented", "negotiation", "follow_up", "closing_attempted", "deal_closed",
)


def parsed(judgements: DataFrame, rubric: R.Rubric = R.DEFAULT) -> DataFrame:
    """Judgements with their ``stage_reached``, ``modules``, ``answers``, ``states`` and ``values``
    (one per rubric criterion), the same as ``items``, ``cited`` evidence, ``behavior_flags`` and
    ``top_strength``.

    Scores and messages read the plain arrays; items cost as much again as the parse, and are made
    only where they are asked for.
    """
    kept = [c for c in judgements.columns if c != "payload"]
    read = judgements.select(*kept, S.read(F.col("payload")).alias("__j")).select(
        *kept,
        F.col("__j.stage_reached").alias("stage_reached"),
        F.col("__j.modules").alias("modules"),
        S.answers(F.col("__j.modules"), rubric).alias("answers"),
        F.coalesce(F.col("__j.evidence"), _none("STRUCT<module STRING, criterion STRING, quote STRING>")).alias("cited"),
        F.coalesce(F.col("__j.behavior_flags"), _none("STRING")).alias("behavior_flags"),
        F.col("__j.summary.top_strength").alias("top_strength"),
    )
    given = F.col("answers")
    read = read.withColumns({"states": S.states(given, rubric), "values": S.values(given, rubric)})
    return read.withColumn("items", S.criteria(given, F.col("states"), F.col("values"), rubric))


def _none(kind: str) -> Column:
    return F.expr(f"CAST(array() AS ARRAY<{kind}>)")


def malformed(judgements: DataFrame) -> DataFrame:
    """Replies that are not JSON even without their code fence."""
    return judgements.where(~T.is_json(T.strip_code_fence(F.col("payload"))))


def stored_items() -> Column:
    """The items, named twice, which keeps the optimiser from computing them inside the expression
    that reads them: a generator would repeat the parse of every criterion for each field."""
    return F.when(F.size("items") > 0, F.col("items"))


def explode_breakdown(p: DataFrame) -> DataFrame:
    return p.select(KEY, F.inline(stored_items())).select(
        KEY, "module", "criterion", "cap", "state", "value"
    )


def module_scores(
    p: DataFrame, rubric: R.Rubric = R.DEFAULT, absent_is_full: bool = False
) -> DataFrame:
    """``p`` with one score column per module."""
    return p.select(
        "*", *[S.module_score(F.col("values"), m, absent_is_full, rubric).alias(m) for m in rubric.weights]
    )


def _scores(rubric: R.Rubric) -> dict[str, Column]:
    return {m: F.col(m) for m in rubric.weights}


def final_scores(
    p: DataFrame, rubric: R.Rubric = R.DEFAULT, absent_is_full: bool = False
) -> DataFrame:
    """Weighted score over the modules that were exercised.

    Below the least share of the rubric the result is not gradeable and the score
    null. A judgement whose values the arithmetic cannot take is ``rejected``.
    """
    scored = module_scores(p, rubric, absent_is_full).withColumn("rejected", S.unusable(F.col("states"), F.col("values"), rubric))
    blank = {m: F.when(~F.col("rejected"), F.col(m)) for m in rubric.weights}
    scored = scored.withColumns(blank)
    scored = scored.withColumn("weight_applied", S.weight_applied(_scores(rubric), rubric))
    scored = scored.withColumn(
        "final_score", S.final_score(_scores(rubric), F.col("weight_applied"), rubric)
    )
    return scored.withColumns(
        {
            "gradeable": F.col("final_score").isNotNull(),
            "performance_level": S.performance_level(F.col("final_score")),
        }
    )


def _usable(scored: DataFrame, *columns) -> DataFrame:
    """The columns of the rows that were not rejected.

    Rows are dropped by a generator: a filter would be pushed down to the scan and
    repeat the whole parse there.
    """
    row = F.struct(*columns)
    return scored.select(F.inline(F.when(~F.col("rejected"), F.array(row))))


def rescore_history(judgements: DataFrame, rubric: R.Rubric) -> DataFrame:
    """Scores of stored judgements under another rubric; no model is called."""
    return final_scores(parsed(judgements, rubric), rubric).withColumn(
        "rubric_version", F.lit(rubric.version)
    )


def stated_vs_derived(p: DataFrame, rubric: R.Rubric = R.DEFAULT) -> DataFrame:
    """Modules whose stated score is more than one point off the derived one."""
    scored = module_scores(p, rubric)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("module"),
                S.stated(F.col("modules"), m).alias("stated"),
                F.col(m).alias("derived"),
            )
            for m in rubric.weights
        ]
    )
    return scored.select(KEY, F.inline(rows)).where(F.abs(F.col("stated") - F.col("derived")) > 1.0)


def nullability_violations(p: DataFrame, rubric: R.Rubric = R.DEFAULT) -> DataFrame:
    return p.select(KEY, F.explode(S.present(S.nullability_violations(F.col("states"), rubric))).alias("violation"))


def _violations(rubric: R.Rubric) -> dict[str, list[Column]]:
    """Messages of each check of the contract."""
    states = F.col("states")
    return {
        "nullability": S.nullability_violations(states, rubric),
        "range": S.range_violations(F.col("answers"), states, F.col("values"), rubric),
        "stage": S.stage_violations(F.col("stage_reached"), states, rubric),
    }


def contract_violations(p: DataFrame, rubric: R.Rubric = R.DEFAULT) -> DataFrame:
    """Every reason to ask again rather than repair, labelled by check."""
    def rows(check: str, found: list[Column]) -> Column:
        return F.transform(S.present(found), lambda m: F.struct(F.lit(check).alias("check"), m.alias("violation")))

    return p.select(KEY, F.inline(F.concat(*[rows(check, found) for check, found in _violations(rubric).items()])))


def prompt_consistency(p: DataFrame) -> DataFrame:
    """Rules the prompt states and nothing enforces; an audit, off by default."""
    def answered(*names: str) -> Column:
        return F.exists("items", lambda c: c["criterion"].isin(*names) & c["value"].isNotNull())

    rank = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), F.col("stage_reached"))
    refused = F.array_contains("behavior_flags", "service_refused")
    early = rank < STAGE_ORDER.index("negotiation") + 1
    closing = F.col("stage_reached").isin("closing_attempted", "deal_closed")
    empty_closing = ~F.exists("items", lambda c: (c["module"] == "module5_closing") & c["value"].isNotNull())
    rules = F.array_compact(
        F.array(
            F.when(
                answered("price_objection", "competitor_objection", "thinking_time_objection") & early,
                "objection_before_negotiation",
            ),
            F.when(refused & ~answered("unavailable_service_objection"), "refusal_without_score"),
            F.when(closing & empty_closing, "closing_without_score"),
        )
    )
    return p.select(KEY, F.explode(rules).alias("rule"))


def evidence_problems(p: DataFrame) -> DataFrame:
    return p.select(
        KEY, F.explode(S.evidence_problems(F.col("cited"), F.col("conversation"))).alias("problem")
    )


def uncited_deductions(p: DataFrame, rubric: R.Rubric = R.DEFAULT) -> DataFrame:
    scored = final_scores(p, rubric)
    return scored.select(KEY, F.explode(S.present(S.uncited(F.col("cited"), _scores(rubric)))).alias("warning"))


def merge_warnings(p: DataFrame, rubric: R.Rubric = R.DEFAULT) -> DataFrame:
    """All warnings of a judgement in order: scoring, evidence, deductions, contract."""
    scored = final_scores(p, rubric)
    modules = _scores(rubric)
    thin = F.when(
        ~F.col("gradeable") & ~F.col("rejected"),
        F.concat(
            F.lit("no grade: "), F.format_string("%.0f", F.bround(F.col("weight_applied") * 100, 0)),
            F.lit(f" percent of the weights have a score, {rubric.min_weight * 100:.0f} are needed"),
        ),
    )
    unresolved = [F.concat(F.lit("UNRESOLVED after retry: "), m) for found in _violations(rubric).values() for m in found]
    return scored.select(
        KEY,
        F.concat(
            S.present([*S.stated_warnings(F.col("modules"), modules), thin]),
            S.evidence_problems(F.col("cited"), F.col("conversation")),
            S.present([*S.uncited(F.col("cited"), modules), *unresolved]),
        ).alias("warnings"),
    )


def refusals(transcripts: DataFrame) -> DataFrame:
    """Result rows for transcripts too short to grade."""
    return transcripts.select(
        KEY, T.unscoreable_reason(F.col("transcript")).alias("reason")
    ).where("reason IS NOT NULL").select(
        KEY, F.lit(None).cast("double").alias("final_score"), F.lit(0.0).alias("weight_applied"),
        F.lit(False).alias("gradeable"), "reason",
    )


def as_written_comparison(p: DataFrame, rubric: R.Rubric = R.DEFAULT) -> DataFrame:
    """The older rule beside the present one: what did not arise gets full marks in
    the objection and follow-up modules; the other modules are as they are."""
    def older(m: str) -> Column:
        mine = S.module_score(F.col("values"), m, m in ("module3_objections", "module4_followup"), rubric)
        return mine

    both = final_scores(p, rubric)
    old = {m: older(m) for m in rubric.weights}
    both = both.withColumns({f"old_{m}": c for m, c in old.items()})
    columns = {m: F.col(f"old_{m}") for m in rubric.weights}
    both = both.withColumn("old_weight", S.weight_applied(columns, rubric))
    both = both.withColumn("as_written", S.final_score(columns, F.col("old_weight"), rubric))
    return _usable(
        both,
        KEY, "final_score", "as_written",
        F.bround(F.col("as_written") - F.col("final_score"), 1).alias("inflation"),
    )


def evaluation_report(p: DataFrame, rubric: R.Rubric = R.DEFAULT) -> DataFrame:
    """Report rows: a module row, then its criterion rows, in rubric order."""
    def band(x: Column) -> Column:
        return F.when(x >= 85, "hi").when(x >= 70, "mid").otherwise("lo")

    # one for each criterion, null where its key is missing
    lines, at, position = [], {}, 0
    for i, (module, name, cap, _) in enumerate(rubric.criteria()):
        if module not in at:
            at[module] = (i, position)
            before = F.lit(position + 1)
            position += len(rubric.caps[module]) + 1
        state, value = F.get("states", F.lit(i)), F.get("values", F.lit(i))
        line = F.struct(
            before.alias("position"), F.lit(module).alias("module"), F.lit(name).alias("criterion"),
            F.lit(cap).alias("cap"), value.alias("value"),
            F.when(value.isNull(), "null").when(value == cap, "full").when(value == 0, "zero").otherwise("part").alias("class"),
            F.when(value.isNull(), "not applicable").alias("reason"),
        )
        lines.append(F.when(state != "missing", line))
        before = before + F.when(state == "missing", 0).otherwise(1)

    def module_row(module: str) -> Column:
        score = F.col(module)
        return F.struct(
            F.lit(at[module][1]).alias("position"), F.lit(module).alias("module"),
            F.lit(None).cast("string").alias("criterion"), F.lit(100).alias("cap"), score.alias("value"),
            F.when(score.isNull(), "null").otherwise(band(score)).alias("class"),
            F.when(score.isNull(), "not exercised").alias("reason"),
        )

    scored = final_scores(p, rubric).withColumn("lines", F.array(*lines))
    parts = []
    for module, caps in rubric.caps.items():
        # criteria stand in rubric order, so a module is a slice of their lines
        mine = F.slice("lines", at[module][0] + 1, len(caps))
        parts.append(F.array(module_row(module)))
        parts.append(F.when(F.col(module).isNotNull(), mine).otherwise(F.slice("lines", 1, 0)))
    rows = scored.select(KEY, F.when(~F.col("rejected"), F.concat(*parts)).alias("rows"))
    # the rows are named twice, or the generator would compute them outside generated code
    report = rows.select(KEY, F.inline(F.when(F.size("rows") > 0, F.col("rows"))))
    return report.where("module IS NOT NULL")


SHORT = {
    "module1_reception": "m1_reception", "module2_offer": "m2_offer",
    "module3_objections": "m3_objections", "module4_followup": "m4_followup",
    "module5_closing": "m5_closing",
}


def _evaluation(rubric: R.Rubric) -> list[Column]:
    return [
        F.lit(rubric.version).alias("rubric_version"),
        F.col("final_score").cast("decimal(5,2)").alias("final_score"), F.col("performance_level"),
        F.col("weight_applied").cast("decimal(4,3)").alias("weight_applied"),
        *[F.col(m).cast("decimal(5,2)").alias(s) for m, s in SHORT.items()],
        F.nullif("stage_reached", F.lit("")).alias("stage_reached"),
        F.col("behavior_flags"), F.col("top_strength"),
    ]


def evaluation_columns(scored: DataFrame, rubric: R.Rubric = R.DEFAULT) -> DataFrame:
    """Every scored judgement, rejected ones included, with the columns of the evaluations table."""
    mine = [c for c in scored.columns if c in ("judgement", "rejected")]
    return scored.select(*mine, *_evaluation(rubric))


def stored_evaluations(p: DataFrame, rubric: R.Rubric = R.DEFAULT) -> DataFrame:
    """Rows of the evaluations table, with the short module names it uses."""
    return _usable(final_scores(p, rubric), KEY, "input_type", *_evaluation(rubric))


# Shape of the first-pass answer that later tables read.
_PASS1 = {
    "language": ("language", "string"), "intent": ("intent", "string"),
    "service_raw": ("service_raw", "string"),
    "customer_name": ("customer.name", "string"), "customer_nationality": ("customer.nationality", "string"),
    "residence_city": ("customer.residence_city", "string"),
    "date_start": ("trip.date_start", "date"), "date_end": ("trip.date_end", "date"),
    "nights": ("trip.nights", "int"), "date_flexibility": ("trip.date_flexibility", "string"),
    "travelers_total": ("trip.travelers.total", "int"), "travelers_adults": ("trip.travelers.adults", "int"),
    "travelers_children": ("trip.travelers.children", "int"), "travelers_infants": ("trip.travelers.infants", "int"),
    "group_count": ("trip.group_count", "int"),
    "budget_amount": ("commercial.budget_amount", "decimal(12,2)"),
    "budget_currency": ("commercial.budget_currency", "string"),
    "is_decision_maker": ("commercial.is_decision_maker", "boolean"),
    "summary_ar": ("summary_ar", "string"), "confidence": ("confidence", "decimal(3,2)"),
}
# Members of the enumerations the answer is mapped into.
FLEXIBILITIES = ("fixed", "flexible", "unknown")
SERVICES = (
    "package", "flight", "hotel", "cruise", "visa", "transfer", "insurance", "umrah", "hajj", "other",
)
BUYING_STAGES = ("awareness", "consideration", "decision", "purchased", "lost")
TEMPERATURES = ("hot", "warm", "cold")


def _member(x: Column, values: tuple[str, ...]) -> Column:
    return F.when(x.isin(*values), x).otherwise("unknown")


def project_pass1(analyses: DataFrame) -> DataFrame:
    """Columns of the analysis table; what is no member of an enumeration is unknown.

    Lists (``objections``, ``special_requests``, ``uncertain_fields``) stay JSON text, `[]` where there is none.
    """
    v = analyses.withColumn("v", F.try_parse_json("payload"))
    cols = [F.try_variant_get("v", f"$.{p}", k).alias(n) for n, (p, k) in _PASS1.items()]

    def text(path: str) -> Column:
        return F.try_variant_get("v", f"$.{path}", "string")

    def listed(path: str) -> Column:
        found = F.try_variant_get("v", f"$.{path}", "array<variant>")
        return F.coalesce(F.to_json(found), F.lit("[]"))

    return v.select(
        KEY, *cols,
        listed("commercial.objections").alias("objections"), listed("special_requests").alias("special_requests"),
        listed("uncertain_fields").alias("uncertain_fields"),
        _member(text("service"), SERVICES).alias("service"),
        _member(text("commercial.buying_stage"), BUYING_STAGES).alias("buying_stage"),
        _member(text("commercial.lead_temperature"), TEMPERATURES).alias("lead_temp"),
        "updated_at", "payload",
    ).withColumns({
        "language": F.substring("language", 1, 2), "budget_currency": F.substring("budget_currency", 1, 3),
        "date_flexibility": F.when(F.col("date_flexibility").isin(*FLEXIBILITIES), F.col("date_flexibility")),
    })


def destinations(analyses: DataFrame) -> DataFrame:
    """One row per leg of the trip."""
    legs = F.try_variant_get(
        F.try_parse_json("payload"), "$.trip.destinations",
        "array<struct<name string, role string, leg_order int, nights int>>",
    )
    return analyses.select(KEY, F.inline(legs)).select(
        KEY, F.col("name").alias("raw_name"), "role", "leg_order", "nights"
    )
