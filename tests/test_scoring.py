import json

import pytest

from parley import rubric
from parley.operators import scoring as sc
from parley.sources import payloads

M = list(rubric.WEIGHTS)


def judgement(**over):
    modules = {m: {"breakdown": dict(c)} for m, c in rubric.CAPS.items()}
    for key, value in over.items():
        module = next(m for m in modules if m.endswith(key.split("__")[0]))
        if "__" in key:
            modules[module]["breakdown"][key.split("__")[1]] = value
        else:
            modules[module]["breakdown"] = value
    return modules


def run(spark, modules, **rest):
    df = spark.createDataFrame(
        [("i", "chat", rest.pop("conversation", ""), json.dumps({"modules": modules, **rest}))],
        "interaction_id string, input_type string, conversation string, payload string",
    )
    return sc.parsed(df)


def nothing(module):
    return {c: None for c in rubric.CAPS[module]}


PARTIAL = dict(
    reception=dict(zip(rubric.CAPS[M[0]], (25, 25, 25, 15))),
    offer=dict(attitude=20, offer_completeness=None, value_selling=20, alternative_offer=None),
    objections=nothing(M[2]), followup=nothing(M[3]), closing=nothing(M[4]),
)


def test_full_marks(spark):
    r = sc.final_scores(run(spark, judgement())).first()
    assert (r.final_score, r.weight_applied, r.performance_level) == (100.0, 1.0, "Excellent")


def test_what_did_not_arise_is_left_out(spark):
    r = sc.final_scores(run(spark, judgement(**PARTIAL))).first()
    assert [r[m] for m in M] == [90.0, 80.0, None, None, None]
    assert (r.final_score, r.weight_applied, r.performance_level) == (83.8, 0.4, "Good")


def test_too_little_of_the_rubric(spark):
    only = {**PARTIAL, "offer": nothing(M[1])}
    r = sc.final_scores(run(spark, judgement(**only))).first()
    assert (r.final_score, r.gradeable, r.rejected) == (None, False, False)
    assert "no grade: 15 percent of the weights" in " ".join(sc.merge_warnings(run(spark, judgement(**only))).first().warnings)


def test_as_originally_written(spark):
    older = {**PARTIAL, "offer": dict(attitude=20, offer_completeness=0, value_selling=20, alternative_offer=25)}
    r = sc.as_written_comparison(run(spark, judgement(**older))).first()
    assert r.as_written == 87.9


@pytest.mark.parametrize("value", [50, -5, "25", {"a": 1}])
def test_values_out_of_range_are_rejected(spark, value):
    p = run(spark, judgement(objections__price_objection=value))
    assert sc.final_scores(p).first().rejected
    assert [r.check for r in sc.contract_violations(p).collect()] == ["range"]


def test_a_boolean_is_reported_but_counts_as_a_number(spark):
    p = run(spark, judgement(objections__price_objection=True))
    assert not sc.final_scores(p).first().rejected
    assert [r.check for r in sc.contract_violations(p).collect()] == ["range"]


def test_null_and_missing_differ(spark):
    p = run(spark, judgement(offer__value_selling=None))
    assert [r.check for r in sc.contract_violations(p).collect()] == ["nullability"]
    gone = judgement()
    del gone[M[1]]["breakdown"]["value_selling"]
    assert sc.contract_violations(run(spark, gone)).count() == 0


def test_stage_must_agree_with_the_offer(spark):
    p = run(spark, judgement(offer__offer_completeness=None), stage_reached="offer_presented")
    assert [r.check for r in sc.contract_violations(p).collect()] == ["stage"]


@pytest.mark.parametrize(
    "quote,bad",
    [("سأل عن السعر", False), ("سال  عن السعر", False), ("عن السعر الموظف قال", True), ("السعر [[ASR_GAP]] الموظف", True), (" ", True)],
)
def test_quotes_lie_inside_one_span(spark, quote, bad):
    p = run(spark, judgement(), evidence=[{"module": M[0], "quote": quote}],
            conversation="العميل سأل عن السعر [[ASR_GAP]] الموظف قال مع السلامة")
    assert (sc.evidence_problems(p).count() == 1) is bad


def test_levels(spark):
    from pyspark.sql import functions as F

    from parley.functions.score import performance_level

    df = spark.createDataFrame([(x,) for x in (85.0, 84.9, 70.0, 69.9, 55.0, 54.9)], "x double")
    got = [r.l for r in df.select(performance_level(F.col("x")).alias("l")).collect()]
    assert got == ["Excellent", "Good", "Good", "Average", "Average", "Below Average"]


def landed(spark, *rows):
    return spark.createDataFrame(rows, "interaction_id string, input_type string, conversation string, payload string")


def test_scores_are_kept_by_text_and_rubric(spark, tmp_path, monkeypatch):
    from dataclasses import replace

    from parley.sources import scores

    good, full = (json.dumps({"modules": judgement(**x), "stage_reached": "negotiation"}) for x in (PARTIAL, {}))
    bad = json.dumps({"modules": judgement(reception__greeting="many")})
    first = landed(spark, ("a", "chat", "", good), ("b", "chat", "", good), ("c", "chat", "", bad), ("n", "chat", "", None))
    both = first.union(landed(spark, ("d", "call_transcript", "", full), ("e", "chat", "", "{broken")))
    table = scores.store(spark, f"{tmp_path}/scores", buckets=4)
    assert scores.evaluations(first, table).count() == 0
    assert scores.refresh(table, first, 1) == 3  # equal texts are one
    assert scores.refresh(table, both, 1) == 0  # the commit is already in
    assert scores.refresh(table, both, 2) == 2 and scores.refresh(table, both, 3) == 0
    got = {r.interaction_id: r for r in scores.evaluations(both, table).collect()}
    want = {r.interaction_id: r for r in sc.stored_evaluations(sc.parsed(both)).collect()}
    assert set(got) == {"a", "b", "d", "e", "n"} and {k: r.asDict() for k, r in got.items()} == {k: r.asDict() for k, r in want.items()}
    # stored texts are not parsed again
    seen = []
    monkeypatch.setattr(sc, "parsed", lambda df, r, real=sc.parsed: seen.append(df.count()) or real(df, r))
    scores.refresh(table, both, 4)
    revised = replace(rubric.DEFAULT, weights={**rubric.WEIGHTS, M[0]: 0.05, M[1]: 0.35}, version="9")
    assert scores.refresh(table, both, 5, revised) == 5 and seen == [0, 5]
    monkeypatch.undo()
    other = {r.interaction_id: r for r in scores.evaluations(both, table, revised).collect()}
    assert other["a"].rubric_version == "9" and other["a"].final_score != got["a"].final_score
    assert {r.interaction_id: r.final_score for r in scores.evaluations(both, table).collect()} == {k: r.final_score for k, r in got.items()}
    # rewritten as one folder a bucket, the rows stay; an older version reads on
    before = table.read().count()
    assert table.compact() > 0 and table.compact() == 0 and table.read().count() == before == 10
    assert scores.evaluations(both, table, version=1).count() == 3


def test_the_parse_is_planned_once_under_generators(spark):
    """An inferred filter or an inlined list of items would repeat the parse in the plan."""
    payloads_ = spark.createDataFrame([(1, '{"id": "a", "messages": [{"message": "hi", "sender": "client"}]}')], "arrival_id long, payload string")
    rows = payloads.messages_of(payloads.parse_chats(payloads_)).drop("body_hash")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter " not in plan and [r.body for r in rows.collect()] == ["hi"]
    judged = spark.createDataFrame([("a", '{"modules": {"module1_reception": {"breakdown": {"greeting": 1}}}}', "x")], "interaction_id string, payload string, conversation string")
    rows = sc.explode_breakdown(sc.parsed(judged)).groupBy("state").count()
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") < 5
    assert {r.state for r in rows.collect()} >= {"missing"}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_quote_is_cleaned_once(spark):
    cited = [{"module": M[0], "quote": q} for q in ("  said   it ", "never", " ", "الرحله إلي مكه", "a ASR_GAP b")] + [{"module": M[1]}]
    p = run(spark, judgement(), conversation="well said it [[ASR_GAP]] الرحلة إلى مكة", evidence=cited)
    found = sc.evidence_problems(p)
    assert sorted(r.problem for r in found.collect()) == [
        "evidence[1]: quote not found in conversation: never", "evidence[2]: empty quote",
        "evidence[4]: quote contains the gap marker", "evidence[5]: empty quote",
    ]
    # the spans plain and folded, the quote plain and folded
    assert plan(found).count("regexp_replace") <= 4


def test_an_answer_is_read_once(spark):
    p = run(spark, judgement(reception__greeting=True, offer__attitude="25", closing__thank_you=2.5))
    items = {i.criterion: (i.state, i.value) for i in p.first()["items"]}
    assert items["greeting"] == ("boolean", 1.0) and items["attitude"] == ("other", None) and items["thank_you"] == ("number", 2.5)
    assert plan(p.select("items")).count("try_variant_get") == len(list(rubric.DEFAULT.criteria()))


def test_report_reads_a_module_from_its_slice(spark):
    modules = judgement(reception__greeting=5, offer=nothing(M[1]))
    del modules[M[0]]["breakdown"]["understanding_confirmation"]
    report = sc.evaluation_report(run(spark, modules))
    rows = sorted((r.position, r.module, r.criterion, r["class"]) for r in report.collect() if r.module in M[:2] and r.criterion)
    assert rows == [
        (1, M[0], "greeting", "part"), (2, M[0], "missing_info_request", "full"), (3, M[0], "next_step_transition", "full"),
    ]
    assert plan(report).count("slice(") >= len(M)


def test_one_decimal_is_rounded_by_the_binary_value(spark):
    from pyspark.sql import functions as F

    from parley.functions import score as S

    numbers = [36.25, 36.75, 36.45, 36.15, 36.35, 0.0, 100.0, 99.95, 99.96, -36.25, 12.5, 2.675, 8.05]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", S.one_decimal(F.col("x")).alias("t"))
    assert {r.x: r.t for r in df.collect()} == {x: f"{x:.1f}" for x in numbers}


def test_all_warnings_are_told_in_order(spark, tmp_path):
    from parley.plans import catalog

    modules = judgement(closing=dict(payment_request=20, next_steps_confirmation=9, booking_steps=0, service_review_request=0), offer__value_selling=None)
    modules[M[4]]["score"] = 90
    modules[M[1]]["score"] = 98.5
    p = run(spark, modules, stage_reached="negotiation", evidence=[{"module": M[0], "quote": "never"}])
    assert sc.merge_warnings(p).first().warnings == [
        f"{M[1]}: stated 98.5, summed from its criteria 100.0 (kept)", f"{M[4]}: stated 90.0, summed from its criteria 36.2 (kept)",
        "evidence[0]: quote not found in conversation: never", f"{M[4]}: no quote explains 36.2",
        f"UNRESOLVED after retry: {M[1]}.value_selling: a number up to 25 is required here, not null",
    ]
    spark.range(40).selectExpr(
        "id AS l_orderkey", "id * 7 AS l_partkey", "id % 5 AS l_suppkey", "CAST(id % 7 AS INT) AS l_linenumber"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalog.QUERIES["merge_warnings"](spark, str(tmp_path)).collect()
    assert len(rows) == 40 and all((len(r.told.split("\n")) if r.told else 0) == r.warnings for r in rows)
    assert any("stated" in r.told and "UNRESOLVED" in r.told for r in rows)


def test_scores_and_messages_make_no_items(spark):
    p = run(spark, judgement(**PARTIAL), evidence=[])
    # items would carry every answer with its names; lambdas over them run outside generated code
    for df in (sc.final_scores(p).select("final_score", "rejected"), sc.evaluation_report(p), sc.uncited_deductions(p)):
        assert "nullable" not in plan(df) and "exists(" not in plan(df) and "lambda" not in plan(df)
    assert {i.criterion: i.state for i in p.first()["items"]}["timing"] == "null"
