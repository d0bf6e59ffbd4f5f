"""Per-customer, per-agent and per-deal rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import session

CUSTOMER = "customer_id"


def _linked(df: DataFrame) -> DataFrame:
    """Rows with a customer. Also keeps the null key from becoming a hot group."""
    return df.where(F.col(CUSTOMER).isNotNull())


def _mean(column: str, digits: int = 1) -> Column:
    """Average of decimals, rounded half away from zero."""
    return F.round(F.avg(F.col(column).cast("decimal(20,8)")), digits).cast("double")


def customer_interactions(interactions: DataFrame) -> DataFrame:
    call = F.col("channel") == "phone_call"
    return _linked(interactions).groupBy(CUSTOMER).agg(
        F.count(F.lit(1)).alias("interaction_count"),
        F.count_if(call).alias("call_count"),
        F.count_if(~call).alias("chat_count"),
        F.min("started_at").alias("first_interaction_at"),
        F.max("started_at").alias("last_interaction_at"),
    )


def customer_deals(deals: DataFrame) -> DataFrame:
    def total(semantic: str) -> Column:
        return F.sum(F.when(F.col("stage_semantic") == semantic, F.col("amount")))

    return _linked(deals).groupBy(CUSTOMER).agg(
        F.count(F.lit(1)).alias("deal_count"),
        F.count_if(F.col("stage_semantic") == "S").alias("won_deal_count"),
        F.count_if(F.col("stage_semantic") == "F").alias("lost_deal_count"),
        total("S").alias("lifetime_value"),
        total("P").alias("open_pipeline_value"),
    )


def loyalty_balance(ledger: DataFrame) -> DataFrame:
    return _linked(ledger).groupBy(CUSTOMER).agg(F.sum("points").alias("loyalty_points_balance"))


def active_voucher_value(vouchers: DataFrame) -> DataFrame:
    active = _linked(vouchers).where(F.col("status") == "active")
    return active.groupBy(CUSTOMER).agg(F.sum("face_value").alias("active_voucher_value"))


def open_followups(follow_ups: DataFrame) -> DataFrame:
    open_ = _linked(follow_ups).where(F.col("status") == "open")
    return open_.groupBy(CUSTOMER).agg(F.count(F.lit(1)).alias("open_follow_ups"))


def latest_analysis_per_customer(interactions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Temperature and stage of the newest analysed interaction of each customer.

    An aggregate of the greatest (time, id) instead of a sort per customer, so a
    busy customer is reduced before the shuffle.
    """
    joined = _linked(interactions).select("interaction_id", CUSTOMER, "started_at").join(
        analyses.select("interaction_id", "lead_temp", "buying_stage"), "interaction_id"
    )
    newest = F.max_by(
        F.struct("lead_temp", "buying_stage"), F.struct("started_at", "interaction_id")
    ).alias("a")
    return joined.groupBy(CUSTOMER).agg(newest).select(
        CUSTOMER, F.col("a.lead_temp").alias("latest_lead_temp"),
        F.col("a.buying_stage").alias("latest_buying_stage"),
    )


def unmerged(customers: DataFrame) -> DataFrame:
    return customers.where(F.col("is_merged_into").isNull())


def canonical_customers(customers: DataFrame) -> DataFrame:
    """Surviving id of every customer, at the end of its chain of merge pointers.

    Pointers are doubled until none moves, so a chain of any length takes a number of
    rounds that is the logarithm of its length. ``resolved`` is false on a cycle, where
    no end exists; its ``canonical_id`` is then one of the cycle's members.
    """
    pointers = session.persist(
        customers.where(F.col("is_merged_into").isNotNull() & F.col(CUSTOMER).isNotNull())
        .select(F.col(CUSTOMER).alias("__from"), F.col("is_merged_into").alias("__to")),
        "pointers",
    )
    # a chain without a cycle has at most as many steps as there are pointers
    rounds = pointers.count().bit_length()
    reach = pointers
    for _ in range(rounds):
        ahead = reach.select(F.col("__from").alias("__mid"), F.col("__to").alias("__end"))
        moved = session.persist(
            reach.join(ahead, F.col("__to") == F.col("__mid"), "left")
            .select("__from", F.coalesce("__end", "__to").alias("__to"), F.col("__end").isNotNull().alias("__moved")),
            "pointers",
        )
        reach = moved.select("__from", "__to")
        if moved.where("__moved").isEmpty():
            break
    ends = pointers.select(F.col("__from").alias("__more"))
    return (
        customers.join(reach, F.col(CUSTOMER) == F.col("__from"), "left")
        .select(CUSTOMER, F.coalesce("__to", CUSTOMER).alias("canonical_id"))
        .join(ends, F.col("canonical_id") == F.col("__more"), "left")
        .select(CUSTOMER, "canonical_id", F.col("__more").isNull().alias("resolved"))
    )


def rebuild_customer_metrics(
    customers: DataFrame, interactions: DataFrame, deals: DataFrame, ledger: DataFrame,
    vouchers: DataFrame, follow_ups: DataFrame, analyses: DataFrame, as_of: Column,
) -> DataFrame:
    """The per-customer row. Every child is aggregated before it is joined, so no
    join multiplies rows, and all joins share one partitioning by customer."""
    children = [
        customer_interactions(interactions),
        customer_deals(deals),
        loyalty_balance(ledger),
        active_voucher_value(vouchers),
        latest_analysis_per_customer(interactions, analyses),
        open_followups(follow_ups),
    ]
    out = unmerged(customers).select(CUSTOMER)
    for child in children:
        out = out.join(child, CUSTOMER, "left")
    counts = (
        "interaction_count", "call_count", "chat_count", "deal_count", "won_deal_count", "lost_deal_count",
        "lifetime_value", "open_pipeline_value", "loyalty_points_balance", "active_voucher_value",
        "open_follow_ups",
    )
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts}).withColumn(
        "days_since_last_contact", F.datediff(as_of, "last_interaction_at")
    )


def agent_scorecard(
    evaluations: DataFrame, interactions: DataFrame, agents: DataFrame, metrics: DataFrame | None = None
) -> DataFrame:
    """Scores per human agent. The agents join only by rows that are already
    reduced to one per agent."""
    people = agents.where(~F.col("is_bot"))
    rows = evaluations.join(interactions.select("interaction_id", "agent_id", "channel"), "interaction_id")
    if metrics is None:
        rows = rows.withColumn("first_response_seconds", F.lit(None).cast("int"))
    else:
        rows = rows.join(metrics.select("interaction_id", "first_response_seconds"), "interaction_id", "left")
    call = F.col("channel") == "phone_call"
    per_agent = rows.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("evaluated_interactions"),
        F.count_if(call).alias("calls"),
        F.count_if(~call).alias("chats"),
        _mean("final_score").alias("avg_score"),
        _mean("m1_reception").alias("avg_reception"),
        _mean("m2_offer").alias("avg_offer"),
        _mean("m3_objections").alias("avg_objections"),
        _mean("m4_followup").alias("avg_followup"),
        _mean("m5_closing").alias("avg_closing"),
        F.count("m5_closing").alias("n_closing_scored"),
        _mean("first_response_seconds", 0).alias("avg_first_response_sec"),
        F.count_if(F.size("behavior_flags") > 0).alias("flagged_conversations"),
    )
    return people.select("agent_id", "full_name", "team").join(per_agent, "agent_id")


def confidence_bucket(confidence: Column) -> Column:
    return F.width_bucket(F.coalesce(confidence, F.lit(1.0)), F.lit(0.0), F.lit(1.0), F.lit(5))


def quality_by_input(evaluations: DataFrame, transcripts: DataFrame) -> DataFrame:
    rows = evaluations.join(
        transcripts.select("interaction_id", "diarization", "asr_confidence"), "interaction_id", "left"
    )
    return rows.groupBy(
        "input_type", "diarization", confidence_bucket(F.col("asr_confidence")).alias("confidence_bucket")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        _mean("final_score").alias("avg_score"),
        F.round(F.stddev_pop(F.col("final_score").cast("double")), 1).alias("score_spread"),
    )


def followup_discipline(follow_ups: DataFrame, agents: DataFrame, as_of: Column) -> DataFrame:
    kept = F.col("status") == "fulfilled"
    per_agent = follow_ups.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("promises_made"),
        F.count_if(kept).alias("kept"),
        F.count_if(F.col("status").isin("late", "missed")).alias("broken"),
        F.count_if((F.col("status") == "open") & (F.col("due_at") < as_of)).alias("overdue_now"),
        F.round(F.avg(F.when(kept, F.col("hours_to_fulfil").cast("decimal(20,8)"))), 1).cast("double")
        .alias("avg_hours_to_fulfil"),
    )
    return agents.select("agent_id", "full_name").join(per_agent, "agent_id")


def funnel(deals: DataFrame) -> DataFrame:
    return deals.groupBy("category_id", "stage_id", "stage_semantic", "currency").agg(
        F.count(F.lit(1)).alias("deals"), F.sum("amount").alias("pipeline_value")
    )


def first_seen_by_phone(interactions: DataFrame) -> DataFrame:
    return interactions.where("customer_phone_e164 IS NOT NULL").groupBy("customer_phone_e164").agg(
        F.min("started_at").alias("first_seen_at"), F.max("started_at").alias("last_seen_at")
    )


def unnormalised_phone_count(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("channel").agg(
        F.count_if(
            F.col("customer_phone_raw").isNotNull() & F.col("customer_phone_e164").isNull()
        ).alias("unnormalised"),
        F.count("customer_phone_raw").alias("with_phone"),
    )


def top_destination(legs: DataFrame) -> DataFrame:
    """Most asked-for destination per customer; ties go to the smaller id."""
    counted = legs.where(F.col(CUSTOMER).isNotNull() & F.col("destination_id").isNotNull()).groupBy(
        CUSTOMER, "destination_id"
    ).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("destination_id", "n"), F.struct(-F.col("n"), F.col("destination_id")))
    return counted.groupBy(CUSTOMER).agg(best.alias("b")).select(
        CUSTOMER, F.col("b.destination_id").alias("top_destination_id"), F.col("b.n").alias("mentions")
    )


def batch_observations(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of run-log or model-call rows."""
    return runs.groupBy(*keys).agg(
        F.sum("items_in").alias("items_in"), F.sum("items_ok").alias("items_ok"),
        F.sum("items_failed").alias("items_failed"), F.sum("cost").alias("cost"),
        F.sum("tokens").alias("tokens"),
    )


def weight_exercised_distribution(scored: DataFrame, modules: list[str]) -> DataFrame:
    """Share of conversations that exercised each module, overall and per input."""
    return scored.groupBy("input_type").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.bround(F.count(m) / F.count(F.lit(1)), 4).alias(f"share_{m}") for m in modules],
        F.bround(F.avg(F.col("weight_applied").cast("decimal(20,8)")).cast("double"), 4).alias("avg_weight"),
    )


def consent_current(consents: DataFrame) -> DataFrame:
    """Latest grant per customer and kind."""
    return consents.groupBy(CUSTOMER, "kind").agg(
        F.max_by("granted", F.struct("occurred_at", "consent_id")).alias("granted"),
        F.max("occurred_at").alias("occurred_at"),
    )


def real_asks(analyses: DataFrame, interactions: DataFrame) -> DataFrame:
    """Flagged real inquiries with what was asked and the first quote.

    The flag is tested inside a generator: a filter would be pushed down to the scan and
    parse every answer there once more.
    """
    v = F.col("v")

    def text(path: str, name: str) -> Column:
        return F.try_variant_get(v, f"$.{path}", "string").alias(name)

    row = F.struct(
        text("summary_ar", "summary_ar"),
        F.to_json(F.try_variant_get(v, "$.real_ask.products", "variant")).alias("products"),
        text("commercial.lead_temperature", "lead_temperature"), text("commercial.buying_stage", "buying_stage"),
        text("real_ask.evidence[0].quote", "evidence_quote"), F.col("updated_at").alias("analyzed_at"),
    )
    real = F.try_variant_get(v, "$.real_ask.is_real_inquiry", "boolean")
    asked = analyses.select("interaction_id", "updated_at", F.try_parse_json("payload").alias("v"))
    asked = asked.select("interaction_id", F.inline(F.when(real, F.array(row))))
    found = asked.join(
        interactions.select("interaction_id", "started_at", "customer_phone_e164", "customer_phone_raw"),
        "interaction_id",
    )
    return found.select(
        "interaction_id", "started_at", "customer_phone_e164", "customer_phone_raw", "summary_ar", "products",
        "lead_temperature", "buying_stage", "evidence_quote", "analyzed_at",
    ).orderBy(F.desc("started_at"), "interaction_id")
