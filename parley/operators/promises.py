"""Promises made to customers, and the contacts that keep or break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import ordered

HOUR = 3600


def materialise_promises(
    analyses: DataFrame, interactions: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Promise rows out of the first-pass answers, without those already stored."""
    promises = F.try_variant_get(
        F.try_parse_json("payload"), "$.promises_made_by_agent",
        "array<struct<promise string, due_hint string>>",
    )
    made = (
        analyses.select("interaction_id", F.inline(promises))
        .join(interactions.where("agent_id IS NOT NULL"), "interaction_id")
        .select(
            F.col("interaction_id").alias("promised_in"), "customer_id", "agent_id",
            F.col("promise").alias("promise_text"), F.col("started_at").alias("promised_at"),
            F.when(
                F.col("due_hint").isNotNull(), F.col("started_at") + F.expr("INTERVAL '24' HOUR")
            ).alias("due_at"),
            "channel",
        )
    )
    if existing is not None:
        made = made.join(existing.select("promised_in", "promise_text"), ["promised_in", "promise_text"], "left_anti")
    return made


def close_promises(
    promises: DataFrame, contacts: DataFrame, as_of: Column,
    grace: str = "24 HOURS", expiry: str = "48 HOURS", hot_rows: int = ordered.HOT_ROWS,
) -> DataFrame:
    """Status of each open promise from the next contact of the same agent with the
    same customer.

    Both sides are put on one time line per (customer, agent) and the next contact
    is carried back along it: linear in the rows, with no pairs formed.
    """
    keys = ["customer_id", "agent_id"]
    contact = F.struct(F.col("started_at").alias("at"), F.col("interaction_id").alias("id"))
    events = contacts.where("customer_id IS NOT NULL AND agent_id IS NOT NULL").select(
        *keys, F.col("started_at").alias("at"), F.lit(0).alias("side"),
        F.col("interaction_id").alias("event_id"), contact.alias("contact"),
        F.lit(None).cast(promises.schema["due_at"].dataType).alias("due_at"),
        F.lit(None).cast(promises.schema["follow_up_id"].dataType).alias("follow_up_id"),
    )
    asks = promises.select(
        *keys, F.col("promised_at").alias("at"), F.lit(1).alias("side"),
        F.col("follow_up_id").cast("string").alias("event_id"),
        F.lit(None).cast(events.schema["contact"].dataType).alias("contact"), "due_at", "follow_up_id",
    )
    # A contact at the very time of a promise sorts before it, so it does not count.
    line = ordered.with_slots(events.unionByName(asks), keys, F.unix_seconds("at"), 60, hot_rows)
    seen = ordered.bare(
        ordered.nearest(line, keys, ["at", "side", "event_id"], F.col("contact"), "next", ahead=True)
    ).where("side = 1")
    fulfilled = F.col("next.at")
    deadline = F.coalesce("due_at", F.col("at") + F.expr(f"INTERVAL {grace}"))
    lapse = F.coalesce("due_at", F.col("at") + F.expr(f"INTERVAL {expiry}"))
    status = (
        F.when(fulfilled <= deadline, "fulfilled")
        .when(fulfilled.isNotNull(), "late")
        .when(lapse < as_of, "missed")
        .otherwise("open")
    )
    micros = F.unix_micros(fulfilled) - F.unix_micros("at")
    return seen.select(
        "follow_up_id", *keys, F.col("at").alias("promised_at"), "due_at",
        F.col("next.id").alias("fulfilled_in"), fulfilled.alias("fulfilled_at"),
        F.round((micros / F.lit(1_000_000)).cast("decimal(20,6)") / F.lit(HOUR).cast("decimal(10,0)"), 2)
        .cast("decimal(12,2)").alias("hours_to_fulfil"),
        status.alias("status"),
    )


def followup_history(
    calls: DataFrame, contacts: DataFrame, agents: DataFrame, days: int = 14
) -> DataFrame:
    """Later contacts of the same phone within ``days``, as text lines in order.

    The join key is (phone, period): a call meets the contacts of its own period and
    the next, so a busy phone is spread over its periods and never gathered whole.
    The text itself names every later contact, so its size is that of the result.
    """
    width = days * 86_400_000_000
    phone = "customer_phone_e164"
    period = F.floor(F.unix_micros("started_at") / F.lit(width))
    asked = calls.where(f"{phone} IS NOT NULL").select(
        F.col("interaction_id").alias("call_id"), phone, F.col("started_at").alias("call_at"),
        F.explode(F.array(period, period + 1)).alias("period"),
    )
    later = contacts.where(f"{phone} IS NOT NULL").select(
        phone, period.alias("period"), "started_at", "interaction_id", "channel", "agent_id"
    )
    names = agents.select("agent_id", "full_name")
    after = F.unix_micros("started_at") - F.unix_micros("call_at")
    pairs = (
        asked.join(later, [phone, "period"])
        .where((after > 0) & (after < width))
        .join(names, "agent_id", "left")
    )
    hours = F.round((after / F.lit(1_000_000)).cast("decimal(20,6)") / F.lit(HOUR).cast("decimal(10,0)"), 1)
    line = F.concat(
        F.lit("  - ["), F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), F.lit("+00] "), F.col("channel"),
        F.lit(" by "), F.coalesce("full_name", F.lit("unknown")), F.lit(", "),
        hours.cast("decimal(12,1)").cast("string"), F.lit("h after this call"),
    )
    text = pairs.groupBy("call_id").agg(
        F.array_sort(F.collect_list(F.struct("started_at", "interaction_id", line.alias("line")))).alias("l")
    ).select("call_id", F.array_join(F.col("l.line"), "\n").alias("history"))
    return calls.select(F.col("interaction_id").alias("call_id")).join(text, "call_id", "left").select(
        "call_id", F.coalesce("history", F.lit("")).alias("history")
    )


def followup_module(
    calls: DataFrame, contacts: DataFrame, as_of: Column, days: int = 14, hot_rows: int = ordered.HOT_ROWS
) -> DataFrame:
    """The countable part of the follow-up module: how soon and how often.

    Every call is kept. Its scores are null where no contact followed or no phone is
    known; ``window_over`` says whether more contacts could still count at ``as_of``.

    The number of contacts in (t, t + days) is a difference of two running counts
    on the phone's time line, and the first of them is the next contact: linear in
    the rows, where a range join would form every pair.
    """
    phone = "customer_phone_e164"
    width = F.expr(f"INTERVAL '{days}' DAY")
    none_at = F.lit(None).cast("timestamp")
    known = contacts.where(f"{phone} IS NOT NULL")
    asks = calls.where(f"{phone} IS NOT NULL")

    # Ties: a window opens after the contacts of its instant and closes before them.
    def marks(df: DataFrame, at: Column, side: int, contact: Column) -> DataFrame:
        return df.select(
            phone, at.alias("at"), F.lit(side).alias("side"), "interaction_id", contact.alias("contact_at")
        )

    line = (
        marks(asks, F.col("started_at") + width, 0, none_at)
        .unionByName(marks(known, F.col("started_at"), 1, F.col("started_at")))
        .unionByName(marks(asks, F.col("started_at"), 2, none_at))
    )
    slots = ordered.with_slots(line, [phone], F.unix_seconds("at"), 60, hot_rows)
    order = ["at", "side", "interaction_id"]
    is_contact = (F.col("side") == 1).cast("long")
    counted = ordered.running_sum(slots, [phone], order, is_contact, "seen")
    ahead = ordered.nearest(counted, [phone], order, F.col("contact_at"), "next_at", ahead=True)
    per_call = ordered.bare(ahead).where("side <> 1").groupBy("interaction_id").agg(
        (
            F.max(F.when(F.col("side") == 0, F.col("seen"))) - F.max(F.when(F.col("side") == 2, F.col("seen")))
        ).alias("followup_count"),
        F.max(F.when(F.col("side") == 2, F.col("at"))).alias("asked_at"),
        F.max(F.when(F.col("side") == 2, F.col("next_at"))).alias("next_at"),
    )
    hours = (F.unix_micros("next_at") - F.unix_micros("asked_at")) / F.lit(3.6e9)
    n = F.col("followup_count")
    counted_calls = per_call.select(
        "interaction_id", "followup_count",
        F.when(n > 0, F.bround(hours, 2)).alias("hours_to_first_followup"),
        # without any later contact the module is not available, which is no score of zero
        F.when(n > 0, F.when(hours <= 24, 40).when(hours <= 48, 20).otherwise(0)).alias("timing"),
        F.when(n >= 2, 30).when(n == 1, 15).alias("frequency"),
        F.lit(None).cast("int").alias("message_quality"),
    )
    ends = calls.select("interaction_id", F.coalesce(F.col("started_at") + width <= as_of, F.lit(False)).alias("window_over"))
    return ends.join(counted_calls, "interaction_id", "left")


def stage_moves(history: DataFrame, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """Counts and mean dwell of moves from stage to stage within a deal."""
    order = ["changed_at", "move_id"]
    slots = ordered.with_slots(history, ["deal_id"], F.unix_seconds("changed_at"), 60, hot_rows)
    nxt = F.struct(F.col("stage_id").alias("stage"), F.col("changed_at").alias("at"))
    moved = ordered.bare(ordered.nearest(slots, ["deal_id"], order, nxt, "next", ahead=True))
    seconds = F.unix_seconds("next.at") - F.unix_seconds("changed_at")
    return (
        moved.where("next IS NOT NULL")
        .groupBy(F.col("stage_id").alias("from_stage"), F.col("next.stage").alias("to_stage"))
        .agg(
            F.count(F.lit(1)).alias("moves"),
            F.round(F.avg((seconds / F.lit(HOUR)).cast("decimal(20,8)")), 2).cast("double").alias("avg_hours"),
        )
    )
