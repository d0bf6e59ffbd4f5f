"""Time rules. Every rule that needs the present takes it as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Business hours at the portal, both ends inclusive.
OPENS, CLOSES = 9 * 3600, 21 * 3600
PORTAL_OFFSET_HOURS = 3
DAY_MICROS = 86_400_000_000
HISTORY_DAYS = 14


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def is_after_hours(at: Column, offset_hours: float = PORTAL_OFFSET_HOURS) -> Column:
    shifted = F.unix_micros(at) + F.lit(int(offset_hours * 3600 * 1_000_000))
    of_day = F.pmod(shifted, F.lit(DAY_MICROS))
    return ~of_day.between(OPENS * 1_000_000, CLOSES * 1_000_000)


def hours_between(a: Column, b: Column) -> Column:
    return F.bround(F.abs(F.unix_micros(b) - F.unix_micros(a)) / F.lit(3.6e9), 2)


def days_since(as_of: Column, last: Column) -> Column:
    return F.datediff(as_of, last)


def parse_ts(text: Column) -> Column:
    """ISO instant; no offset means UTC; unreadable text gives null, not now."""
    text = F.btrim(text)
    zoned = text.rlike(r"(?:[+-]\d{2}:?\d{2}|[zZ])$")
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[ T]\d{2}:\d{2})")
    return F.when(
        shaped,
        F.try_to_timestamp(F.when(zoned | (F.length(text) == 10), text).otherwise(F.concat(text, F.lit("Z")))),
    )


def followup_status(
    promised_at: Column, due_at: Column, fulfilled_at: Column, as_of: Column
) -> Column:
    """Row rule: without a due date an unanswered promise stays open."""
    deadline = F.coalesce(due_at, promised_at + F.expr("INTERVAL '24' HOUR"))
    return (
        F.when(fulfilled_at.isNotNull(), F.when(fulfilled_at <= deadline, "fulfilled").otherwise("late"))
        .when(as_of > due_at, "missed")
        .otherwise("open")
    )
