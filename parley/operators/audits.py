"""Constraints of the tables as queries that return the rows breaking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import payload as P

# Members of the closed lists.
CHANNELS = ("whatsapp", "facebook", "instagram", "telegram", "webchat", "phone_call", "email", "other")
SENDERS = ("customer", "agent", "bot", "system", "unknown")
VOUCHER_STATES = ("active", "redeemed", "expired", "cancelled")
LEVELS = ("Excellent", "Good", "Average", "Below Average")


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values held by more than one row; null keys never collide."""
    kept = df.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    return kept.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def orphan_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent, with their number of rows.

    The child is reduced to its distinct keys first, so a hot key is one row in
    the join.
    """
    held = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return held.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def check_violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """Rows failing named predicates; as in SQL, an unknown result passes. One pass
    over the table serves all rules."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(key.cast("string").alias("row_key"), F.explode(failed).alias("rule"))


def range_violations(df: DataFrame, key: Column, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    rules = {c: F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()}
    return check_violations(df, key, rules)


def denied_field_leaks(df: DataFrame, fields: str) -> DataFrame:
    """Rows whose field map still holds a denied field."""
    leak = F.lit(False)
    for name in P.DEAL_DENIED:
        leak = leak | F.map_contains_key(fields, name)
    return df.where(leak)
