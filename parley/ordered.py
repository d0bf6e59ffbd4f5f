"""Ordered computations per key that survive a hot key.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. Here a
key holding many rows is cut into slots of its ordering column: rows are windowed
inside (key, slot), each slot is reduced to one summary row, and the summaries
carry values across slots. Keys below the threshold stay in one slot, so on even
data the plan is a single window over one shuffle plus a count of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = "__slot"
HOT = "__hot"
HOT_ROWS = 1_000_000
# A hot key holds at least 1/MAX_HOT of all rows, so there are at most MAX_HOT.
MAX_HOT = 50_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys holding at least ``hot_rows`` rows; at most ``MAX_HOT`` of them.

    The counts are combined map-side, so the shuffle carries one row per key and
    task. The bound on the number of keys is what makes broadcasting them safe.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    floor = F.greatest(F.lit(hot_rows).cast("double"), total / F.lit(float(MAX_HOT)))
    return counts.where(F.col("__n") >= floor).select(*keys)


# the slot of rows without a time: nulls sort first, and last in descending order
NO_TIME = -(2**62)


def _joined(df: DataFrame, other: DataFrame, keys: list[str], exact: tuple[str, ...] = ()) -> DataFrame:
    """Left join on ``keys``, where null equals null, and on the ``exact`` columns."""
    names = [*keys, *exact]
    other = other.withColumnsRenamed({n: f"__o_{n}" for n in names})
    on = F.lit(True)
    for n in keys:
        on = on & F.col(n).eqNullSafe(F.col(f"__o_{n}"))
    for n in exact:
        on = on & (F.col(n) == F.col(f"__o_{n}"))
    return df.join(other, on, "left").drop(*(f"__o_{n}" for n in names))


def with_slots(
    df: DataFrame, keys: list[str], at: Column, width: float = 60, hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add SLOT: null for ordinary keys, ``floor(at / width)`` for hot ones, a slot
    of its own for a null ``at``. A null key is a key like any other.

    ``at`` must not decrease along the ordering used later. ``hot`` gives the hot
    keys where they are known already, for instance from the rows ``df`` was
    reduced from, and saves counting again.
    """
    hot = (hot_keys(df, keys, hot_rows) if hot is None else hot).withColumn(HOT, F.lit(True))
    slot = F.when(F.col(HOT), F.coalesce(F.floor(at / F.lit(width)).cast("long"), F.lit(NO_TIME)))
    return _joined(df, F.broadcast(hot), keys).withColumn(SLOT, slot)


def bare(df: DataFrame) -> DataFrame:
    """Drop the slot columns."""
    return df.drop(SLOT, HOT)


def nearest(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, ahead: bool = False
) -> DataFrame:
    """Add ``name``: the closest non-null ``value`` strictly before each row, or
    strictly after it with ``ahead``. ``df`` comes from ``with_slots``; ``order`` must be total."""
    turn = (lambda c: F.col(c).desc()) if ahead else (lambda c: F.col(c).asc())
    pick = F.min_by if ahead else F.max_by
    inside = (
        Window.partitionBy(*keys, SLOT)
        .orderBy(*[turn(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy(*keys).orderBy(turn(SLOT)).rowsBetween(Window.unboundedPreceding, -1)
    )
    edges = (
        df.where(F.col(HOT))  # no hot keys: this branch is dropped at run time
        .groupBy(*keys, SLOT)
        .agg(pick(value, F.when(value.isNotNull(), F.struct(*order))).alias("__edge"))
        .select(*keys, SLOT, F.last("__edge", ignorenulls=True).over(across).alias("__carried"))
    )
    near = df.withColumn("__near", F.last(value, ignorenulls=True).over(inside))
    return (
        _joined(near, edges, keys, (SLOT,))
        .withColumn(name, F.coalesce("__near", "__carried"))
        .drop("__near", "__carried")
    )


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str,
    total: str | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``amount`` up to and including each row, and
    optionally ``total``: its sum over the key. ``df`` comes from ``with_slots``."""
    whole = Window.partitionBy(*keys, SLOT)
    upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys)
    before = across.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        df.where(F.col(HOT))  # no hot keys: this branch is dropped at run time
        .groupBy(*keys, SLOT)
        .agg(F.sum(amount).alias("__sum"))
        .select(
            *keys,
            SLOT,
            F.sum("__sum").over(before).alias("__before"),
            F.sum("__sum").over(across).alias("__whole"),
        )
    )
    out = df.withColumn("__run", F.sum(amount).over(upto))
    if total:
        out = out.withColumn("__all", F.sum(amount).over(whole))
    out = _joined(out, sums, keys, (SLOT,)).withColumn(
        name, F.col("__run") + F.coalesce("__before", F.lit(0))
    )
    if total:
        out = out.withColumn(total, F.coalesce("__whole", "__all")).drop("__all")
    return out.drop("__run", "__before", "__whole")


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str, total: str | None = None
) -> DataFrame:
    """Add a 1-based row number per key in ``order``, to a frame from ``with_slots``."""
    return running_sum(df, keys, order, F.lit(1), name, total)
