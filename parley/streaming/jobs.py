"""The batch rules as Structured Streaming jobs.

State is bounded by watermarks and timers. Late rows go through ``catchup``, changes of
keyed state through ``sources.table``, so the final tables agree with a batch run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from parley.functions import text as T
from parley.operators import conversations
from parley.session import persist
from parley.sources.table import KeyedTable
from parley.streaming import catchup, keyed

LATENESS = "1 day"


def landing(lateness: str = LATENESS) -> catchup.CaughtUp:
    """At-least-once arrivals (``source``, ``payload_hash``, ``received_at``) made idempotent by hash.

    A payload sent again within ``lateness`` of the first is dropped by the stream's state.
    """
    keys = ["source", "payload_hash"]
    return catchup.CaughtUp(
        lambda rows: rows.dropDuplicatesWithinWatermark(keys).select(*keys), lambda rows: rows.select(*keys).distinct(), keys, "received_at", lateness
    )


def hashed(arrivals: DataFrame, source: str) -> DataFrame:
    """Payloads (``payload``, ``received_at``) with the hash that tells copies."""
    return arrivals.select(F.lit(source).alias("source"), T.text_hash(F.col("payload")).alias("payload_hash"), "received_at")


def deduplicated(lateness: str = LATENESS) -> catchup.CaughtUp:
    """Messages of threads that are sent again in full, each kept once (interaction_id, sender, sent_at, body_hash)."""
    keys = ["interaction_id", "sender", "sent_at", "body_hash"]
    return catchup.CaughtUp(
        lambda rows: rows.select(*keys).dropDuplicates(keys), lambda rows: rows.select(*keys).distinct(), keys, "sent_at", lateness
    )


def _sessions(messages: DataFrame, gap: str) -> DataFrame:
    return (
        messages.groupBy("interaction_id", F.session_window("sent_at", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("messages"))
        .select("interaction_id", F.col("session.start").alias("session_start"), F.col("session.end").alias("settled_at"), "messages")
    )


def settled_threads(gap: str = "30 minutes", lateness: str = LATENESS) -> catchup.CaughtUp:
    """Threads quiet for ``gap``, given out once the watermark has passed their end; a late message makes its thread's sessions anew."""
    rule = lambda rows: _sessions(rows, gap)
    return catchup.CaughtUp(rule, rule, ["interaction_id"], "sent_at", lateness, "settled_at <= watermark")


def windowed_counts(width: str = "15 minutes", lateness: str = LATENESS) -> catchup.CaughtUp:
    """Volume per channel and poll period, for the run log. Arrivals carry their ``period_start``."""

    def stream(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy(F.window("sent_at", width).alias("w"), "sender").agg(F.count(F.lit(1)).alias("n"))
        return counts.select(F.col("w.start").alias("period_start"), "sender", "n")

    def batch(rows: DataFrame) -> DataFrame:
        return rows.groupBy("period_start", "sender").agg(F.count(F.lit(1)).alias("n"))

    return catchup.CaughtUp(stream, batch, ["period_start", "sender"], "sent_at", lateness, f"period_start + INTERVAL {width} <= watermark")


def run_to_table(spec: catchup.CaughtUp, arrivals: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there and read its table, late rows merged."""
    spec.start(arrivals, path).awaitTermination()
    return spec.table(arrivals.sparkSession, path, arrivals.schema)


def run_to_keyed_table(changes: DataFrame, table: KeyedTable, state: str, order: str | None = None, when: str | None = None) -> KeyedTable:
    """Run a stream of changed keys over what is there; each micro-batch is one commit of its keys.

    ``order`` picks the last of several changes of a key in one micro-batch, ``when`` the stored
    rows (``old``) that may change.
    """
    columns = [c for c in changes.columns if c not in table.key]

    def keep(rows: DataFrame, number: int) -> None:
        # stored first, since each step of a commit would run the state again
        rows = persist(rows, "changes")
        if order is not None:
            rows = rows.groupBy(*table.key).agg(F.max_by(F.struct(*columns), F.expr(order)).alias("r")).select(*table.key, "r.*")
        table.upsert(rows, "stream", number, when=None if when is None else F.expr(when))

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    return table


def promise_outcomes(line: DataFrame, path: str, **rule: str | int) -> KeyedTable:
    """Status of every promise, kept as it changes."""
    table = KeyedTable(line.sparkSession, f"{path}/table", keyed.OUTCOME, ["follow_up_id"])
    return run_to_keyed_table(keyed.promise_timer(line, **rule), table, f"{path}/state", keyed.SETTLED)


def call_queue(events: DataFrame, path: str, **rule: str | int) -> KeyedTable:
    """State of every call, kept as its steps arrive; a micro-batch writes the calls it names."""
    table = KeyedTable(events.sparkSession, f"{path}/table", keyed.CALL_STATE, ["uniqueid"])
    return run_to_keyed_table(keyed.call_states(events, **rule), table, f"{path}/state", when=keyed.OPEN_CALL)


def rebuild_settled(marks: DataFrame, raw: DataFrame) -> DataFrame:
    """Whole threads up to the arrival that settled them, in pages: (external_ref, last_id, settled_at, page, history).

    ``raw`` has external_ref, raw_id, received_at, sender, message and timestamp. One thread
    may settle several times, each time with all that came before.
    """
    last = marks.select("external_ref", F.col("raw_id").alias("last_id"), "last_at", "settled_at")
    upto = F.struct("received_at", "raw_id") <= F.struct("last_at", "last_id")
    told = raw.join(last, "external_ref").where(upto)
    return conversations.collect_thread(told, keys=("external_ref", "last_id", "settled_at"))


def thread_debounce(arrivals: DataFrame, path: str, gap: str = "1 minute", lateness: str = "10 minutes", landed: Callable[[SparkSession], DataFrame] | None = None, groups: int = keyed.GROUPS) -> DataFrame:
    """Threads that nothing has followed for ``gap``, each rebuilt from its landed arrivals.

    A micro-batch names the threads that have settled; only their arrivals are read again.
    ``landed`` reads the table that the arrivals stream from.
    """
    spark = arrivals.sparkSession
    marks = keyed.settled_arrivals(arrivals.select("external_ref", "raw_id", "received_at"), gap, lateness, groups)

    def keep(rows: DataFrame, number: int) -> None:
        # stored first, since the join below would run the state again
        rows.write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        settled = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/marks/batch={number}")
        rebuild_settled(settled, landed(rows.sparkSession)).write.mode("overwrite").parquet(f"{path}/threads/batch={number}")

    writer = marks.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    schema = Ty.StructType.fromDDL("external_ref string, last_id long, settled_at timestamp, page int, history string")
    return spark.read.schema(schema).parquet(f"{path}/threads").drop("batch")
