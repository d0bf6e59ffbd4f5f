"""Metrics, renderings and gates of message threads and call segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import ordered
from parley.functions import clock
from parley.functions import text as T

THREAD = ["interaction_id"]
# Lines of one thread kept together in one rendered page.
PAGE = 1000


def _threads(messages: DataFrame, hot_rows: int) -> DataFrame:
    return ordered.with_slots(
        messages, THREAD, F.unix_seconds("sent_at"), 60, hot_rows
    )


def response_gaps(messages: DataFrame, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """One row per answered customer turn: when it opened, when the agent replied.

    A thread is cut at its agent messages; the part up to and including an agent
    message holds at most one gap, from its first customer message to its end.
    """
    told = messages.where(F.col("sender").isin("customer", "agent")).select(
        *THREAD, "message_id", "sender", "sent_at"
    )
    is_agent = (F.col("sender") == "agent").cast("long")
    cut = ordered.running_sum(
        _threads(told, hot_rows), THREAD, ["sent_at", "message_id"], is_agent, "replies"
    )
    turn = F.col("replies") - is_agent
    return (
        cut.groupBy(*THREAD, turn.alias("turn"))
        .agg(
            F.min(F.when(F.col("sender") == "customer", F.col("sent_at"))).alias("asked_at"),
            F.max(F.when(F.col("sender") == "agent", F.col("sent_at"))).alias("replied_at"),
        )
        .where("asked_at IS NOT NULL AND replied_at IS NOT NULL")
        .select(
            *THREAD, "turn", "asked_at", "replied_at",
            ((F.unix_micros("replied_at") - F.unix_micros("asked_at")) / F.lit(1e6)).alias("gap_seconds"),
        )
    )


def response_metrics(
    gaps: DataFrame, hot_rows: int = ordered.HOT_ROWS, hot: DataFrame | None = None
) -> DataFrame:
    """First, median and longest gap per thread, in whole seconds, truncated.

    The median takes the middle one or two of the ranked gaps, so no thread's gaps
    are gathered in one place.
    """
    ranked = ordered.numbered(
        ordered.with_slots(gaps, THREAD, F.col("gap_seconds"), 60, hot_rows, hot),
        THREAD, ["gap_seconds", "turn"], "rank", total="n",
    )
    middle = (F.col("rank") * 2).between(F.col("n"), F.col("n") + 2)
    return ranked.groupBy(*THREAD).agg(
        F.min_by("gap_seconds", "turn").cast("int").alias("first_response_seconds"),
        F.avg(F.when(middle, F.col("gap_seconds"))).cast("int").alias("median_response_seconds"),
        F.max("gap_seconds").cast("int").alias("max_response_gap_seconds"),
    )


def message_counts(messages: DataFrame) -> DataFrame:
    """Counts by sender, span and ends of each thread."""
    def n(kind: str) -> Column:
        return F.count_if(F.col("sender") == kind).alias(f"{kind}_message_count")

    return messages.groupBy(*THREAD).agg(
        n("customer"), n("agent"), n("bot"),
        ((F.unix_micros(F.max("sent_at")) - F.unix_micros(F.min("sent_at"))) / F.lit(1e6))
        .cast("int").alias("conversation_span_seconds"),
        F.min("sent_at").alias("first_at"),
        F.max("sent_at").alias("last_at"),
    )


def _letter_counts(messages: DataFrame) -> DataFrame:
    """Share of Arabic letters per side. Joining the bodies with blanks adds no
    letters, so the letters can be counted message by message and summed."""
    letters = F.regexp_replace("body", r"[^\p{L}]", "")
    arabic = F.regexp_replace(letters, r"[^\x{0600}-\x{06ff}]", "")
    sides = []
    for side in ("customer", "agent"):
        mine = F.col("sender") == side
        sides += [
            F.sum(F.when(mine, F.length(letters))).alias(f"{side}_letters"),
            F.sum(F.when(mine, F.length(arabic))).alias(f"{side}_arabic"),
        ]
    return messages.groupBy(*THREAD).agg(*sides)


def language_match(messages: DataFrame) -> DataFrame:
    """Whether both sides wrote in the same script; null unless both wrote."""
    def mostly(side: str) -> Column:
        return F.col(f"{side}_arabic") * 2 > F.col(f"{side}_letters")

    return _letter_counts(messages).select(
        *THREAD, (mostly("customer") == mostly("agent")).alias("language_matched")
    )


def chat_metrics(
    messages: DataFrame, offset_hours: float = clock.PORTAL_OFFSET_HOURS,
    hot_rows: int = ordered.HOT_ROWS,
) -> DataFrame:
    """All deterministic metrics of a chat thread, one row per thread."""
    # a thread has fewer gaps than messages, so its hot keys cover those of the gaps
    hot = ordered.hot_keys(messages, THREAD, hot_rows)
    gaps = response_metrics(response_gaps(messages, hot_rows), hot=hot)
    return (
        message_counts(messages)
        .join(language_match(messages), THREAD, "left")
        .join(gaps, THREAD, "left")
        .withColumn("after_hours", clock.is_after_hours(F.col("first_at"), offset_hours))
    )


def talk_ratio(segments: DataFrame) -> DataFrame:
    """Agent seconds over labelled seconds; null without labels or time."""
    labelled = F.col("speaker").isin("agent", "customer")
    agent = F.sum(F.when(F.col("speaker") == "agent", F.col("seconds")))
    total = F.sum(F.when(labelled, F.col("seconds")))
    return segments.groupBy("call_id").agg(
        F.bround(F.coalesce(agent, F.lit(0.0)) / F.when(total > 0, total), 3).alias("agent_talk_ratio")
    )


def resequence(messages: DataFrame, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """Contiguous 1-based ``seq`` per thread in time order."""
    return ordered.bare(
        ordered.numbered(_threads(messages, hot_rows), THREAD, ["sent_at", "message_id"], "seq")
    )


def latest_version(arrivals: DataFrame) -> DataFrame:
    """Flag arrivals that no newer arrival of their thread supersedes.

    The newest id per thread comes from a combined aggregate; the join back is on
    a key with one row on that side, which a skew split can handle.
    """
    newest = arrivals.groupBy("external_ref").agg(F.max("raw_id").alias("newest_raw_id"))
    return arrivals.join(newest, "external_ref").withColumn(
        "is_latest", F.col("raw_id") == F.col("newest_raw_id")
    )


def _paged(lines: DataFrame, keys: list[str], page_size: int) -> DataFrame:
    """Ordered lines gathered into pages of bounded size."""
    page = F.floor((F.col("seq") - 1) / page_size).cast("int")
    return lines.groupBy(*keys, page.alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines")
    )


def chat_transcript(
    messages: DataFrame, page_size: int = PAGE, hot_rows: int = ordered.HOT_ROWS
) -> DataFrame:
    """Thread as text, one line per message. A thread of up to ``page_size``
    messages is one row; a longer one goes on in further pages."""
    line = F.concat(
        F.lit("["), F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss"), F.lit("] "),
        F.upper("sender"), F.lit(": "), F.col("body"),
    )
    lines = resequence(messages, hot_rows).select(*THREAD, "seq", line.alias("line"))
    return _paged(lines, THREAD, page_size).select(
        *THREAD, "page", F.array_join(F.col("lines.line"), "\n").alias("transcript_text")
    )


def call_dialogue(segments: DataFrame, page_size: int = PAGE) -> DataFrame:
    """Call as text: start time, label when the speaker is known, empty segments
    left out. Pages as in ``chat_transcript``."""
    label = F.when(
        F.col("speaker") == "unknown", F.lit("")
    ).otherwise(F.concat(F.lit(" "), F.upper("speaker"), F.lit(":")))
    line = F.concat(
        F.lit("["), T.mmss(F.col("start_sec")), F.lit("]"), label, F.lit(" "), F.col("text")
    )
    lines = segments.where(F.length("text") > 0).select(
        "call_id", (F.col("seq") + 1).alias("seq"), line.alias("line")
    )
    return _paged(lines, ["call_id"], page_size).select(
        "call_id", "page", F.array_join(F.col("lines.line"), "\n").alias("dialogue")
    )


def collect_thread(
    arrivals: DataFrame, page_size: int = PAGE, hot_rows: int = ordered.HOT_ROWS, keys: tuple[str, ...] = ("external_ref",),
) -> DataFrame:
    """Messages of a thread as one JSON array in order of arrival, in pages. ``keys`` name a thread."""
    keys = list(keys)
    slots = ordered.with_slots(arrivals, keys, F.col("raw_id"), 100_000, hot_rows)
    lines = ordered.numbered(slots, keys, ["raw_id"], "seq").select(
        *keys, "seq", F.struct("sender", "message", "timestamp").alias("line")
    )
    return _paged(lines, keys, page_size).select(*keys, "page", F.to_json(F.col("lines.line")).alias("history"))


def thread_faults(messages: DataFrame) -> DataFrame:
    """Threads that cannot be graded, and the gate that follows from it."""
    agent = F.count_if(F.col("sender") == "agent")
    customer = F.count_if(F.col("sender") == "customer")
    return (
        messages.groupBy(*THREAD)
        .agg((agent == 0).alias("is_bot_only"), (customer == 0).alias("has_no_customer_turn"))
        .withColumn("should_evaluate", should_evaluate(F.col("is_bot_only"), F.col("has_no_customer_turn")))
    )


def should_evaluate(bot_only: Column, no_customer: Column, score_bot_only: bool = False) -> Column:
    return (F.lit(score_bot_only) | ~bot_only) & ~no_customer


def settled_threads(messages: DataFrame, as_of: Column, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a thread closed by ``gap`` of silence before ``as_of``.

    The end is taken from the messages rather than from the session key: a filter
    on the key would run before sessions are merged.
    """
    end = F.max("sent_at") + F.expr(f"INTERVAL {gap}")
    return (
        messages.groupBy(*THREAD, F.session_window("sent_at", gap).alias("session"))
        .agg(F.min("sent_at").alias("session_start"), end.alias("settled_at"), F.count(F.lit(1)).alias("messages"))
        .where(F.col("settled_at") <= as_of)
        .drop("session")
    )
