"""Recording names, the call queue and its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The name pattern of a recording and the queue's limits.
NAME = r"(?i)^([a-z]+)-([0-9]+)-([0-9]+)-([0-9]{8})-([0-9]{6})-([0-9.]+)\.wav$"
COPY_SUFFIX = r"\s*\([0-9]+\)(?=\.[A-Za-z0-9]+$)"
MIN_AUDIO_BYTES = 1024
MAX_RETRIES = 5
COOL_OFF = "45 MINUTES"
CLAIM = 25
LISTED, DONE, DEAD, GATE_RED = "discovered", "evaluated", "dead_letter", "gate_red"
TOO_SMALL = "audio_too_small: WAV under 1KB is a header with no audio"


def _decoded(df: DataFrame, offset_hours: float) -> DataFrame:
    base = F.regexp_replace(F.regexp_extract("name", r"([^/]*)$", 1), COPY_SUFFIX, "")
    parts = ("kind", "agent_extension", "customer_phone_raw", "__date", "__time", "uniqueid")
    shaped = df.withColumn("__base", base).withColumns(
        {p: F.nullif(F.regexp_extract("__base", NAME, i + 1), F.lit("")) for i, p in enumerate(parts)}
    )
    local = F.try_to_timestamp(F.concat("__date", "__time"), F.lit("yyyyMMddHHmmss"))
    # the name carries the exchange's own clock, which runs ahead of UTC
    started = F.timestamp_micros(F.unix_micros(local) - int(offset_hours * 3_600_000_000))
    epoch = F.try_to_number(F.split("uniqueid", r"\.")[0], F.lit("9" * 18)).cast("long")
    return shaped.withColumn("started_at", started).withColumn(
        "clock_drift_seconds", F.abs(epoch - F.unix_seconds("started_at"))
    ).drop("__base", "__date", "__time")


def decode_recording_name(recordings: DataFrame, offset_hours: float = 3) -> DataFrame:
    """Metadata held in a recording's file name; other names are left out."""
    return _decoded(recordings, offset_hours).where("started_at IS NOT NULL")


def rejected_names(recordings: DataFrame, offset_hours: float = 3) -> DataFrame:
    return _decoded(recordings, offset_hours).where("started_at IS NULL").select(*recordings.columns)


def best_copy_per_call(decoded: DataFrame) -> DataFrame:
    """Largest file per call; the first listed on ties."""
    size = F.coalesce("size_bytes", F.lit(0))
    columns = [c for c in decoded.columns if c != "uniqueid"]
    best = F.min_by(F.struct(*columns), F.struct(-size, F.col("modified_at"), F.col("file_id")))
    return decoded.groupBy("uniqueid").agg(best.alias("b")).select("uniqueid", "b.*")


def register(decoded: DataFrame) -> DataFrame:
    """New queue rows; a header without audio goes straight to the dead letters."""
    small = F.coalesce("size_bytes", F.lit(999_999)) < MIN_AUDIO_BYTES
    return decoded.select(
        "*",
        F.when(small, "dead_letter").otherwise("discovered").alias("status"),
        F.when(small, TOO_SMALL).alias("last_error"),
    )


def clock_drift_report(decoded: DataFrame, seconds: int = 5) -> DataFrame:
    """Recordings whose two clocks differ by more than ``seconds``."""
    return decoded.where(F.col("clock_drift_seconds") > seconds).select(
        "uniqueid", "file_id", "started_at", "clock_drift_seconds"
    )


def claimable(jobs: DataFrame, as_of: Column, max_retries: int = MAX_RETRIES) -> Column:
    cooled = F.col("updated_at") < as_of - F.expr(f"INTERVAL {COOL_OFF}")
    return (F.col("meta") != "{}") & (
        F.col("status").isin("discovered", "transcribed")
        | (F.col("status").isin("asr_failed", "judge_failed") & (F.col("retries") < max_retries) & cooled)
    )


def claim_work(
    jobs: DataFrame, as_of: Column, n: int = CLAIM, max_retries: int = MAX_RETRIES
) -> DataFrame:
    """The next ``n`` jobs, oldest first: a top-k, not a sort of the queue."""
    return jobs.where(claimable(jobs, as_of, max_retries)).orderBy("discovered_at", "uniqueid").limit(n)


def usable_transcript(df: DataFrame, floor: float = 0.7) -> DataFrame:
    text = F.btrim(F.coalesce("full_text", F.lit("")))
    return df.where((text != "") & (F.coalesce("asr_confidence", F.lit(0.0)) >= floor) & F.col("error").isNull())


def seed_jobs(
    interactions: DataFrame, transcripts: DataFrame, evaluations: DataFrame, source: str
) -> DataFrame:
    """Queue rows for what ran before the queue existed."""
    done = evaluations.select("interaction_id", F.lit(True).alias("__done"))
    audio = transcripts.select("interaction_id", "audio_uri")
    return (
        interactions.where(F.col("external_source") == source)
        .join(audio, "interaction_id", "left")
        .join(done, "interaction_id", "left")
        .select(
            F.col("interaction_id").alias("uniqueid"),
            F.coalesce("audio_uri", F.lit("")).alias("audio_uri"),
            F.when(F.col("__done"), "evaluated").otherwise("discovered").alias("status"),
        )
    )


FAILURES = ("asr_failed", "judge_failed")


def job_state_fold(events: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Queue state per call from its log of steps.

    A call is listed again long after it is done, so ``discovered`` counts only while
    nothing else is known. An evaluation is final, and so are a red gate and a failure
    that uses up the budget; otherwise the last step is the state. One aggregate that
    combines map-side and runs the same on a stream.
    """
    order = F.struct("logged_at", "event_id")
    failed = F.col("step").isin(*FAILURES)
    folded = events.groupBy("uniqueid").agg(
        F.max_by("step", F.when(F.col("step") != LISTED, order)).alias("last_step"),
        F.max(F.col("step") == DONE).alias("done"),
        F.max(F.col("step") == GATE_RED).alias("red"),
        F.count_if(failed).cast("int").alias("retries"),
        F.max_by("error", F.when(F.col("error").isNotNull(), order)).alias("last_error"),
        F.max("logged_at").alias("updated_at"),
    )
    dead = F.col("red") | (F.col("retries") >= max_retries)
    status = F.when(F.col("done"), DONE).when(dead, DEAD).otherwise(F.coalesce("last_step", F.lit(LISTED)))
    return folded.select("uniqueid", status.alias("status"), "retries", "last_error", "updated_at")
