"""Recording listings and stored transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources import listing


def list_recordings(spark: SparkSession, path: str, since: str | None = None, suffix: str = ".wav") -> DataFrame:
    """Listing of audio files below ``path``, by the data source of ``listing``; the contents are never read."""
    listing.register(spark)
    reader = spark.read.format("recording_listing").option("path", path).option("suffix", suffix)
    return (reader.option("since", since) if since else reader).load()


def stream_recordings(spark: SparkSession, path: str, since: str | None = None, suffix: str = ".wav") -> DataFrame:
    """The same listing as a stream: each file once, also over restarts."""
    listing.register(spark)
    reader = spark.readStream.format("recording_listing").option("path", path).option("suffix", suffix)
    return (reader.option("since", since) if since else reader).load()


def scan_since(listing: DataFrame, since: Column, limit: int | None = None, after: Column | None = None) -> DataFrame:
    """Rows modified after an instant, oldest first; with ``limit``, the first so many of them.

    Times tie, so a page goes on from the last row's (modified_at, file_id): pass its
    time as ``since`` and its id as ``after``.
    """
    at = F.col("modified_at")
    newer = at > since if after is None else (at > since) | ((at == since) & (F.col("file_id") > after))
    rows = listing.where(newer).orderBy("modified_at", "file_id")
    return rows if limit is None else rows.limit(limit)


def load_scored_transcript(df: DataFrame) -> DataFrame:
    """Segment rows of stored transcripts (JSON in ``payload``), with the share of
    segments that came back, to two places. One row in, its segments out."""
    parsed = F.from_json(
        "payload",
        "duration_sec DOUBLE, sample_rate INT, segments ARRAY<STRUCT<idx: INT, start_sec: DOUBLE, "
        "end_sec: DOUBLE, text: STRING, error: STRING>>",
    )
    ok = F.size(F.filter("t.segments", lambda s: F.coalesce(s["error"], F.lit("")) == ""))
    n = F.size("t.segments")
    return df.withColumn("t", parsed).select(
        "call_id", F.col("t.duration_sec").alias("duration_seconds"),
        F.bround(ok / F.greatest(n, F.lit(1)), 2).alias("confidence"),
        F.explode_outer("t.segments").alias("s"),
    ).select(
        "call_id", "duration_seconds", "confidence", F.col("s.idx").alias("seq"), "s.start_sec", "s.end_sec",
        "s.text", F.lit("unknown").alias("speaker"),
    )
