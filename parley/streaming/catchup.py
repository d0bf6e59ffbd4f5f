"""Streams whose late rows are not lost.

A watermark bounds the state of a stream by dropping what comes after it. Here one query
carries two branches of its arrivals: the stateful result, and the arrivals as they are. The
sink lands both by micro-batch, and notes the keys of arrivals so old that the watermark may
have dropped them. Those few keys are computed again from all that has landed, by the batch
rule, and replace what the stream has for them. Each micro-batch writes folders named by its
number and overwrites them if it is run again, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming import StreamingQuery


@dataclass
class CaughtUp:
    """A stateful stream and its catch-up.

    ``result`` is the stream's form (append mode) and ``batch`` the same rule on a table of
    arrivals; ``keys`` are columns that both arrivals and results have, such that rows of one
    key make the results of that key alone. ``event_time`` is the arrivals' time, ``lateness``
    an interval, and ``closed`` says of a result, beside the column ``watermark``, whether the
    watermark has passed it (a stream gives out no other results).
    """

    result: Callable[[DataFrame], DataFrame]
    batch: Callable[[DataFrame], DataFrame]
    keys: list[str]
    event_time: str
    lateness: str
    closed: str = "true"

    def start(self, arrivals: DataFrame, path: str) -> StreamingQuery:
        """Run over what is there; rows without keys only move the watermark."""
        at = self.event_time
        # names the event time, so that the filter stays above the watermark
        present = " AND ".join(f"{k} IS NOT NULL" for k in self.keys) + f" OR {at} IS NULL"
        marked = arrivals.withWatermark(at, self.lateness)
        out = self.result(marked.where(present))
        both = out.select(F.struct(*out.columns).alias("result"), F.lit(None).cast(arrivals.schema).alias("arrival"))
        both = both.unionByName(marked.select(F.lit(None).cast(both.schema["result"].dataType).alias("result"), F.struct(*arrivals.columns).alias("arrival")))
        writer = both.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        return writer.foreachBatch(lambda rows, number: self._land(rows, number, path)).start()

    def _land(self, rows: DataFrame, number: int, path: str) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{path}/both/batch={number}")
        both = spark.read.schema(rows.schema).parquet(f"{path}/both/batch={number}")
        arrivals = both.where("arrival IS NOT NULL").select("arrival.*")
        seen = arrivals.agg(F.max(self.event_time).alias("latest"))
        seen.write.mode("overwrite").parquet(f"{path}/progress/batch={number}")
        before = self._progress(spark, path).where(F.col("batch") < number).agg(F.max("latest")).first()[0]
        late = arrivals.where(self._keyed())
        # at or before the watermark of any batch up to now
        late = late.where(F.col(self.event_time) <= F.lit(before) - F.expr(f"INTERVAL {self.lateness}")) if before is not None else late.limit(0)
        late.select(*self.keys).distinct().write.mode("overwrite").parquet(f"{path}/late/batch={number}")

    def _keyed(self) -> str:
        return " AND ".join(f"{k} IS NOT NULL" for k in self.keys)

    def _progress(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema("latest timestamp, batch long").parquet(f"{path}/progress")

    def landed(self, spark: SparkSession, path: str, schema: Ty.StructType) -> DataFrame:
        """All arrivals with keys, as they came."""
        return self._both(spark, path, schema).where("arrival IS NOT NULL").select("arrival.*").where(self._keyed())

    def _both(self, spark: SparkSession, path: str, arrivals: Ty.StructType) -> DataFrame:
        result = self.batch(spark.createDataFrame([], arrivals)).schema
        return spark.read.schema(Ty.StructType([Ty.StructField("result", result), Ty.StructField("arrival", arrivals)])).parquet(f"{path}/both")

    def streamed(self, spark: SparkSession, path: str, arrivals: Ty.StructType) -> DataFrame:
        """What the stream has given out by itself."""
        return self._both(spark, path, arrivals).where("result IS NOT NULL").select("result.*")

    def late_keys(self, spark: SparkSession, path: str, arrivals: Ty.StructType) -> DataFrame:
        """Keys that late arrivals may have changed."""
        keys = Ty.StructType([arrivals[k] for k in self.keys])
        return spark.read.schema(keys).parquet(f"{path}/late").distinct()

    def caught_up(self, spark: SparkSession, path: str, arrivals: Ty.StructType) -> DataFrame:
        """Results of the keys with late arrivals, computed again from all that has landed."""
        watermark = self._progress(spark, path).agg((F.max("latest") - F.expr(f"INTERVAL {self.lateness}")).alias("watermark"))
        again = self.batch(self.landed(spark, path, arrivals).join(self.late_keys(spark, path, arrivals), self.keys, "left_semi"))
        # one row
        return again.crossJoin(F.broadcast(watermark)).where(self.closed).drop("watermark")

    def table(self, spark: SparkSession, path: str, arrivals: Ty.StructType) -> DataFrame:
        """The stream's results, those of late keys replaced."""
        late = self.late_keys(spark, path, arrivals)
        return self.streamed(spark, path, arrivals).join(late, self.keys, "left_anti").unionByName(self.caught_up(spark, path, arrivals))
