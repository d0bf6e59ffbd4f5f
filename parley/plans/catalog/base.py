"""Registry of queries, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from parley import session
from parley.operators import promises as pr
from parley.operators import scoring as sc
from parley.plans import binding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF_TEXT = "2001-06-01 00:00:00"


class Tables:
    """Logical tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return binding.table(self.spark, self.folder, name)

    def scan(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def as_of(self):
        return F.lit(AS_OF_TEXT).cast("timestamp")

    @property
    def agents(self) -> DataFrame:
        nations = self.scan("nation").select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("team"))
        return binding.table(self.spark, self.folder, "agents").join(nations, "nation_key")

    @property
    def follow_ups(self) -> DataFrame:
        return pr.close_promises(self.promises, self.interactions, self.as_of)

    @property
    def analysed(self) -> DataFrame:
        return sc.project_pass1(self.analyses)

    @property
    def parsed(self) -> DataFrame:
        return sc.parsed(self.judgements)

    @property
    def evaluations(self) -> DataFrame:
        return sc.stored_evaluations(self.parsed)


def flat(df: DataFrame) -> DataFrame:
    """Plain result types: instants without a zone, decimals as doubles."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, Ty.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        elif isinstance(f.dataType, Ty.DecimalType):
            c = c.cast("double").alias(f.name)
        columns.append(c)
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its check in SQL where there is one."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            session.tune(spark)
            return flat(fn(Tables(spark, folder)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


cte = binding.cte
AGENTS_SQL = "people AS (SELECT a.*, n.n_name AS team FROM agents a JOIN nation n ON n.n_nationkey = a.nation_key)"
FOLLOW_UPS_SQL = (
    "next_contact AS (SELECT customer_id, agent_id, started_at, min(interaction_id) AS interaction_id "
    "FROM interactions WHERE customer_id IS NOT NULL GROUP BY ALL), "
    "follow_ups AS (SELECT p.*, c.interaction_id AS fulfilled_in, c.started_at AS fulfilled_at, "
    "round(CAST(epoch(c.started_at - p.promised_at) AS BIGINT) / 3600, 2) AS hours_to_fulfil, "
    "CASE WHEN c.started_at <= coalesce(p.due_at, p.promised_at + INTERVAL 24 HOUR) THEN 'fulfilled' "
    "WHEN c.started_at IS NOT NULL THEN 'late' "
    f"WHEN coalesce(p.due_at, p.promised_at + INTERVAL 48 HOUR) < TIMESTAMP '{AS_OF_TEXT}' THEN 'missed' "
    "ELSE 'open' END AS status FROM promises p ASOF LEFT JOIN next_contact c "
    "ON p.customer_id = c.customer_id AND p.agent_id = c.agent_id AND p.promised_at < c.started_at)"
)
ANALYSED_SQL = (
    "analysed AS (SELECT interaction_id, updated_at, payload, "
    "CASE WHEN payload->>'$.commercial.buying_stage' IN ('awareness','consideration','decision','purchased','lost') "
    "THEN payload->>'$.commercial.buying_stage' ELSE 'unknown' END AS buying_stage, "
    "CASE WHEN payload->>'$.commercial.lead_temperature' IN ('hot','warm','cold') "
    "THEN payload->>'$.commercial.lead_temperature' ELSE 'unknown' END AS lead_temp FROM analyses)"
)
