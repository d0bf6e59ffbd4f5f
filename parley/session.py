"""Session settings the operators rely on, and the folder for persisted stages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; all may be changed on a live session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keep the skew split even where a later operator then needs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # session windows merge inside each map task before the shuffle
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # HotSpot never compiles methods above 8000 bytecodes; such a stage is faster
    # as split methods outside whole-stage code generation
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # lets small tables split over all cores; large inputs still split at the
    # usual maximum
    "spark.sql.files.openCostInBytes": "262144",
    # the last of repeated keys wins, as JSON readers commonly have it
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "parley", cores: str = "*", partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine uses its temporary folder;
    on a cluster that is an error, since executors could not read each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "parley-work")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and survives the loss of an executor, unlike a local
    checkpoint.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: bytes of files a core up to which ``spread`` deals rows out
SPREAD_BYTES = 128 << 20
#: bytes of files for each task that ``spread`` deals to, at most
DEAL_BYTES = 2 << 20


def spread(df: DataFrame, path: str) -> DataFrame:
    """Rows read from ``path``, dealt evenly over all cores where the files alone might not do that.

    For work that costs much per row. A small input may be one row group, which is one task
    however many cores wait. The exchange moves at most ``SPREAD_BYTES`` a core, and only
    the columns used later; a larger input fills the cores by its row groups and is left as it is.
    Tasks are as many as the cores, or more where the files are larger, so that one slow core
    does not hold up all others and cores that join late have work.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(files).getLength()
    return df.repartition(max(cores, -(-size // DEAL_BYTES))) if 0 < size <= SPREAD_BYTES * cores else df
