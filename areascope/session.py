"""Session helpers.

Library code never hard-codes a master or a scratch folder: on a cluster the session and
``spark.checkpoint.dir`` come from the deployment. Only tests and the bench build a local session.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings that are safe on any cluster size; partition counts come from the deployment.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "areascope") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, checkpoint dir set if missing)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("AREASCOPE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for intermediate tables and checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset (tests, local runs) a folder
    under ``spark.sql.warehouse.dir`` is used: the warehouse is shared by driver and executors too,
    unlike a machine's temporary folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: configuration only
        sc = None
    configured = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    folder = configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_areascope"
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


@dataclass(frozen=True)
class Stored:
    """A written table: its folder, the table read back, and the metrics observed while it was written."""

    path: str
    df: DataFrame
    metrics: dict = field(default_factory=dict)
    table: str | None = None


def store(df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = (), bucket_by: tuple[str, ...] = (),
          buckets: int | None = None, metrics: dict[str, Column] | None = None, rebalance: bool = True) -> Stored:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used at layer boundaries (raw tables, per-area aggregates that feed several branches, marts):
    later stages scan files instead of re-running the lineage (which also survives lost
    executors), and the planner sees the real file size when it chooses a join strategy.

    ``partition_by`` writes one folder per value (e.g. per month) so filters on it prune whole
    folders. The rows are rebalanced on those columns: adaptive execution gives a large folder
    several tasks of the advisory size and puts small ones together, so two school years are not
    two tasks and a hundred months are not a file per task and folder. Without ``rebalance`` the tasks write their rows as they
    come: for rows that lie together already, and for wide rows of few folders, which would cost a shuffle of them all.

    ``bucket_by`` makes it a catalog table hashed on those columns into ``buckets`` files (the session's
    shuffle partitions by default), so that tables bucketed alike are joined on them without a shuffle.

    ``metrics`` (name -> aggregate) are observed in the stage that writes, where every task counts
    exactly once even if it is repeated: they cost no scan of their own.
    """
    spark = df.sparkSession
    label = f"{name}-{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/areascope/{label}"
    schema, table = df.schema, None
    if bucket_by:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(buckets, *bucket_by)
    elif partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    seen = Observation(f"metrics-{label}") if metrics else None
    if seen is not None:
        df = df.observe(seen, *[c.alias(k) for k, c in metrics.items()])
    writer = df.write.mode("overwrite")
    if bucket_by:
        table = label.replace("-", "_")
        writer.format("parquet").bucketBy(buckets, *bucket_by).option("path", path).saveAsTable(table)
        back = spark.table(table)
    else:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        # the schema is known: skip footer inference on read-back
        back = spark.read.schema(schema).parquet(path)
    return Stored(path, back, dict(seen.get) if seen is not None else {}, table)


def materialize(df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = (), rebalance: bool = True) -> DataFrame:
    """The table of ``store``, read back."""
    return store(df, name, partition_by, rebalance=rebalance).df
