"""Session-level plumbing shared by all operators: tables, checkpoints, broadcast size guards."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

#: Largest estimated relation (bytes) that an operator of this library may ship to every executor.
BROADCAST_LIMIT = 8 << 20


def session(app: str = "folioflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; explicit ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of the data directory; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    Only where neither the setting nor the context names one (unit tests, a laptop) a temporary folder is made.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioflow-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished, unreferenced steps removed now, not when the driver happens to collect its garbage."""
    for _ in range(2):  # Python's references go first, by a thread of their own
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a reference list on the driver, refusing one that is larger than the documented bound."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is no reference list that may be broadcast")
    return rows


def small_side(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` marked for broadcast if the measured length of its text columns (and 64 bytes a row) is within
    ``BROADCAST_LIMIT``; else as it is, for a shuffle join that AQE splits where keys are skewed."""
    from pyspark.sql import functions as F

    size = df.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(64)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_LIMIT else df
