"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results, so every entry point applies them.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # JSON.parse keeps the last of two equal keys; without this the parse yields NULL.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# A page of the largest size asks for 1001 rows, one more than Spark thins by lane on its own.
PLAN_CONF = {"spark.sql.optimizer.windowGroupLimitThreshold": "1001"}

# Settings that only change speed; a cluster's own values win over these.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "cordwood", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **SEMANTIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the engine relies on to a session that somebody else built."""
    for key, value in {**SEMANTIC_CONF, **PLAN_CONF}.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own:
    on a cluster a machine-local path would lose data with its machine.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="cordwood-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of what a plan reads, from file sizes; an unknown size counts as huge."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
