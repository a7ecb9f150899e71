"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "loamline", **options: str) -> SparkSession:
    """UTC, ANSI, adaptive plans, and overwrites of touched partitions only."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    builder = SparkSession.builder.appName(name)
    for k, v in (settings | options).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the session names; a test session without one gets its own."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        import tempfile

        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def checkpointed(df):
    """Cut the lineage in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()
