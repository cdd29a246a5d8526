"""Session helpers shared by tests, bench and the jobs that need a work folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "tokenmill") -> SparkSession:
    """A small local session for tests and bench. On a cluster, bring your own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_OWN: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` names the shared folder. Only a session in one process without that setting
    gets a folder of its own; on a cluster a machine-local folder would not outlive its node.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tokenmill-")
        _OWN[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write a result that several later steps read, and go on from the files.

    The order-dependent kernels read their input twice, so a chain of them would run the first step
    many times over. Files in the shared folder outlive lost executors, and cut the lineage. With ``free``
    Spark removes the shuffles behind them once they are written, and not when its driver collects garbage.
    """
    path = work_dir(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(FREE, "false")
    conf.set(FREE, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        conf.set(FREE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, in the folder that the session names."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark, "lineage"))
