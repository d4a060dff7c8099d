"""Session settings the operators are written for."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# AQE picks join strategies and partition counts from measured sizes: a side is broadcast
# only when Spark has measured that it fits under autoBroadcastJoinThreshold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    # Recording the call site of every expression slows down building long plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "seqseg",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def durable_dir(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local session
    (one machine, as in tests) gets a private folder that is used until it stops; a
    session with executors elsewhere is refused, since they would not see the files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(
                f"spark.checkpoint.dir is not set; with master {master} it must name a folder shared by all executors"
            )
        sc = spark.sparkContext
        configured = sc._seqseg_dir = getattr(sc, "_seqseg_dir", None) or tempfile.mkdtemp(prefix="seqseg-")
    return configured


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Needed before any Python function of the package runs in a task: an executor imports it
    by name and may be started anywhere.
    """
    sc = spark.sparkContext
    if getattr(sc, "_seqseg_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="seqseg-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._seqseg_shipped = True


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from the written copy.

    For compact results (runs, peaks, segments) that several later steps read: each
    would otherwise compute them again, and the plan would double at every step. The
    copy outlives lost executors. Files stay until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{durable_dir(spark).rstrip('/')}/seqseg/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
