"""Runs that add to a table and can be repeated after any failure.

Under one folder, every run has a data folder and a manifest folder of its own:

    data/run=<id>/       the rows of the run
    manifest/run=<id>/   the keys it has finished, written after the rows

A run counts once its manifest is complete, which Spark marks with a success file as the last
step of the write. Readers look at counted runs only, so rows of a run that died are never
seen. Doing the run again under the same id replaces what it left; nothing is renamed, so
the protocol holds on stores without atomic renames too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqseg.operators.ordered import KEYS
from seqseg.operators.select import pending

_ID = re.compile(r"[A-Za-z0-9._-]+")


def finished_runs(spark: SparkSession, path: str) -> list[str]:
    """Ids of the runs whose manifest is complete."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    found = []
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("run=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(name.removeprefix("run="))
    return sorted(found)


def _read(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    folders = [f"{path}/{part}/run={run}" for run in finished_runs(spark, path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, path: str, schema: str = "dataset string, episode_index bigint") -> DataFrame:
    """Keys that counted runs have finished."""
    return _read(spark, path, "manifest", schema).distinct()


def read_finished(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of counted runs."""
    return _read(spark, path, "data", schema)


def run_pending(
    inputs: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    path: str,
    run_id: str,
    keys: Sequence[str] = KEYS,
    partition_by: Sequence[str] = (),
) -> bool:
    """Apply ``work`` to the rows of keys that no counted run has, and add the result as a run.

    Keys without any output row count as finished too. Returns False, and does nothing, if
    the run is counted already.
    """
    if not _ID.fullmatch(run_id):
        raise ValueError(f"not a run id: {run_id!r}")
    spark = inputs.sparkSession
    if run_id in finished_runs(spark, path):
        return False
    schema = ", ".join(f"{k} {inputs.schema[k].dataType.simpleString()}" for k in keys)
    todo = pending(inputs, read_manifest(spark, path, schema), keys)
    writer = work(todo).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/data/run={run_id}")
    _record(todo.select(*keys).distinct(), f"{path}/manifest/run={run_id}")
    return True


def _record(done: DataFrame, folder: str) -> None:
    done.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)
