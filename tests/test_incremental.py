"""Incremental runs that die between their steps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from seqseg.sinks import incremental as inc

SCHEMA = "dataset string, episode_index bigint, frame_index bigint, v double"


def table(spark, episodes):
    return spark.createDataFrame([("d", e, i, float(e)) for e in episodes for i in range(4)], SCHEMA)


def work(df):
    """Episode 3 has no output rows."""
    return df.where("episode_index <> 3").withColumn("v", F.col("v") * 2)


def result(spark, path):
    return rows_of(inc.read_finished(spark, path, SCHEMA), "episode_index", "frame_index", "v")


def expected(episodes):
    return sorted((e, i, 2.0 * e) for e in episodes for i in range(4) if e != 3)


def test_runs_add_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "out")
    assert inc.finished_runs(spark, path) == [] and result(spark, path) == []
    assert inc.run_pending(table(spark, [1, 3]), work, path, "a")
    assert not inc.run_pending(table(spark, [1, 3, 5]), work, path, "a")
    assert inc.run_pending(table(spark, [1, 3, 5]), work, path, "b")
    assert result(spark, path) == expected([1, 5])
    assert rows_of(inc.read_manifest(spark, path), "episode_index") == [(1,), (3,), (5,)]
    seen = []
    inc.run_pending(table(spark, [1, 3, 5]), lambda df: seen.append(df.count()) or df, path, "c")
    assert seen == [0] and result(spark, path) == expected([1, 5])


@pytest.mark.parametrize("step", ["before data", "half of data", "before manifest", "half of manifest"])
def test_a_run_that_dies_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "out")
    inc.run_pending(table(spark, [1]), work, path, "a")
    both = table(spark, [1, 2, 3])

    def die(*_):
        raise RuntimeError("killed")

    def half(folder):
        (tmp_path / "out" / folder / "run=b").mkdir(parents=True)
        work(both).coalesce(1).write.mode("append").parquet(f"{path}/{folder}/run=b")
        (tmp_path / "out" / folder / "run=b" / "_SUCCESS").unlink()

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        if step == "before data":
            inc.run_pending(both, die, path, "b")
        elif step == "half of data":
            half("data")
            die()
        else:
            patch.setattr(inc, "_record", die)
            inc.run_pending(both, work, path, "b")
    if step == "half of manifest":
        half("manifest")
    assert inc.finished_runs(spark, path) == ["a"] and result(spark, path) == expected([1])
    assert inc.run_pending(both, work, path, "b")
    assert result(spark, path) == expected([1, 2])
    assert inc.finished_runs(spark, path) == ["a", "b"]


def test_run_ids_are_names(spark, tmp_path):
    with pytest.raises(ValueError, match="run id"):
        inc.run_pending(table(spark, [1]), work, str(tmp_path), "../x")
