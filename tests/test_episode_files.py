"""Files at the template's paths, the write protocol, and reads of single episodes."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seqseg.sinks import episodes as ep
from seqseg.sources import datasets as ds


def table(spark, lengths, dataset="robot", shift=0):
    rows = [(dataset, e, t, e * 100 + t + shift, [float(t)]) for e, n in lengths.items() for t in range(n)]
    return spark.createDataFrame(rows, "dataset string, episode_index bigint, frame_index bigint, v bigint, state array<double>")


def rows_of(df):
    return sorted(map(tuple, df.select("dataset", "episode_index", "frame_index", "v", "state").collect()))


def files_of(root):
    return sorted(str(p.relative_to(root)) for p in (root / "data").rglob("*") if p.is_file())


def test_round_trip_by_template(spark, tmp_path):
    frames = table(spark, {0: 5, 7: 1, 1000: 3, 2001: 4})
    ep.write_episodes(frames.orderBy(F.rand(3)), str(tmp_path))
    assert files_of(tmp_path) == [
        "data/chunk-000/episode_000000.parquet", "data/chunk-000/episode_000007.parquet",
        "data/chunk-001/episode_001000.parquet", "data/chunk-002/episode_002001.parquet",
    ]
    assert rows_of(ds.read_frames(spark, str(tmp_path), "robot")) == rows_of(frames)
    one = pq.read_table(tmp_path / "data/chunk-000/episode_000000.parquet")
    assert one.column("frame_index").to_pylist() == list(range(5)) and "dataset" not in one.column_names
    found = {r["episode_index"]: (r["n_frames"], r["path"]) for r in ep.read_index(spark, str(tmp_path)).collect()}
    assert found == {e: (n, ds.episode_path(e)) for e, n in {0: 5, 7: 1, 1000: 3, 2001: 4}.items()}
    assert not list((tmp_path / "_staging").iterdir())


def test_reading_one_episode_opens_one_file(spark, tmp_path):
    frames = table(spark, {0: 2, 1: 3, 1500: 4})
    ep.write_episodes(frames, str(tmp_path))
    some = ds.read_frames(spark, str(tmp_path), "robot", episodes=[1500])
    assert [p.rpartition("/data/")[2] for p in some.inputFiles()] == ["chunk-001/episode_001500.parquet"]
    assert rows_of(some) == rows_of(frames.where("episode_index = 1500"))
    both = ds.read_frames(spark, str(tmp_path), "robot", episodes=[1, 0, 1])
    assert rows_of(both) == rows_of(frames.where("episode_index < 2"))
    with pytest.raises(ValueError):
        ds.read_frames(spark, str(tmp_path), "robot", episodes=[])


def test_a_write_that_dies_between_the_steps_changes_nothing(spark, tmp_path, monkeypatch):
    first, second = table(spark, {0: 3, 1: 2}), table(spark, {0: 4, 2: 2}, shift=50)
    ep.write_episodes(first, str(tmp_path))

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(ep, "publish_episodes", die)
        with pytest.raises(RuntimeError):
            ep.write_episodes(second, str(tmp_path))
    assert rows_of(ds.read_frames(spark, str(tmp_path), "robot")) == rows_of(first)
    ep.write_episodes(second, str(tmp_path))
    assert rows_of(ds.read_frames(spark, str(tmp_path), "robot")) == rows_of(second.unionByName(first.where("episode_index = 1")))


def test_publishing_can_be_repeated(spark, tmp_path):
    frames = table(spark, {0: 3, 1: 2, 2: 1})
    staging = str(tmp_path / "_staging/x")
    ep.stage_episodes(frames, staging)
    assert not (tmp_path / "data").exists()
    counted = spark.read.schema(ep._LISTED).parquet(f"{staging}/counted")
    # A publish that stopped after one file.
    moved = next(r for r in counted.collect() if r["episode_index"] == 1)
    (tmp_path / "data/chunk-000").mkdir(parents=True)
    (tmp_path / "_staging/x" / moved["staged"]).rename(tmp_path / moved["path"])
    for _ in range(2):
        ep.publish_episodes(spark, staging, str(tmp_path))
        assert rows_of(ds.read_frames(spark, str(tmp_path), "robot")) == rows_of(frames)
        assert ep.read_index(spark, str(tmp_path)).count() == 3


def test_parts_of_lost_attempts_do_not_count(tmp_path):
    import pyarrow as pa

    columns = {"dataset": ["d", "d", "d"], "episode_index": [4, 4, 5], "frame_index": [0, 1, 0]}
    batch = pa.RecordBatch.from_pydict(columns)
    writer = ep.EpisodeWriter(str(tmp_path), ds.DATA_PATH, 1000)
    writer.write(iter([batch]))
    kept = writer.write(iter([batch.slice(0, 1), batch.slice(1)]))
    writer.commit([kept, None])
    assert [p.name for p in (tmp_path / "counted").iterdir()] == [kept.part]
    listed = pq.read_table(tmp_path / "counted" / kept.part).to_pylist()
    assert [(r["episode_index"], r["n_frames"]) for r in listed] == [(4, 2), (5, 1)]


def test_datasets_that_share_an_episode_number_fail(spark, tmp_path):
    mixed = table(spark, {0: 2}).unionByName(table(spark, {0: 2}, "other"))
    with pytest.raises(Exception, match="more than one dataset"):
        ep.write_episodes(mixed, str(tmp_path))
    assert not (tmp_path / "data").exists()


def test_no_frames(spark, tmp_path):
    ep.write_episodes(table(spark, {0: 1}).where("false"), str(tmp_path))
    assert ep.read_index(spark, str(tmp_path)).count() == 0 and not (tmp_path / "data").exists()
