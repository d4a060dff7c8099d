"""Frames as one file per episode, at the paths of the dataset's own template.

A write has three steps, and the dataset is untouched until the second:

1. Tasks stream episodes to files in a staging folder, and list them in a part file of their
   own. The commit message of a task names that part; the commit counts the parts of
   successful attempts only, so a lost or repeated attempt leaves nothing in the result.
2. A job over the counted list moves the files to their places. A file that is already in
   place stays, so the job can be repeated.
3. The list becomes the file index ``meta/files`` (episode, frames, path), written last.

The format wants one file per episode, so one task writes a whole episode; it streams row
groups and never holds the episode. ``sinks.frames`` splits large episodes instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from seqseg.operators.ordered import FRAME
from seqseg.session import ship
from seqseg.sources.datasets import DATA_PATH, DEFAULT_CHUNK, episode_path

_LISTED = "episode_index bigint, n_frames bigint, staged string, path string"
INDEX_SCHEMA = "episode_index bigint, n_frames bigint, path string"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or URI, and the path in it."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@dataclass
class Staged(WriterCommitMessage):
    """Part file that lists what one task attempt wrote."""

    part: str


class EpisodeWriter(DataSourceArrowWriter):
    """Writes rows that come grouped by episode, in frame order."""

    def __init__(self, staging: str, template: str, chunk_size: int):
        self.staging, self.template, self.chunk_size = staging, template, chunk_size

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, folder = _store(self.staging)
        attempt = uuid.uuid4().hex
        store.create_dir(f"{folder}/files/{attempt}", recursive=True)
        store.create_dir(f"{folder}/parts", recursive=True)
        listed, out, current = [], None, None
        for piece in _by_episode(iterator):
            key = (piece.column("dataset")[0].as_py(), piece.column("episode_index")[0].as_py())
            if key != current:
                if out:
                    out.close()
                if listed and listed[-1]["episode_index"] == key[1]:
                    raise ValueError(f"episode {key[1]} belongs to more than one dataset: write one dataset at a time")
                path = episode_path(key[1], self.template, self.chunk_size)
                staged = f"files/{attempt}/{key[1]}.parquet"
                listed.append({"episode_index": key[1], "n_frames": 0, "staged": staged, "path": path})
                schema = piece.schema.remove(piece.schema.get_field_index("dataset"))
                out = pq.ParquetWriter(f"{folder}/{staged}", schema, filesystem=store, compression="zstd")
                current = key
            out.write_batch(piece.select(out.schema.names))
            listed[-1]["n_frames"] += piece.num_rows
        if out:
            out.close()
        types = [("episode_index", pa.int64()), ("n_frames", pa.int64()), ("staged", pa.string()), ("path", pa.string())]
        part = f"{attempt}.parquet"
        pq.write_table(pa.Table.from_pylist(listed, pa.schema(types)), f"{folder}/parts/{part}", filesystem=store)
        return Staged(part)

    def commit(self, messages: list[Staged | None]) -> None:
        store, folder = _store(self.staging)
        store.create_dir(f"{folder}/counted", recursive=True)
        for message in messages:
            if message is not None:
                store.move(f"{folder}/parts/{message.part}", f"{folder}/counted/{message.part}")

    def abort(self, messages: list[Staged | None]) -> None:
        """Staged files of a failed write are never counted; ``write_episodes`` clears them."""


def _by_episode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches that hold one episode of one dataset."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for name in ("dataset", "episode_index"):
            codes = batch.column(name).dictionary_encode().indices.to_numpy()
            change[1:] |= codes[1:] != codes[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            yield batch.slice(start, stop - start)


class EpisodeFiles(DataSource):
    """Sink ``seqseg_episodes`` of options ``staging``, ``template`` and ``chunk_size``."""

    @classmethod
    def name(cls) -> str:
        return "seqseg_episodes"

    def writer(self, schema, overwrite: bool) -> EpisodeWriter:
        return EpisodeWriter(self.options["staging"], self.options["template"], int(self.options["chunk_size"]))


def _move(batches: Iterator[pa.RecordBatch], staging: str, root: str) -> Iterator[pa.RecordBatch]:
    store, source = _store(staging)
    _, target = _store(root)
    for batch in batches:
        for staged, path in zip(batch.column("staged").to_pylist(), batch.column("path").to_pylist()):
            here, there = f"{source}/{staged}", f"{target}/{path}"
            if store.get_file_info(here).type == fs.FileType.File:
                store.create_dir(there.rpartition("/")[0], recursive=True)
                store.move(here, there)
            elif store.get_file_info(there).type != fs.FileType.File:
                raise FileNotFoundError(here)
        yield batch.select(["episode_index", "n_frames", "path"])


def stage_episodes(
    frames: DataFrame, staging: str, template: str = DATA_PATH, chunk_size: int = DEFAULT_CHUNK, order: str = FRAME
) -> None:
    """Step 1: episodes of one dataset as files in the staging folder."""
    spark = frames.sparkSession
    ship(spark)
    spark.dataSource.register(EpisodeFiles)
    grouped = frames.repartition("episode_index").sortWithinPartitions("episode_index", "dataset", order)
    writer = grouped.write.format("seqseg_episodes").mode("append")
    writer.option("staging", staging).option("template", template).option("chunk_size", chunk_size).save()


def publish_episodes(spark: SparkSession, staging: str, root: str) -> None:
    """Steps 2 and 3: staged files to their places, then the index. Can be repeated."""
    listed = spark.read.schema(_LISTED).parquet(f"{staging}/counted")
    moved = listed.mapInArrow(lambda batches: _move(batches, staging, root), INDEX_SCHEMA)
    moved.write.mode("overwrite").parquet(f"{root}/meta/files")


def write_episodes(
    frames: DataFrame, root: str, template: str = DATA_PATH, chunk_size: int = DEFAULT_CHUNK, order: str = FRAME
) -> None:
    """Write the frames of one dataset below ``root`` as the template says.

    Files of the same episodes are replaced, others stay; the index lists the episodes of the
    latest write. ``root`` is a shared path or a URI that Arrow's file systems open.
    Frames of several datasets in one call fail where an episode number meets another's.
    """
    staging = f"{root.rstrip('/')}/_staging/{uuid.uuid4().hex}"
    try:
        stage_episodes(frames, staging, template, chunk_size, order)
        publish_episodes(frames.sparkSession, staging, root.rstrip("/"))
    finally:
        store, folder = _store(staging)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """Episodes of the latest write: ``episode_index, n_frames, path``."""
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{root}/meta/files")
