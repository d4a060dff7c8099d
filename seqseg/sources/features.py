"""Bulk conversion of array files to feature tables.

Array files are opened once, by a distributed job, and stored as Parquet
(``seqseg.sinks.features``); everything afterwards is native.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqseg.session import ship
from seqseg.sources.lines import file_stem, files

ROWS_PER_BATCH = 2_000
SCHEMA = (
    "video_id string, frame_index bigint, rgb array<float>, flow array<float>, label bigint, "
    "meta string, problem string"
)


def _frames(video: str, columns: dict, length: int) -> Iterator[pd.DataFrame]:
    for a in range(0, length, ROWS_PER_BATCH):
        b = min(a + ROWS_PER_BATCH, length)
        out = {"video_id": [video] * (b - a), "frame_index": np.arange(a, b)}
        for name in ("rgb", "flow"):
            values = columns.get(name)
            out[name] = [None] * (b - a) if values is None else list(values[a:b].astype(np.float32))
        labels = columns.get("label")
        out["label"] = [None] * (b - a) if labels is None else pd.array(labels[a:b], dtype="Int64")
        out["meta"] = [columns.get("meta")] * (b - a)
        out["problem"] = [None] * (b - a)
        yield pd.DataFrame(out)


def _problem(video: str, text: str) -> pd.DataFrame:
    row = dict.fromkeys(("frame_index", "rgb", "flow", "label", "meta"))
    return pd.DataFrame([{"video_id": video, **row, "problem": text}])


def _convert(spark: SparkSession, path: str, pattern: str, unpack) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, content in zip(batch["video_id"], batch["content"]):
                try:
                    columns, length = unpack(content)
                except (KeyError, ValueError) as error:
                    yield _problem(video, str(error))
                    continue
                yield from _frames(video, columns, length)

    ship(spark)
    found = files(spark, path, pattern).select(file_stem(F.col("path")).alias("video_id"), "content")
    return found.mapInPandas(run, SCHEMA)


def read_two_stream_arrays(spark: SparkSession, path: str, width: int = 1024) -> DataFrame:
    """``.npy`` files of ``[T, 2 * width]`` or ``[2 * width, T]``, split into two streams."""

    def unpack(content: bytes):
        values = np.load(io.BytesIO(content), allow_pickle=False)
        if values.ndim != 2:
            raise ValueError(f"expected two dimensions, got shape {values.shape}")
        both = 2 * width
        if values.shape[0] == both and values.shape[1] != both:
            values = values.T
        if values.shape[1] != both:
            raise ValueError(f"expected width {both}, got {values.shape[1]}")
        return {"rgb": values[:, :width], "flow": values[:, width:]}, len(values)

    return _convert(spark, path, "*.npy", unpack)


def read_feature_archives(
    spark: SparkSession, path: str, width: int | None = None, require_labels: bool = True
) -> DataFrame:
    """``.npz`` files with ``rgb``, ``flow``, ``labels`` and ``meta``.

    An empty stream is a null column; ``meta`` stays JSON text. Files that fail a
    check give one row with ``problem`` set.
    """

    def unpack(content: bytes):
        with np.load(io.BytesIO(content), allow_pickle=False) as archive:
            held = {name: archive[name] for name in archive.files}
        needed = ("rgb", "flow", "labels") if require_labels else ("rgb",)
        for name in needed:
            if name not in held:
                raise KeyError(f"missing array {name}")
        streams = {n: held.get(n) for n in ("rgb", "flow")}
        streams = {n: (v if v is not None and v.size else None) for n, v in streams.items()}
        shapes = {v.shape for v in streams.values() if v is not None}
        if len(shapes) > 1:
            raise ValueError(f"streams differ in shape: {sorted(shapes)}")
        if width is not None and shapes and next(iter(shapes))[1:] != (width,):
            raise ValueError(f"expected width {width}, got shape {next(iter(shapes))}")
        labels = held.get("labels")
        if labels is not None and labels.ndim != 1:
            raise ValueError(f"labels must have one dimension, got shape {labels.shape}")
        if labels is not None and not labels.size:
            labels = None
        length = next(iter(shapes))[0] if shapes else (0 if labels is None else len(labels))
        if labels is not None and len(labels) < length:
            length = len(labels)
        meta = str(held["meta"]) if "meta" in held else None
        label = None if labels is None else labels.astype(np.int64)
        return {**streams, "label": label, "meta": meta}, length

    return _convert(spark, path, "*.npz", unpack)
