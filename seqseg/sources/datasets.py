"""Episode datasets: metadata, frames, media, grammar.

Layout: ``meta/info.json``, ``meta/episodes.jsonl``, ``meta/tasks.jsonl``,
``meta/action_text.json``, ``data/chunk-000/episode_000000.parquet`` and
``videos/chunk-000/<camera>/episode_000000.mp4``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqseg.functions.text import strip
from seqseg.operators.ordered import FRAME
from seqseg.sources.lines import files, placed

# Default path template and the media extensions.
DATA_PATH = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".webm", ".m4v")
DEFAULT_CHUNK = 1000

CONFIG_TYPE = (
    "array<struct<start_frame:bigint,end_frame:bigint,english_action_text:string,action_text_id:bigint>>"
)


def _text(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """File content; an absent file is an empty table."""
    try:
        return spark.read.text(path, wholetext=whole).select("value")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines file as VARIANT ``record``; blank lines are skipped."""
    lines = _text(spark, path, False).where(strip(F.col("value")) != "")
    return lines.select(F.parse_json("value").alias("record"))


def read_json_object(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document as one VARIANT row, or no row when the file is absent."""
    return _text(spark, path, True).select(F.parse_json("value").alias("record"))


def field(name: str, kind: str) -> Column:
    return F.try_variant_get("record", f"$.{name}", kind)


def read_episodes(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """``episodes.jsonl``: unknown keys stay in ``record``; ``tasks`` stays JSON text."""
    records = read_json_lines(spark, f"{root}/meta/episodes.jsonl")
    return records.select(
        F.lit(dataset).alias("dataset"),
        field("episode_index", "bigint").alias("episode_index"),
        field("length", "bigint").alias("length"),
        F.to_json(field("tasks", "variant")).alias("tasks"),
        field("task_index", "bigint").alias("task_index"),
        field("task", "string").alias("task"),
        field("action_config", CONFIG_TYPE).alias("action_config"),
        "record",
    ).where(F.col("episode_index").isNotNull())


def read_tasks(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Task dictionary; ``place`` orders the lines, because the first entry of a number wins."""
    schema = "dataset string, task_index bigint, task string, place struct<offset:bigint,seq:bigint>"
    try:
        lines = placed(spark.read.text(f"{root}/meta/tasks.jsonl")).where(strip(F.col("value")) != "")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return lines.withColumn("record", F.parse_json("value")).select(
        F.lit(dataset).alias("dataset"),
        field("task_index", "bigint").alias("task_index"),
        F.coalesce(field("task", "string"), F.lit("")).alias("task"),
        F.struct(F.col("_offset").alias("offset"), F.col("_seq").alias("seq")).alias("place"),
    )


def read_info(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    return read_json_object(spark, f"{root}/meta/info.json").select(
        F.lit(dataset).alias("dataset"),
        F.coalesce(field("chunks_size", "bigint"), F.lit(DEFAULT_CHUNK)).alias("chunks_size"),
        F.coalesce(field("data_path", "string"), F.lit(DATA_PATH)).alias("data_path"),
        field("total_episodes", "bigint").alias("total_episodes"),
        field("total_frames", "bigint").alias("total_frames"),
        "record",
    )


def read_action_text(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Label dictionary ``{"0": "name"}``; keys that are not integers are dropped.

    A written dictionary may come as several objects, one per line.
    """
    objects = _text(spark, path, True).select(F.explode(F.split("value", r"(?<=\})\s*\n(?=\{)")).alias("o"))
    pairs = objects.select(F.explode(F.from_json("o", "map<string,string>")).alias("k", "name"))
    ids = pairs.select(F.trim("k").try_cast("bigint").alias("action_text_id"), "name")
    ids = ids.where(F.col("action_text_id").isNotNull())
    return ids if dataset is None else ids.withColumn("dataset", F.lit(dataset))


def episode_path(episode: int, template: str = DATA_PATH, chunk_size: int = DEFAULT_CHUNK) -> str:
    """Path of an episode's file below the dataset folder."""
    return template.format(episode_chunk=episode // chunk_size, episode_index=episode)


def episode_pattern(template: str = DATA_PATH) -> str:
    """Regular expression for the episode number in a path made from ``template``."""
    parts = re.split(r"(\{[^}]*\})", template)
    return "".join(
        r"(\d+)" if p.startswith("{episode_index") else r"[^/]*" if p.startswith("{") else re.escape(p)
        for p in parts
    )


def read_frames(
    spark: SparkSession,
    root: str,
    dataset: str,
    order: str | None = None,
    schema: str | None = None,
    pattern: str = r"episode[_=](\d+)",
    episodes: Sequence[int] | None = None,
    template: str = DATA_PATH,
    chunk_size: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Frames of all episodes of a dataset in one scan.

    The episode comes from the file path. The frame position is the ``order`` column
    if given, else an existing ``frame_index``, else the row position in the file. A
    column that only some files have is null in the others. Give ``schema`` for large
    datasets, which saves reading all footers first. With ``episodes`` only the files that
    ``template`` names for them are listed and opened; one that is absent fails.
    """
    reader = spark.read if episodes is not None else spark.read.option("recursiveFileLookup", "true")
    reader = reader.schema(schema) if schema else reader.option("mergeSchema", "true")
    named = [f"{root}/{episode_path(e, template, chunk_size)}" for e in sorted(set(episodes or []))]
    if episodes is not None and not named:
        raise ValueError("episodes is empty")
    scan = reader.parquet(*(named or [f"{root}/data"]))
    position = order or (FRAME if FRAME in scan.columns else None)
    place = F.col(position) if position else F.col("_metadata.row_index")
    # Path templates number files per episode; the last match is the file itself.
    number = F.element_at(F.regexp_extract_all("_metadata.file_path", F.lit(pattern), 1), -1)
    passed = [c for c in scan.columns if c not in (FRAME, "dataset", "episode_index")]
    return scan.select(
        F.lit(dataset).alias("dataset"),
        number.cast("bigint").alias("episode_index"),
        place.cast("bigint").alias(FRAME),
        *passed,
    )


def read_media(spark: SparkSession, root: str, dataset: str, content_hash: bool = False) -> DataFrame:
    """Inventory of video files: camera, episode, size and optionally an MD5 of the content."""
    scan = files(spark, f"{root}/videos")
    relative = F.regexp_replace("path", r"^.*/videos/", "videos/")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    columns = [
        F.lit(dataset).alias("dataset"),
        F.regexp_extract("path", r"episode_(\d+)\.[^./]*$", 1).try_cast("bigint").alias("episode_index"),
        F.element_at(F.split("path", "/"), -2).alias("camera"),
        relative.alias("path"),
        F.col("length").alias("bytes"),
    ]
    if content_hash:
        columns.append(F.md5("content").alias("md5"))
    return scan.where(extension.isin(*VIDEO_EXTENSIONS)).select(*columns)


def read_grammar(spark: SparkSession, path: str) -> DataFrame:
    """Grammar files to one ``(task, pos, name)`` table; a malformed file is an error.

    Grammars are small by nature and parsed on the driver; a task may be in one file only.
    """
    import yaml

    tasks: dict = {}
    for row in spark.read.text(path, wholetext=True).collect():
        parsed = yaml.safe_load(row["value"])
        found = grammar_tasks(parsed)
        if twice := sorted(map(str, tasks.keys() & found.keys())):
            raise ValueError(f"tasks in several grammar files: {twice}")
        tasks |= found
    return grammar_table(spark, {"tasks": tasks})


def grammar_tasks(grammar: object) -> dict:
    if not isinstance(grammar, dict) or not isinstance(grammar.get("tasks"), dict) or not grammar["tasks"]:
        raise ValueError("grammar needs a non-empty 'tasks' mapping")
    return grammar["tasks"]


def grammar_table(spark: SparkSession, grammar: object) -> DataFrame:
    """Check the structure of a parsed grammar and make it a table."""
    rows = []
    for task, spec in grammar_tasks(grammar).items():
        sequence = spec.get("sequence") if isinstance(spec, dict) else None
        if not isinstance(sequence, list) or not sequence:
            raise ValueError(f"task {task!r} needs a non-empty 'sequence' list")
        for pos, name in enumerate(sequence):
            if not isinstance(name, str):
                raise ValueError(f"task {task!r} has a name that is not a string: {name!r}")
            rows.append((str(task), pos, name))
    return spark.createDataFrame(rows, "task string, pos int, name string")
