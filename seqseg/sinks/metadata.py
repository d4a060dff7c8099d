"""Dataset metadata: info, JSON lines, label dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def dataset_totals(episodes: DataFrame) -> DataFrame:
    """Totals and the single training split of the written dataset."""
    return episodes.agg(
        F.count(F.lit(1)).alias("total_episodes"),
        F.coalesce(F.sum("length"), F.lit(0).cast("long")).alias("total_frames"),
    ).withColumn("train", F.format_string("0:%d", F.col("total_episodes")))


def updated_info(info: DataFrame, episodes: DataFrame) -> DataFrame:
    """The info document of the written dataset as JSON text (one row ``value``).

    All keys of the source document (``record`` of ``read_info``) are kept; totals and
    ``splits`` are replaced. Without a source document only the new keys are written.
    """
    totals = dataset_totals(episodes).select(
        F.to_variant_object(F.map_from_arrays(F.array(F.lit("train")), F.array("train"))).alias("splits"),
        F.col("total_episodes").cast("variant").alias("total_episodes"),
        F.col("total_frames").cast("variant").alias("total_frames"),
    )
    names = ("total_episodes", "total_frames", "splits")
    fresh = totals.select(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)).alias("_entries"))
    known = info.select(F.from_json(F.to_json("record"), "map<string,variant>").alias("_entries")).limit(1)
    kept = known.select(F.map_filter("_entries", lambda k, _: ~k.isin(*names)).alias("_entries"))
    both = F.flatten(F.transform(F.collect_list("_entries"), lambda m: F.map_entries(m)))
    return kept.unionByName(fresh).agg(F.to_json(F.map_from_entries(both)).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row; null fields are left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def dictionary_json(vocab: DataFrame) -> DataFrame:
    """Dictionary as one JSON object ``{"id": "name"}`` (a dimension: one row, always)."""
    entries = F.array_sort(F.collect_list(F.struct("action_text_id", "name")))
    as_map = F.map_from_entries(
        F.transform(entries, lambda e: F.struct(e["action_text_id"].cast("string"), e["name"]))
    )
    return vocab.agg(F.to_json(as_map).alias("value"))


def episode_records(episodes: DataFrame, nested: DataFrame) -> DataFrame:
    """Episode metadata with ``action_config`` and ``length`` replaced.

    Unknown keys of the source record are kept; every episode is one record.
    """
    keys = ["dataset", "episode_index"]
    known = F.from_json(F.to_json("record"), "map<string,variant>")
    other = F.map_filter(known, lambda k, _: ~k.isin("action_config", "length"))
    joined = episodes.select(*keys, other.alias("_other")).join(nested, keys)
    fresh = F.map_from_arrays(
        F.array(F.lit("action_config"), F.lit("length")),
        F.array(F.to_variant_object("action_config"), F.col("length").cast("variant")),
    )
    return joined.select(F.to_json(F.map_concat("_other", fresh)).alias("value"))


def write_metadata(
    root: str,
    info: DataFrame,
    tasks: DataFrame,
    episodes: DataFrame,
    vocab: DataFrame,
    stats: DataFrame | None = None,
    mode: str = "errorifexists",
) -> None:
    """All metadata of a dataset below ``root/meta``, one folder of text parts each.

    ``info``, ``episodes`` and ``stats`` hold finished JSON text in ``value``.
    """
    info.write.mode(mode).text(f"{root}/meta/info.json")
    write_json_lines(tasks, f"{root}/meta/tasks.jsonl", mode)
    episodes.write.mode(mode).text(f"{root}/meta/episodes.jsonl")
    dictionary_json(vocab).write.mode(mode).text(f"{root}/meta/action_text.json")
    if stats is not None:
        stats.write.mode(mode).text(f"{root}/meta/episodes_stats.jsonl")
