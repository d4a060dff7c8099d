"""Automatic labelling: scores and texts to a relabelled dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seqseg.operators.ordered import KEYS, one_row


def episode_summary(
    segments: DataFrame, task_text: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Segment count, frame count, task and ordered texts: one row for every episode."""
    ordered = F.array_sort(F.collect_list(F.struct("segment_index", "text")))
    totals = segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.max("length").cast("long").alias("n_frames"),
        F.transform(ordered, lambda s: s["text"]).alias("subtask_texts"),
    )
    return (
        totals.join(task_text.select(*keys, "task_text"), list(keys), "left")
        .withColumn("task_text", F.coalesce("task_text", F.lit("")))
    )


def labelling_summary(
    judged: DataFrame, segments: DataFrame, media: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row: episodes in, processed and skipped, segments, media outcomes.

    ``judged`` carries the skip ``reason`` of every episode; segments and media count
    for processed episodes only.
    """
    done = judged.where(F.col("reason").isNull()).select(*keys)
    episodes = judged.agg(
        F.count(F.lit(1)).alias("n_episodes_input"),
        F.count_if(F.col("reason").isNull()).alias("n_episodes_processed"),
        F.count("reason").alias("n_episodes_skipped"),
    )
    total = segments.join(done, list(keys), "left_semi").agg(
        F.coalesce(F.sum("n_segments"), F.lit(0).cast("long")).alias("n_segments_total")
    )
    outcomes = media.join(done, list(keys), "left_semi").agg(
        F.count_if(F.col("status") == "hardlink").alias("n_hardlink"),
        F.count_if(F.col("status") == "symlink").alias("n_symlink"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped_media"),
    )
    return one_row([episodes, total, outcomes])


def label_segments(segments: DataFrame, labeler, columns: Sequence[str]) -> DataFrame:
    """Attach ``text`` from a pluggable batch labeler.

    ``labeler`` takes a pandas DataFrame (one Arrow batch) and returns one text per
    row. A batch that fails is tried row by row; a row that fails, and any unusable
    text, becomes ``unknown``.
    """
    import pandas as pd

    from seqseg.functions.text import clean_label
    from seqseg.session import ship

    kept = list(columns)

    def call(batch: pd.DataFrame) -> list:
        try:
            texts = list(labeler(batch))
            if len(texts) == len(batch):
                return texts
        except Exception:  # noqa: BLE001 - one bad segment must not stop the rest
            pass
        if len(batch) == 1:
            return [None]
        return [text for i in range(len(batch)) for text in call(batch.iloc[i : i + 1])]

    def run(batches):
        for batch in batches:
            yield batch.assign(text=[None if t is None else str(t) for t in call(batch)])

    ship(segments.sparkSession)
    source = segments.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInPandas(run, f"{schema}, text string").withColumn("text", clean_label(F.col("text")))


def relabel_dataset(
    probs: DataFrame,
    frames: DataFrame,
    episodes: DataFrame,
    tasks: DataFrame,
    labeler,
    target,
    keys: Sequence[str] = KEYS,
    **segmenting,
) -> dict[str, DataFrame]:
    """Boundary scores to a relabelled dataset.

    ``labeler`` is a table of texts (``keys, segment_index, text``) or a function for
    ``label_segments``. Returns segments, vocabulary, frames, nested episode metadata,
    totals and the per-episode summary. The vocabulary numbers phrases in the order of
    episodes and segments with one aggregation instead of a running dictionary.
    """
    from seqseg.operators import runs as rn, vocab as vc
    from seqseg.operators.peaks import segments_from_probs
    from seqseg.plans.tasks import resolve_task_text
    from seqseg.session import settle
    from seqseg.sinks.frames import relabel
    from seqseg.sinks.metadata import dataset_totals

    segments = segments_from_probs(probs, target, keys=keys, **segmenting)
    if isinstance(labeler, DataFrame):
        labelled = rn.align_texts(segments, labeler, keys)
    else:
        labelled = label_segments(segments, labeler, segments.columns)
    labelled = settle(labelled)
    vocab = settle(vc.first_seen(labelled, "text", keys))
    with_ids = vc.apply_first_seen(labelled, vocab, "text")
    sizes = labelled.groupBy(*keys).agg(F.max("length").alias("length"))
    dense = settle(rn.expand_segments(with_ids, sizes, keys=keys))
    fused = rn.segment_texts(rn.runs(dense, "action_text_id", keys), vocab)
    nested = rn.nested_segments(fused, keys).join(sizes, list(keys))
    task_text = resolve_task_text(episodes, tasks)
    return {
        "segments": with_ids,
        "vocab": vocab.select("action_text_id", "name"),
        "frames": relabel(frames, dense, "action_text_id", keys),
        "episodes": nested,
        "info": dataset_totals(sizes),
        "summary": episode_summary(labelled, task_text, keys),
    }
