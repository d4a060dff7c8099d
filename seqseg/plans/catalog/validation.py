"""Checks, episode selection and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqseg.operators import resample as rs, select as sl, validate as va, vocab as vc
from seqseg.operators.ordered import FRAME, KEYS, rank_rows
from seqseg.plans import adapters as ad
from seqseg.plans.catalog._sql import EM, EV, VOCAB, with_

E = "episode_index"


def contiguity_violations(spark, sf):
    """Frame numbers against row positions in a file that lacks the 'view' rows."""
    rows = ad.ev_rows(spark, sf).withColumnRenamed(FRAME, "frame_idx").where("label <> 'view'")
    # Frame numbers are dense, so 1024 of them are a coarse group.
    coarse = F.floor(F.col("frame_idx") / F.lit(1024)).cast("long")
    placed = rank_rows(rows, KEYS, ["frame_idx"], [coarse], out="position")
    found = va.contiguity_violations(placed)
    return found.select(E, "position", F.col("found").alias("found"), "kind", "offending")


def shape_violations(spark, sf):
    """Streams cut by the label, so that some rows have a wrong shape."""
    features = ad.em_features(spark, sf)
    cut = features.withColumn(
        "rgb", F.slice("embedding", F.lit(1), F.when(F.col("label") == 3, 31).otherwise(32))
    ).withColumn("flow", F.slice("embedding", F.lit(33), F.when(F.col("label") > 6, 30).otherwise(32)))
    bad = va.shape_violations(cut, 32)
    return bad.select(E, FRAME, F.col("rgb_size").cast("long").alias("rgb_size"),
                      F.col("flow_size").cast("long").alias("flow_size"), "reason")


def unknown_labels(spark, sf):
    high = ad.table(spark, sf, "events").where("event_type <> 'signup'").select(F.col("event_type").alias("name"))
    return va_unknown(spark, sf, high)


def va_unknown(spark, sf, names):
    events = ad.table(spark, sf, "events").select(F.col("event_type").alias("label"))
    return vc.unknown_labels(events, names.distinct()).select("label", "n_frames")


def aligned_streams(spark, sf):
    """Turns, vectors and events with the same number, cut to their common length."""
    turns = ad.cv_turns(spark, sf).select(E, FRAME, "role")
    vectors = ad.em_features(spark, sf).select(E, FRAME, F.col("label").alias("vector_label"))
    events = ad.ev_frames(spark, sf).select(E, FRAME, "label")
    return va.align_streams([turns, vectors, events], [E])


def aligned_arrays(spark, sf):
    turns = ad.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.split("text", " ").alias("a"), F.split("text", "\\.").alias("b")
    )
    a, b = va.align_arrays(["a", "b"])
    return turns.select("conv_id", "turn", F.size(a).cast("long").alias("n_a"), F.size(b).cast("long").alias("n_b"))


def example_violations(spark, sf):
    """Conversation turns written as JSON examples with missing or mistyped fields."""
    size = F.length("text")
    turns = ad.table(spark, sf, "conversations")
    text = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.substring(text, 6, 2_000_000_000)
    frames = F.when(size < 40, "[]").otherwise(F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]")))
    record = F.concat(
        F.when(size > 400, F.lit('{"x":1')).otherwise(F.concat(F.lit('{"frames":'), frames)),
        F.when(F.col("role") == "system", F.lit("")).otherwise(F.concat(F.lit(',"task_text":'), F.substring(quoted, F.lit(1), F.length(quoted) - 1))),
        F.lit(',"subtask_text":'),
        F.when(F.col("turn") > 4, F.col("turn").cast("string")).otherwise(F.lit('"pick"')),
        F.lit("}"),
    )
    return va.example_violations(turns.select("conv_id", "turn", record.alias("record")), ["conv_id", "turn"])


def _episodes(spark, sf):
    events = ad.table(spark, sf, "events").groupBy(F.col("user_id").alias(E)).agg(
        F.count(F.lit(1)).alias("length"),
        F.max(F.col("value") > 150).alias("has_labels"),
        F.max(F.col("value") > 320).alias("failed"),
    )
    media = ad.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias(E)).agg(
        F.max(F.col("o_totalprice") > 100000).alias("has_media")
    )
    customers = ad.table(spark, sf, "customer").select(F.lit("customer").alias("dataset"), F.col("c_custkey").alias(E))
    joined = customers.join(events, E, "left").join(media, E, "left")
    return joined.select(
        *KEYS,
        F.coalesce("has_media", F.lit(False)).alias("has_media"),
        F.col("length").isNotNull().alias("has_frames"),
        F.coalesce("has_labels", F.lit(False)).alias("has_labels"),
        F.coalesce("length", F.lit(0)).alias("length"),
        F.coalesce("failed", F.lit(False)).alias("failed"),
    )


def skip_reasons(spark, sf):
    judged = va.skip_reasons(_episodes(spark, sf), 65)
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).where("reason is not null")


def labelling_summary(spark, sf):
    from seqseg.plans.labelling import labelling_summary as summarise

    judged = va.skip_reasons(_episodes(spark, sf), 65)
    segments = judged.select(*KEYS, (F.col("length") / 10).cast("long").alias("n_segments"))
    media = ad.table(spark, sf, "orders").select(
        F.lit("customer").alias("dataset"),
        F.col("o_custkey").alias(E),
        F.when(F.col("o_orderstatus") == "O", "hardlink").when(F.col("o_orderstatus") == "P", "symlink").otherwise("skipped").alias("status"),
    )
    return summarise(judged, segments, media)


def limit_per_dataset(spark, sf):
    customers = ad.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias(E))
    return sl.limit_per_dataset(customers, 7)


def stacked_datasets(spark, sf):
    """Three datasets with different columns in one table."""
    a = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias(E), F.col("c_mktsegment").alias("task"))
    b = ad.table(spark, sf, "supplier").select(F.col("s_suppkey").alias(E))
    c = ad.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias(E), F.col("n_name").alias("task"))
    return sl.stack_datasets([a, b, c], ["front"]).select(E, "task", F.col("dataset_idx").cast("long").alias("dataset_idx"), "camera")


def _splits(spark, sf):
    labels = ad.table(spark, sf, "labels")
    return labels.select(F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"), F.col("doc_id").alias("video_id"))


def split_members(spark, sf):
    docs = ad.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), "lang", "n_chars")
    return sl.split_members(docs, _splits(spark, sf), "val")


def incremental_work(spark, sf):
    users = ad.ev_lengths(spark, sf)
    done = ad.table(spark, sf, "orders").where("o_totalprice > 300000").select(
        F.lit("events").alias("dataset"), F.col("o_custkey").alias(E)
    )
    return sl.pending(users, done).select(E, "length")


def manifest_after_run(spark, sf):
    users = ad.ev_lengths(spark, sf)
    done = ad.table(spark, sf, "orders").where("o_totalprice > 300000").select(
        F.lit("events").alias("dataset"), F.col("o_custkey").alias(E)
    )
    return sl.extended_manifest(done, sl.pending(users, done))


def relabelled_frames(spark, sf):
    """Predictions for the first seven eighths of each episode, padded to its end."""
    from seqseg.sinks.frames import relabel

    frames = ad.ev_frames(spark, sf)
    short = frames.where(F.col(FRAME) < F.floor(F.col("length") * 7 / 8)).select(
        *KEYS, FRAME, F.length("label").cast("long").alias("action_text_id")
    )
    return relabel(frames.drop("length"), short).select(E, FRAME, "label", "value", "action_text_id")


QUERIES = {
    "contiguity_violations": contiguity_violations,
    "shape_violations": shape_violations,
    "unknown_labels": unknown_labels,
    "aligned_streams": aligned_streams,
    "aligned_arrays": aligned_arrays,
    "example_violations": example_violations,
    "skip_reasons": skip_reasons,
    "labelling_summary": labelling_summary,
    "limit_per_dataset": limit_per_dataset,
    "stacked_datasets": stacked_datasets,
    "split_members": split_members,
    "incremental_work": incremental_work,
    "manifest_after_run": manifest_after_run,
    "relabelled_frames": relabelled_frames,
}

_EPISODES = """eps AS (
  SELECT c.c_custkey AS e, coalesce(m.media, FALSE) AS media, v.n IS NOT NULL AS frames,
    coalesce(v.labels, FALSE) AS labels, coalesce(v.n, 0) AS n, coalesce(v.failed, FALSE) AS failed
  FROM customer c
  LEFT JOIN (SELECT user_id, count(*) AS n, bool_or(value > 150) AS labels, bool_or(value > 320) AS failed FROM events GROUP BY 1) v ON v.user_id = c.c_custkey
  LEFT JOIN (SELECT o_custkey, bool_or(o_totalprice > 100000) AS media FROM orders GROUP BY 1) m ON m.o_custkey = c.c_custkey),
why AS (SELECT *, CASE WHEN NOT media THEN 'missing_media' WHEN NOT frames THEN 'missing_frames'
  WHEN NOT labels THEN 'unlabeled' WHEN n < 65 THEN 'too_short' WHEN failed THEN 'failed' END AS reason FROM eps)"""

ORACLES = {
    "contiguity_violations": with_(
        EV,
        """held AS (SELECT episode_index, frame_index AS found,
          row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS position FROM ev WHERE label <> 'view')""",
    )
    + """SELECT episode_index, position, found,
  CASE WHEN found < position THEN 'out_of_order_or_duplicate' ELSE 'missing' END AS kind, least(found, position) AS offending
FROM held WHERE found <> position QUALIFY row_number() OVER (PARTITION BY episode_index ORDER BY position) = 1""",
    "shape_violations": with_(EM)
    + """SELECT episode_index, frame_index::BIGINT AS frame_index,
  (CASE WHEN label = 3 THEN 31 ELSE 32 END)::BIGINT AS rgb_size, (CASE WHEN label > 6 THEN 30 ELSE 32 END)::BIGINT AS flow_size,
  CASE WHEN label = 3 THEN 'rgb_width' ELSE 'flow_shape' END AS reason FROM em WHERE label = 3 OR label > 6""",
    "unknown_labels": """SELECT event_type AS label, count(*)::BIGINT AS n_frames FROM events
WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_type <> 'signup') GROUP BY 1""",
    "aligned_streams": with_(EV, EM)
    + """SELECT c.conv_id AS episode_index, c.turn::BIGINT AS frame_index, c.role, m.label AS vector_label, e.label
FROM conversations c JOIN em m ON m.episode_index = c.conv_id AND m.frame_index = c.turn
JOIN ev e ON e.episode_index = c.conv_id AND e.frame_index = c.turn""",
    "aligned_arrays": """SELECT conv_id, turn, n AS n_a, n AS n_b FROM (
  SELECT conv_id, turn, least(len(string_split(text, ' ')), len(string_split(text, '.')))::BIGINT AS n FROM conversations)""",
    "example_violations": """SELECT conv_id, turn, reason FROM (SELECT conv_id, turn,
  CASE WHEN length(text) > 400 THEN 'missing frames' WHEN role = 'system' THEN 'missing task_text'
       WHEN length(text) < 40 THEN 'empty frames' WHEN turn > 4 THEN 'subtask_text is not a string' END AS reason
  FROM conversations) WHERE reason IS NOT NULL""",
    "skip_reasons": with_(_EPISODES) + "SELECT reason, count(*)::BIGINT AS n FROM why WHERE reason IS NOT NULL GROUP BY 1",
    "labelling_summary": with_(_EPISODES)
    + """SELECT count(*)::BIGINT AS n_episodes_input, (count(*) FILTER (reason IS NULL))::BIGINT AS n_episodes_processed,
  count(reason)::BIGINT AS n_episodes_skipped, (sum(n // 10) FILTER (reason IS NULL))::BIGINT AS n_segments_total,
  (SELECT count(*) FROM orders o JOIN why w ON w.e = o.o_custkey AND w.reason IS NULL WHERE o.o_orderstatus = 'O')::BIGINT AS n_hardlink,
  (SELECT count(*) FROM orders o JOIN why w ON w.e = o.o_custkey AND w.reason IS NULL WHERE o.o_orderstatus = 'P')::BIGINT AS n_symlink,
  (SELECT count(*) FROM orders o JOIN why w ON w.e = o.o_custkey AND w.reason IS NULL WHERE o.o_orderstatus NOT IN ('O', 'P'))::BIGINT AS n_skipped_media
FROM why""",
    "limit_per_dataset": """SELECT c_mktsegment AS dataset, c_custkey AS episode_index FROM customer
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= 7""",
    "stacked_datasets": """SELECT c_custkey AS episode_index, c_mktsegment AS task, 0::BIGINT AS dataset_idx, 'front' AS camera FROM customer
UNION ALL SELECT s_suppkey, NULL, 1, 'front' FROM supplier UNION ALL SELECT n_nationkey, n_name, 2, 'front' FROM nation""",
    "split_members": """SELECT doc_id AS video_id, lang, n_chars FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality <> 1)""",
    "incremental_work": """SELECT user_id AS episode_index, count(*)::BIGINT AS length FROM events
WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1""",
    "manifest_after_run": """SELECT 'events' AS dataset, episode_index FROM (
  SELECT o_custkey AS episode_index FROM orders WHERE o_totalprice > 300000 UNION SELECT user_id FROM events)""",
    "relabelled_frames": with_(EV, "len AS (SELECT episode_index, count(*) AS t FROM ev GROUP BY 1)")
    + """SELECT e.episode_index, e.frame_index::BIGINT AS frame_index, e.label, e.value,
  coalesce(length(p.label), 0)::BIGINT AS action_text_id
FROM ev e JOIN len l USING (episode_index)
LEFT JOIN ev p ON p.episode_index = e.episode_index AND p.frame_index = least(e.frame_index, l.t * 7 // 8 - 1)""",
}
