"""Runs, segments and their metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqseg.functions import text as tx
from seqseg.operators import runs as rn, vocab as vc
from seqseg.operators.ordered import FRAME, KEYS
from seqseg.plans import adapters as ad
from seqseg.plans.catalog._sql import EV, LI, VOCAB, runs_cte, with_

E = "episode_index"
SEG = [E, "segment_index", "start_frame", "end_frame"]


def _ev_runs(spark, sf):
    return rn.runs(ad.ev_frames(spark, sf))


def _ev_vocab(spark, sf):
    return vc.union_vocab(ad.table(spark, sf, "events"), "event_type")


def _ev_dictionary(spark, sf):
    """Names of all event types but one, which has none."""
    high = ad.table(spark, sf, "events").where("event_type <> 'signup'").select(F.col("event_type").alias("name"))
    return _ev_vocab(spark, sf).join(high.distinct(), "name", "left_semi")


def _ev_ids(spark, sf):
    """Runs with dictionary ids."""
    vocab = _ev_vocab(spark, sf)
    return _ev_runs(spark, sf).join(vocab.withColumnRenamed("name", "label"), "label")


def _ev_config(spark, sf):
    return rn.segment_texts(_ev_ids(spark, sf).drop("label"), _ev_dictionary(spark, sf))


def runs_events(spark, sf):
    return _ev_ids(spark, sf).select(*SEG, "label", "action_text_id")


def runs_lineitem(spark, sf):
    return rn.runs(ad.li_frames(spark, sf)).select(*SEG, "label")


def runs_orders(spark, sf):
    """Order status runs of a customer over time."""
    from seqseg.operators.ordered import rank_rows

    orders = ad.table(spark, sf, "orders").select(
        F.col("o_custkey").alias(E), "o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("label")
    )
    frames = rank_rows(orders, [E], ["o_orderdate", "o_orderkey"], [F.col("o_orderdate")])
    return rn.runs(frames, keys=[E]).select(*SEG, "label")


def action_config_events(spark, sf):
    nested = rn.nested_segments(_ev_config(spark, sf))
    return nested.select(E, F.inline("action_config"))


def runs_no_background(spark, sf):
    frames = ad.ev_frames(spark, sf)
    return rn.runs_without(frames, ["view"]).select(E, "start_frame", "end_frame", "label")


def _given(spark, sf):
    """Segments that come with the input: one per hundred of value, for users whose
    largest value is at least 250; other users have none."""
    top = ad.table(spark, sf, "events").groupBy(F.col("user_id").alias(E)).agg(F.max("value").alias("top"))
    spans = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / 100).cast("long") - 1))
    return (
        top.where("top >= 250")
        .select(F.lit("events").alias("dataset"), E, spans.alias("segment_index"))
        .select(
            *KEYS,
            "segment_index",
            (F.col("segment_index") * 12).alias("start_frame"),
            (F.col("segment_index") * 12 + 12).alias("end_frame"),
            F.lit("given").alias("english_action_text"),
            F.lit(-1).cast("long").alias("action_text_id"),
        )
    )


def segment_source_fallback(spark, sf):
    chosen = rn.preferred_segments(_given(spark, sf), _ev_config(spark, sf))
    return chosen.select(*SEG, "english_action_text", "action_text_id")


def _kept_segments(spark, sf):
    return _ev_ids(spark, sf).where(F.col("label") != "view")


def expand_segments(spark, sf):
    """Frames from segments; the dropped 'view' segments leave gaps, and every segment
    is drawn one frame longer so that neighbours overlap."""
    segments = _kept_segments(spark, sf).withColumn("end_frame", F.col("end_frame") + 1)
    frames = rn.expand_segments(segments, ad.ev_lengths(spark, sf))
    return frames.select(E, FRAME, "action_text_id")


def _texts(spark, sf):
    """Generated texts: one per segment position a user has order lines for."""
    orders = ad.table(spark, sf, "orders").select(
        F.lit("events").alias("dataset"),
        F.col("o_custkey").alias(E),
        "o_orderkey",
        "o_orderdate",
        F.concat(F.lit(" Assistant: "), F.lower("o_orderpriority"), F.lit("<|im_end|> ")).alias("raw"),
    )
    from seqseg.operators.ordered import rank_rows

    ranked = rank_rows(
        orders, KEYS, ["o_orderdate", "o_orderkey"], [F.col("o_orderdate")], out="segment_index"
    )
    return ranked.select(*KEYS, "segment_index", tx.clean_label(F.col("raw")).alias("text"))


def aligned_segment_texts(spark, sf):
    aligned = rn.align_texts(_ev_runs(spark, sf), _texts(spark, sf))
    return aligned.select(E, "segment_index", "text")


def episode_metadata(spark, sf):
    """Predicted frames back to segments: equal neighbours fuse."""
    segments = _kept_segments(spark, sf).withColumn(
        "action_text_id", F.when(F.col("action_text_id") > 2, 3).otherwise(1).cast("long")
    )
    frames = rn.expand_segments(segments, ad.ev_lengths(spark, sf))
    vocab = vc.union_vocab(ad.table(spark, sf, "events"), "event_type")
    fused = rn.segment_texts(rn.runs(frames, "action_text_id"), vocab)
    return fused.select(*SEG, "action_text_id", "english_action_text", "length")


def episode_summary(spark, sf):
    from seqseg.plans.labelling import episode_summary as summarise

    aligned = rn.align_texts(_ev_runs(spark, sf), _texts(spark, sf))
    summary = summarise(aligned, _task_text(spark, sf))
    joined = F.array_join("subtask_texts", "|")
    return summary.select(E, "n_segments", "n_frames", "task_text", joined.alias("subtask_texts"))


def _task_text(spark, sf):
    customers = ad.table(spark, sf, "customer")
    return customers.select(
        F.lit("events").alias("dataset"),
        F.col("c_custkey").alias(E),
        F.col("c_mktsegment").alias("task_text"),
    )


def dataset_info(spark, sf):
    from seqseg.sinks.metadata import dataset_totals

    return dataset_totals(ad.ev_lengths(spark, sf))


def cap_segments(spark, sf):
    capped = rn.cap_segments(_ev_runs(spark, sf), 5)
    return capped.select(*SEG, "label")


def segment_corpus(spark, sf):
    from seqseg.plans.corpus import segment_corpus as build

    corpus = build(
        given=_given(spark, sf),
        derived=rn.segment_texts(rn.runs(_long_frames(spark, sf), "action_text_id"), _ev_vocab(spark, sf)),
        task_text=_task_text(spark, sf),
        camera="front",
        cap=8,
        min_frames=2,
    )
    return corpus.select(
        E, "segment_id", "start_frame", "end_frame", "subtask_text", "task_text", "action_text_id"
    )


def _long_frames(spark, sf):
    """Labels with longer runs: signup and view share the background id."""
    frames = ad.ev_frames(spark, sf)
    code = (
        F.when(F.col("label").isin("signup", "view"), 0)
        .when(F.col("label") == "click", 1)
        .otherwise(2)
        .cast("long")
    )
    return frames.select(*KEYS, FRAME, code.alias("action_text_id"))


QUERIES = {
    "runs_events": runs_events,
    "runs_lineitem": runs_lineitem,
    "runs_orders": runs_orders,
    "action_config_events": action_config_events,
    "runs_no_background": runs_no_background,
    "segment_source_fallback": segment_source_fallback,
    "expand_segments": expand_segments,
    "aligned_segment_texts": aligned_segment_texts,
    "episode_metadata": episode_metadata,
    "episode_summary": episode_summary,
    "dataset_info": dataset_info,
    "cap_segments": cap_segments,
    "segment_corpus": segment_corpus,
}

_IDS = """ids AS (SELECT r.*, v.id AS action_text_id FROM runs r JOIN vocab v ON v.name = r.label)"""
_DICT = """dict AS (SELECT v.id, v.name FROM vocab v WHERE EXISTS (
  SELECT 1 FROM events e WHERE e.event_type = v.name AND e.event_type <> 'signup'))"""
_CONFIG = """config AS (
  SELECT i.episode_index, i.segment_index, i.start_frame, i.end_frame, i.action_text_id,
         coalesce(d.name, 'class_' || i.action_text_id) AS english_action_text
  FROM ids i LEFT JOIN dict d ON d.id = i.action_text_id)"""
_GIVEN = """given AS (
  SELECT episode_index, segment_index, segment_index * 12 AS start_frame,
         segment_index * 12 + 12 AS end_frame, 'given' AS english_action_text, -1::BIGINT AS action_text_id
  FROM (SELECT user_id AS episode_index,
               unnest(range(0, floor(max(value) / 100)::BIGINT)) AS segment_index
        FROM events GROUP BY user_id HAVING max(value) >= 250))"""
_LEN = "len AS (SELECT episode_index, count(*)::BIGINT AS length FROM ev GROUP BY 1)"
_BASE = (EV, runs_cte("ev"), VOCAB, _IDS)
_TEXTS = """texts AS (
  SELECT o_custkey AS episode_index,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS segment_index,
         lower(o_orderpriority) AS text
  FROM orders)"""
_ALIGNED = """aligned AS (
  SELECT r.episode_index, r.segment_index, r.end_frame, coalesce(t.text, '') AS text
  FROM runs r LEFT JOIN texts t USING (episode_index, segment_index))"""


def _expanded(segments: str) -> str:
    """Frames from overlapping segments by a range join (later segment wins)."""
    return f"""frames AS (
  SELECT e.episode_index, e.frame_index,
         coalesce(arg_max(s.action_text_id, s.segment_index), 0)::BIGINT AS action_text_id
  FROM ev e LEFT JOIN ({segments}) s
    ON s.episode_index = e.episode_index
   AND e.frame_index >= s.start_frame AND e.frame_index < s.end_frame
  GROUP BY 1, 2)"""


ORACLES = {
    "runs_events": with_(*_BASE)
    + "SELECT episode_index, segment_index, start_frame, end_frame, label, action_text_id FROM ids",
    "runs_lineitem": with_(LI, runs_cte("li"))
    + "SELECT episode_index, segment_index, start_frame, end_frame, label FROM runs",
    "runs_orders": with_(
        """o AS (SELECT o_custkey AS episode_index,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame_index,
          o_orderstatus AS label FROM orders)""",
        runs_cte("o"),
    )
    + "SELECT episode_index, segment_index, start_frame, end_frame, label FROM runs",
    "action_config_events": with_(*_BASE, _DICT, _CONFIG)
    + """SELECT episode_index, start_frame, end_frame, english_action_text, action_text_id
FROM config""",
    "runs_no_background": with_(EV, runs_cte("ev"))
    + "SELECT episode_index, start_frame, end_frame, label FROM runs WHERE label <> 'view'",
    "segment_source_fallback": with_(*_BASE, _DICT, _CONFIG, _GIVEN)
    + """SELECT episode_index, segment_index, start_frame, end_frame, english_action_text, action_text_id FROM given
UNION ALL
SELECT episode_index, segment_index, start_frame, end_frame, english_action_text, action_text_id FROM config
WHERE episode_index NOT IN (SELECT episode_index FROM given)""",
    "expand_segments": with_(
        *_BASE,
        _expanded(
            "SELECT episode_index, segment_index, start_frame, end_frame + 1 AS end_frame, action_text_id"
            " FROM ids WHERE label <> 'view'"
        ),
    )
    + "SELECT episode_index, frame_index, action_text_id FROM frames",
    "aligned_segment_texts": with_(EV, runs_cte("ev"), _TEXTS, _ALIGNED)
    + "SELECT episode_index, segment_index, text FROM aligned",
    "episode_metadata": with_(
        *_BASE,
        _LEN,
        _expanded(
            "SELECT episode_index, segment_index, start_frame, end_frame,"
            " CASE WHEN action_text_id > 2 THEN 3 ELSE 1 END AS action_text_id"
            " FROM ids WHERE label <> 'view'"
        ),
        runs_cte("frames", "action_text_id", "fused"),
    )
    + """SELECT f.episode_index, f.segment_index, f.start_frame, f.end_frame, f.label AS action_text_id,
       v.name AS english_action_text, l.length
FROM fused f JOIN vocab v ON v.id = f.label JOIN len l USING (episode_index)""",
    "episode_summary": with_(EV, runs_cte("ev"), _TEXTS, _ALIGNED)
    + """SELECT a.episode_index, count(*)::BIGINT AS n_segments,
       max(a.end_frame)::BIGINT AS n_frames, coalesce(any_value(c.c_mktsegment), '') AS task_text,
       string_agg(a.text, '|' ORDER BY a.segment_index) AS subtask_texts
FROM aligned a LEFT JOIN customer c ON c.c_custkey = a.episode_index GROUP BY 1""",
    "dataset_info": with_(EV, _LEN)
    + """SELECT count(*)::BIGINT AS total_episodes, sum(length)::BIGINT AS total_frames,
       '0:' || count(*) AS train FROM len""",
    "cap_segments": with_(EV, runs_cte("ev"))
    + """SELECT episode_index, segment_index, start_frame, end_frame, label FROM runs
QUALIFY row_number() OVER (PARTITION BY episode_index ORDER BY segment_index) <= 5""",
    "segment_corpus": with_(
        EV,
        VOCAB,
        """coded AS (SELECT episode_index, frame_index,
          CASE WHEN label IN ('signup', 'view') THEN 0 WHEN label = 'click' THEN 1 ELSE 2 END AS code FROM ev)""",
        runs_cte("coded", "code"),
        _GIVEN,
        """pool AS (
          SELECT episode_index, segment_index, start_frame, end_frame, english_action_text, action_text_id FROM given
          UNION ALL
          SELECT r.episode_index, r.segment_index, r.start_frame, r.end_frame, v.name, r.label
          FROM runs r JOIN vocab v ON v.id = r.label
          WHERE r.episode_index NOT IN (SELECT episode_index FROM given))""",
    )
    + """SELECT p.episode_index,
       printf('events__ep%06d__front__%06d_%06d', p.episode_index, p.start_frame, p.end_frame) AS segment_id,
       p.start_frame, p.end_frame, p.english_action_text AS subtask_text, c.c_mktsegment AS task_text,
       p.action_text_id
FROM pool p JOIN customer c ON c.c_custkey = p.episode_index
WHERE p.end_frame - p.start_frame >= 2 AND p.english_action_text <> 'background'
QUALIFY row_number() OVER (PARTITION BY p.episode_index ORDER BY p.segment_index) <= 8""",
}
