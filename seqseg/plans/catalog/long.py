"""All events as one episode, with small buckets: results must not depend on where an episode is cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqseg.operators import metrics as mt, peaks as pk, resample as rs, runs as rn, transitions as tr, vocab as vc
from seqseg.operators.ordered import FRAME, KEYS, rank_rows, time_hours
from seqseg.plans import adapters as ad
from seqseg.plans.catalog._sql import EV, VOCAB, r6, runs_cte, with_
from seqseg.plans.catalog.boundaries import _CODE, _COARSE, _STEPS
from seqseg.plans.catalog.scoring import _segmentation
from seqseg.plans.catalog.segments import _IDS, _expanded

#: Positions of a bucket: even the smallest tables fill more than ten.
ROWS = 64
E = "episode_index"
SEG = (E, "segment_index", "start_frame", "end_frame", "label")


def one_episode(spark, sf):
    """Events in time order under one key."""
    events = ad.table(spark, sf, "events").select(
        F.lit("all").alias("dataset"),
        F.lit(0).cast("long").alias(E),
        "event_id",
        "ts",
        F.col("event_type").alias("label"),
        "value",
    )
    ranked = rank_rows(events, KEYS, ["ts", "event_id"], [time_hours(events, "ts")], total="length")
    return ranked.drop("event_id", "ts")


def _sizes(frames):
    return frames.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("length"))


def long_runs(spark, sf):
    return rn.runs(one_episode(spark, sf), rows=ROWS).select(*SEG)


def long_boundary_steps(spark, sf):
    frames = one_episode(spark, sf)
    steps = _sizes(frames).select(*KEYS, rs.window_count(F.col("length"), 16, 8, True).alias("t_feat"))
    coarse = frames.select(*KEYS, FRAME, F.when(F.col("label") == "purchase", 1).otherwise(0).alias("label"))
    return tr.step_boundaries(coarse, steps, 8, "code", rows=ROWS).select(E, "step", "boundary")


def long_expand_segments(spark, sf):
    """The dropped 'view' segments leave gaps; neighbours overlap by one frame."""
    frames = one_episode(spark, sf)
    vocab = vc.union_vocab(ad.table(spark, sf, "events"), "event_type").withColumnRenamed("name", "label")
    segments = rn.runs(frames, rows=ROWS).join(vocab, "label").where(F.col("label") != "view")
    wider = segments.withColumn("end_frame", F.col("end_frame") + 1)
    return rn.expand_segments(wider, _sizes(frames), rows=ROWS).select(E, FRAME, "action_text_id")


def _paired(spark, sf):
    frames = one_episode(spark, sf)
    shorter = F.greatest(F.floor(F.col("length") / 8), F.lit(1)).cast("long")
    down = rs.resample(frames, ["label"], shorter, keep=["length"], rows=ROWS)
    back = rs.resample(down, ["label"], F.col("length"), source=shorter, keep=["length"], rows=ROWS)
    return mt.paired_frames(
        back.select(*KEYS, FRAME, F.col("label").alias("pred")), frames.select(*KEYS, FRAME, F.col("label").alias("gt"))
    )


def long_f1_counts(spark, sf):
    segments = mt.paired_runs(_paired(spark, sf), rows=ROWS)
    found = mt.f1_counts(segments, (10, 25, 50), ["view"])
    return found.select(E, F.col("overlap").cast("long").alias("overlap"), "tp", "fp", "fn")


def long_peak_prominence(spark, sf):
    frames = one_episode(spark, sf)
    probs = frames.select(*KEYS, FRAME, F.round(F.col("value") / (F.col("value") + F.lit(100.0)), 1).alias("p"), "length")
    curve = pk.value_runs(probs, "p", rows=ROWS)
    found = pk.prominences(curve, "p", rows=ROWS, fan_in=4)
    return found.select(E, "peak", r6(F.col("height")).alias("height"), r6(F.col("prominence")).alias("prominence"))


QUERIES = {
    "long_runs": long_runs,
    "long_boundary_steps": long_boundary_steps,
    "long_expand_segments": long_expand_segments,
    "long_f1_counts": long_f1_counts,
    "long_peak_prominence": long_peak_prominence,
}

_ONE = """ev AS (
  SELECT 0::BIGINT AS episode_index, row_number() OVER (ORDER BY ts, event_id) - 1 AS frame_index,
         event_id, ts, event_type AS label, value
  FROM events)"""

ORACLES = {
    "long_runs": with_(_ONE, runs_cte("ev")) + "SELECT episode_index, segment_index, start_frame, end_frame, label FROM runs",
    "long_boundary_steps": with_(_ONE, _COARSE, _STEPS, _CODE) + "SELECT * FROM bound",
    "long_expand_segments": with_(
        _ONE,
        runs_cte("ev"),
        VOCAB,
        _IDS,
        _expanded(
            "SELECT episode_index, segment_index, start_frame, end_frame + 1 AS end_frame, action_text_id"
            " FROM ids WHERE label <> 'view'"
        ),
    )
    + "SELECT episode_index, frame_index, action_text_id FROM frames",
    "long_f1_counts": with_(*[_ONE if p == EV else p for p in _segmentation("label <> 'view'")])
    + "SELECT episode_index, overlap, tp, fp, fn FROM counts",
    # Sides reach to the next higher value; the lowest values in between, per peak.
    "long_peak_prominence": with_(
        _ONE,
        "curve AS (SELECT frame_index AS i, round(value / (value + 100.0::DOUBLE), 1) AS p FROM ev)",
        "marked AS (SELECT *, CASE WHEN p IS DISTINCT FROM lag(p) OVER (ORDER BY i) THEN 1 ELSE 0 END AS new FROM curve)",
        "grouped AS (SELECT *, sum(new) OVER (ORDER BY i) AS run FROM marked)",
        "flat AS (SELECT run, any_value(p) AS p, min(i) AS s, max(i) AS e FROM grouped GROUP BY run)",
        "around AS (SELECT *, lag(p) OVER (ORDER BY run) AS l, lead(p) OVER (ORDER BY run) AS r FROM flat)",
        "tops AS (SELECT * FROM around WHERE p > l AND p > r)",
        """higher AS (
          SELECT t.run, t.p, t.s, t.e,
            (SELECT max(f.run) FROM flat f WHERE f.p > t.p AND f.run < t.run) AS a,
            (SELECT min(f.run) FROM flat f WHERE f.p > t.p AND f.run > t.run) AS b FROM tops t)""",
        """lows AS (
          SELECT h.*, (SELECT min(f.p) FROM flat f WHERE f.run < h.run AND f.run > coalesce(h.a, -1)) AS low_left,
            (SELECT min(f.p) FROM flat f WHERE f.run > h.run AND f.run < coalesce(h.b, 9000000000)) AS low_right FROM higher h)""",
    )
    + """SELECT 0::BIGINT AS episode_index, ((s + e) // 2)::BIGINT AS peak, round(p, 6) + 0.0 AS height,
  round(p - greatest(low_left, low_right), 6) + 0.0 AS prominence FROM lows""",
}
