"""Frame sampling, batches, span masks, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqseg.operators import runs as rn, sampling as sp
from seqseg.operators.ordered import FRAME, KEYS, neighbours
from seqseg.plans import adapters as ad
from seqseg.plans.catalog._sql import EM, EV, r6, runs_cte, with_

E = "episode_index"


def _segments(spark, sf):
    """Purchase against all other events: runs of very different length."""
    frames = ad.ev_frames(spark, sf)
    label = F.when(F.col("label") == "purchase", "buy").otherwise("other")
    return rn.runs(frames.select(*KEYS, FRAME, label.alias("label")))


def centre_frames(spark, sf):
    found = sp.centre_frames(_segments(spark, sf), 4)
    return found.select(E, "segment_index", "slot", "frame")


def binned_frames(spark, sf):
    found = sp.binned_frames(_segments(spark, sf), 4, seed=7)
    inside = (F.col("frame") >= F.col("bin_start")) & (F.col("frame") < F.col("bin_end"))
    return found.select(E, "segment_index", "slot", "bin_start", "bin_end", inside.alias("in_bin"))


def clamped_rows(spark, sf):
    """Sampled positions shifted by five frames, so that some fall past the end."""
    shifted = sp.centre_frames(_segments(spark, sf), 4).withColumn("frame", F.col("frame") + 5)
    rows = ad.ev_frames(spark, sf).select(*KEYS, FRAME, F.col("label").alias("event"), "value")
    return sp.resolve_rows(shifted, rows).select(E, "segment_index", "slot", FRAME, "event", "value")


def _batches(spark, sf, pad):
    frames = ad.ev_frames(spark, sf).select(*KEYS, FRAME, F.length("label").cast("long").alias("label"), "value")
    return sp.padded_batches(
        frames, ad.ev_lengths(spark, sf), 8, {"value": F.lit(0.0), "label": F.lit(pad)}
    ).select("batch_id", "slot", E, FRAME, "label", "value", F.col("mask").cast("long").alias("mask"), "length")


def padded_batches(spark, sf):
    return _batches(spark, sf, -100)


def padded_boundary_batches(spark, sf):
    return _batches(spark, sf, 0)


def masked_rows(spark, sf):
    """Batches with the padding removed again."""
    from seqseg.operators.metrics import drop_padding

    kept = drop_padding(_batches(spark, sf, -100))
    return kept.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("label_sum"))


def span_mask(spark, sf):
    """Assistant turns: the turn before is the prompt, word lengths act as tokens."""
    words = lambda c: F.transform(F.split(c, " "), lambda x: F.length(x).cast("long"))
    turns = neighbours(ad.cv_turns(spark, sf), {"prompt": lambda w: F.lag("text").over(w)}, before=1)
    examples = turns.where((F.col("role") == "assistant") & F.col("prompt").isNotNull()).select(
        E,
        FRAME,
        F.concat(words("prompt"), words("text")).alias("input_ids"),
        F.size(F.split("prompt", " ")).alias("prompt_len"),
    )
    found = sp.supervised_spans(examples, 4, [E, FRAME])
    flat = found.select(
        E, FRAME, "batch_id", F.posexplode(F.arrays_zip("input_ids", "labels", "attention_mask")).alias("pos", "t")
    )
    return flat.select(
        E, FRAME, "batch_id", F.col("pos").cast("long").alias("pos"), F.col("t.input_ids").alias("token"),
        F.col("t.labels").alias("target"), F.col("t.attention_mask").cast("long").alias("attention"),
    )


def _elements(features):
    """Both streams, one row per element."""
    flat = features.select(E, FRAME, F.posexplode(F.arrays_zip("rgb", "flow")).alias("dim", "v"))
    return flat.select(E, FRAME, F.col("dim").cast("long").alias("dim"), r6(F.col("v.rgb")).alias("rgb"), r6(F.col("v.flow")).alias("flow"))


def feature_dropout(spark, sf):
    dropped = sp.feature_dropout(ad.em_features(spark, sf), 0.2, 0.1, seed=3)
    return _elements(dropped)


def feature_noise(spark, sf):
    noisy = sp.gaussian_noise(ad.em_features(spark, sf), 0.05, seed=3)
    return _elements(noisy)


QUERIES = {
    "centre_frames": centre_frames,
    "binned_frames": binned_frames,
    "clamped_rows": clamped_rows,
    "padded_batches": padded_batches,
    "padded_boundary_batches": padded_boundary_batches,
    "masked_rows": masked_rows,
    "span_mask": span_mask,
    "feature_dropout": feature_dropout,
    "feature_noise": feature_noise,
}

_SEG = (
    EV,
    "co AS (SELECT episode_index, frame_index, CASE WHEN label = 'purchase' THEN 'buy' ELSE 'other' END AS label FROM ev)",
    runs_cte("co"),
    "len AS (SELECT episode_index, count(*)::BIGINT AS t FROM ev GROUP BY 1)",
)
_CENTRE = """centre AS (
  SELECT episode_index, segment_index, j::BIGINT AS slot,
    (CASE WHEN n >= 4 THEN floor(start_frame + (j * (n / 4.0::DOUBLE) + (n / 4.0::DOUBLE) / 2.0))
     WHEN j = 3 THEN end_frame - 1
     ELSE round_even(j * ((n - 1) / 3.0::DOUBLE) + start_frame, 0) END)::BIGINT AS frame
  FROM (SELECT *, (end_frame - start_frame)::DOUBLE AS n, unnest(range(4)) AS j FROM runs))"""
_EDGE = "(CASE WHEN {i} = 4 THEN end_frame ELSE trunc({i} * (n / 4.0::DOUBLE) + start_frame) END)::BIGINT"
_LO, _HI = _EDGE.format(i="j"), _EDGE.format(i="(j + 1)")
_EVEN = "(CASE WHEN j = 3 THEN end_frame - 1 ELSE round_even(j * ((n - 1) / 3.0::DOUBLE) + start_frame, 0) END)::BIGINT"


def _batch_sql(pad: int) -> str:
    return with_(
        EV,
        "len AS (SELECT episode_index, count(*)::BIGINT AS t, row_number() OVER (ORDER BY episode_index) - 1 AS r FROM ev GROUP BY 1)",
        "slots AS (SELECT *, r // 8 AS batch_id, r % 8 AS slot, max(t) OVER (PARTITION BY r // 8) AS longest FROM len)",
        "grid AS (SELECT *, unnest(range(longest)) AS frame_index FROM slots)",
        f"""bat AS (SELECT g.batch_id, g.slot, g.episode_index, g.frame_index::BIGINT AS frame_index,
          coalesce(length(e.label), {pad})::BIGINT AS label, coalesce(e.value, 0.0) AS value,
          (e.value IS NOT NULL)::BIGINT AS mask, g.t AS length
          FROM grid g LEFT JOIN ev e USING (episode_index, frame_index))""",
    )


_CELLS = """cells AS (SELECT episode_index, frame_index, d::BIGINT AS dim, rgb[d + 1] AS rgb, flow[d + 1] AS flow
  FROM (SELECT *, unnest(range(32)) AS d FROM em))"""


def _unit(name: str, place: str, before: str = "") -> str:
    """Uniform draw of the operators, seed 3: the first 52 bits of an MD5 digest."""
    text = f"concat_ws('|', '3', {name}, {before}'embeddings', episode_index::VARCHAR, {place}::VARCHAR)"
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def _normal(name: str) -> str:
    place = "frame_index::VARCHAR, dim"
    u, v = (_unit(name, place, f"'{n}', ") for n in "uv")
    return f"sqrt(-2.0::DOUBLE * ln({u})) * cos({6.283185307179586!r}::DOUBLE * {v})"


ORACLES = {
    "centre_frames": with_(*_SEG, _CENTRE) + "SELECT * FROM centre",
    "binned_frames": with_(*_SEG)
    + f"""SELECT episode_index, segment_index, j::BIGINT AS slot,
  CASE WHEN n <= 4 THEN {_EVEN} ELSE {_LO} END AS bin_start,
  CASE WHEN n <= 4 THEN {_EVEN} + 1 ELSE greatest({_HI}, {_LO} + 1) END AS bin_end, TRUE AS in_bin
FROM (SELECT *, (end_frame - start_frame)::DOUBLE AS n, unnest(range(4)) AS j FROM runs)""",
    "clamped_rows": with_(*_SEG, _CENTRE)
    + """SELECT c.episode_index, c.segment_index, c.slot, e.frame_index::BIGINT AS frame_index, e.label AS event, e.value
FROM centre c JOIN len l USING (episode_index)
JOIN ev e ON e.episode_index = c.episode_index AND e.frame_index = least(c.frame + 5, l.t - 1)""",
    "padded_batches": _batch_sql(-100) + "SELECT * FROM bat",
    "padded_boundary_batches": _batch_sql(0) + "SELECT * FROM bat",
    "masked_rows": _batch_sql(-100)
    + "SELECT batch_id, count(*)::BIGINT AS n, sum(label)::BIGINT AS label_sum FROM bat WHERE mask = 1 GROUP BY 1",
    "span_mask": """WITH t AS (
  SELECT conv_id AS e, turn AS f, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations),
x AS (
  SELECT e, f, [length(w)::BIGINT for w in string_split(prompt, ' ')] || [length(w)::BIGINT for w in string_split(text, ' ')] AS ids,
    len(string_split(prompt, ' ')) AS p, (row_number() OVER (ORDER BY e, f) - 1) // 4 AS batch_id
  FROM t WHERE role = 'assistant' AND prompt IS NOT NULL),
y AS (SELECT *, len(ids) AS n, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM x),
z AS (SELECT *, unnest(range(longest)) AS pos FROM y)
SELECT e AS episode_index, f::BIGINT AS frame_index, batch_id, pos::BIGINT AS pos,
  CASE WHEN pos < n THEN ids[pos + 1] ELSE 0 END AS token,
  CASE WHEN pos >= p AND pos < n THEN ids[pos + 1] ELSE -100 END AS target, (pos < n)::BIGINT AS attention FROM z""",
    "feature_dropout": with_(EM, _CELLS)
    + f"""SELECT episode_index, frame_index::BIGINT AS frame_index, dim,
  round(CASE WHEN {_unit("'time'", "frame_index")} < 0.1 OR {_unit("'rgb'", "dim")} < 0.2 THEN 0.0::DOUBLE ELSE rgb END, 6) + 0.0 AS rgb,
  round(CASE WHEN {_unit("'time'", "frame_index")} < 0.1 OR {_unit("'flow'", "dim")} < 0.2 THEN 0.0::DOUBLE ELSE flow END, 6) + 0.0 AS flow
FROM cells""",
    "feature_noise": with_(EM, _CELLS)
    + f"""SELECT episode_index, frame_index::BIGINT AS frame_index, dim,
  round(rgb + 0.05::DOUBLE * {_normal("'rgb'")}, 6) + 0.0 AS rgb, round(flow + 0.05::DOUBLE * {_normal("'flow'")}, 6) + 0.0 AS flow
FROM cells""",
}
