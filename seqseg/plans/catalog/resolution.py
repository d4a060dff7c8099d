"""Time-resolution changes and sliding windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqseg.functions import vectors as vx
from seqseg.operators import resample as rs
from seqseg.operators.ordered import FRAME, KEYS
from seqseg.plans import adapters as ad
from seqseg.plans.catalog._sql import EM, EV, r6, with_

E = "episode_index"


def _steps(divisor: int):
    return F.greatest(F.floor(F.col("length") / divisor).cast("long"), F.lit(1).cast("long"))


def labels_down_round(spark, sf):
    return rs.resample(ad.ev_frames(spark, sf), ["label"], _steps(7)).select(E, FRAME, "label")


def labels_down_floor(spark, sf):
    return rs.resample(ad.ev_frames(spark, sf), ["label"], _steps(7), "floor").select(E, FRAME, "label")


def predicted(spark, sf):
    """Labels sampled down eight times and stretched back: a stand-in prediction."""
    down = rs.resample(ad.ev_frames(spark, sf), ["label"], _steps(8), keep=["length"])
    return rs.resample(down, ["label"], F.col("length"), source=_steps(8), keep=["length"])


def labels_up(spark, sf):
    return predicted(spark, sf).select(E, FRAME, "label")


def probs_up(spark, sf):
    up = rs.resample(ad.ev_probs(spark, sf), ["p"], F.col("length") * 5 + 3, "centre")
    return up.select(E, FRAME, r6(F.col("p")).alias("p"))


def stride_sample(spark, sf):
    return rs.stride_sample(ad.ev_frames(spark, sf), 3).select(E, FRAME, "label", "value")


def window_mean(spark, sf):
    found = rs.sliding_windows(
        ad.ev_frames(spark, sf),
        {
            "mean_value": lambda inside: F.avg(F.when(inside, F.col("value"))),
            "min_value": lambda inside: F.min(F.when(inside, F.col("value"))),
            "max_value": lambda inside: F.max(F.when(inside, F.col("value"))),
            "last_label": lambda inside: F.max_by("label", F.when(inside, F.col(FRAME))),
        },
        both_streams=True,
    )
    return found.select(
        E, "window_index", r6(F.col("mean_value")).alias("mean_value"), "min_value", "max_value", "last_label"
    )


def window_mean_padded(spark, sf):
    found = rs.padded_windows(
        ad.ev_frames(spark, sf),
        {
            "total": lambda w: F.sum(F.col("value") * w),
            "n_rows": lambda w: F.sum(w),
            "max_value": lambda w: F.max("value"),
        },
    )
    return found.select(
        E, "window_index", r6(F.col("total") / F.col("n_rows")).alias("mean_value"), "n_rows", "max_value"
    )


def subvector_mean(spark, sf):
    features = ad.em_features(spark, sf).withColumn(
        "window_index", F.floor(F.col(FRAME) / F.lit(8)).cast("long")
    )
    found = rs.mean_vectors(features, "embedding", [E, "window_index"])
    return found.select(E, "window_index", F.posexplode("values").alias("dim", "x")).select(
        E, "window_index", F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("x")
    )


def normalised(spark, sf):
    rgb, flow = F.col("rgb"), F.col("flow")
    table = ad.em_features(spark, sf).select(
        E,
        FRAME,
        F.posexplode(
            F.arrays_zip(
                vx.standardise(rgb, 0.45, 0.225).alias("standardised"),
                vx.to_unit_range(rgb).alias("unit"),
                vx.clip_scale(flow, 0.2).alias("clipped"),
            )
        ).alias("dim", "v"),
    )
    return table.select(
        E,
        FRAME,
        F.col("dim").cast("long").alias("dim"),
        *[r6(F.col("v")[c]).alias(c) for c in ("standardised", "unit", "clipped")],
    )


def frame_delta(spark, sf):
    moved = rs.frame_delta(ad.em_features(spark, sf).select(*KEYS, FRAME, "embedding"), "embedding", 0.25)
    return moved.select(E, FRAME, F.posexplode("delta").alias("dim", "x")).select(
        E, FRAME, F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("x")
    )


QUERIES = {
    "labels_down_round": labels_down_round,
    "labels_down_floor": labels_down_floor,
    "labels_up": labels_up,
    "probs_up": probs_up,
    "stride_sample": stride_sample,
    "window_mean": window_mean,
    "window_mean_padded": window_mean_padded,
    "subvector_mean": subvector_mean,
    "normalised": normalised,
    "frame_delta": frame_delta,
}


def _len(k: str) -> str:
    return f"""len AS (SELECT episode_index, count(*)::BIGINT AS n, ({k})::BIGINT AS k FROM ev GROUP BY 1)"""


def grid_cte(rule: str, source: str = "len", out: str = "grid") -> str:
    """Output positions with their source index."""
    spaced = "CASE WHEN k = 1 THEN 0.0 WHEN j = k - 1 THEN (n - 1)::DOUBLE ELSE j * ((n - 1)::DOUBLE / (k - 1)::DOUBLE) END"
    index = {
        "nearest": f"round_even({spaced}, 0)",
        "floor": f"floor({spaced})",
        "centre": "floor((j + 0.5::DOUBLE) * (n::DOUBLE / k::DOUBLE))",
    }[rule]
    return f"""{out} AS (
  SELECT episode_index, n, k, j, least(greatest(({index})::BIGINT, 0), n - 1) AS src
  FROM (SELECT episode_index, n, k, unnest(range(k)) AS j FROM {source}))"""


def _pick(column: str) -> str:
    return f"""SELECT g.episode_index, g.j::BIGINT AS frame_index, e.{column}
FROM grid g JOIN ev e ON e.episode_index = g.episode_index AND e.frame_index = g.src"""


PRED = (
    EV,
    _len("greatest(count(*) // 8, 1)"),
    grid_cte("nearest", out="down"),
    """low AS (SELECT d.episode_index, d.j AS frame_index, e.label FROM down d
  JOIN ev e ON e.episode_index = d.episode_index AND e.frame_index = d.src)""",
    "back AS (SELECT episode_index, k AS n, n AS k FROM len)",
    grid_cte("nearest", "back", "up"),
    """pred AS (SELECT u.episode_index, u.j AS frame_index, l.label FROM up u
  JOIN low l ON l.episode_index = u.episode_index AND l.frame_index = u.src)""",
)

_WIN = "win AS (SELECT episode_index, length, unnest(range({count})) AS window_index FROM len)"
_LENGTH = "len AS (SELECT episode_index, count(*)::BIGINT AS length FROM ev GROUP BY 1)"

ORACLES = {
    "labels_down_round": with_(EV, _len("greatest(count(*) // 7, 1)"), grid_cte("nearest")) + _pick("label"),
    "labels_down_floor": with_(EV, _len("greatest(count(*) // 7, 1)"), grid_cte("floor")) + _pick("label"),
    "labels_up": with_(*PRED) + "SELECT episode_index, frame_index::BIGINT AS frame_index, label FROM pred",
    "probs_up": with_(EV, _len("count(*) * 5 + 3"), grid_cte("centre"))
    + """SELECT g.episode_index, g.j::BIGINT AS frame_index, round(e.value / (e.value + 100.0::DOUBLE), 6) AS p
FROM grid g JOIN ev e ON e.episode_index = g.episode_index AND e.frame_index = g.src""",
    "stride_sample": with_(EV)
    + """SELECT episode_index, (frame_index // 3)::BIGINT AS frame_index, label, value FROM ev
WHERE frame_index % 3 = 0""",
    "window_mean": with_(
        EV,
        _LENGTH,
        _WIN.format(count="CASE WHEN length - 1 >= 16 THEN (length - 1 - 16) // 8 + 1 ELSE 0 END"),
    )
    + """SELECT w.episode_index, w.window_index::BIGINT AS window_index, round(avg(e.value), 6) AS mean_value,
  min(e.value) AS min_value, max(e.value) AS max_value, arg_max(e.label, e.frame_index) AS last_label
FROM win w JOIN ev e ON e.episode_index = w.episode_index
 AND e.frame_index >= w.window_index * 8 AND e.frame_index < w.window_index * 8 + 16
GROUP BY 1, 2""",
    "window_mean_padded": with_(
        EV,
        _LENGTH,
        _WIN.format(count="(ceil(greatest(length - 16, 0) / 8.0))::BIGINT + 1"),
        """slot AS (SELECT episode_index, window_index,
          unnest([least(window_index * 8 + i, length - 1) for i in range(16)]) AS frame_index FROM win)""",
    )
    + """SELECT s.episode_index, s.window_index::BIGINT AS window_index, round(sum(e.value) / count(*), 6) AS mean_value,
  count(*)::BIGINT AS n_rows, max(e.value) AS max_value
FROM slot s JOIN ev e USING (episode_index, frame_index) GROUP BY 1, 2""",
    "subvector_mean": with_(EM, "parts AS (SELECT episode_index, frame_index // 8 AS window_index, unnest(range(64)) AS dim, embedding FROM em)")
    + """SELECT episode_index, window_index::BIGINT AS window_index, dim::BIGINT AS dim, round(avg(embedding[dim + 1]), 6) + 0.0 AS x
FROM parts GROUP BY 1, 2, 3""",
    "normalised": with_(EM, "parts AS (SELECT episode_index, frame_index, unnest(range(32)) AS dim, rgb, flow FROM em)")
    + """SELECT episode_index, frame_index::BIGINT AS frame_index, dim::BIGINT AS dim,
  round((rgb[dim + 1] - 0.45::DOUBLE) / 0.225::DOUBLE, 6) + 0.0 AS standardised,
  round(rgb[dim + 1] / 255.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE, 6) + 0.0 AS unit,
  round(least(greatest(flow[dim + 1], -0.2::DOUBLE), 0.2::DOUBLE) / 0.2::DOUBLE, 6) + 0.0 AS clipped
FROM parts""",
    "frame_delta": with_(
        EM,
        """pairs AS (SELECT a.episode_index, a.frame_index, a.embedding AS now, b.embedding AS later, unnest(range(64)) AS dim
          FROM em a JOIN em b ON b.episode_index = a.episode_index AND b.frame_index = a.frame_index + 1)""",
    )
    + """SELECT episode_index, frame_index::BIGINT AS frame_index, dim::BIGINT AS dim,
  round(least(greatest(later[dim + 1] - now[dim + 1], -0.25::DOUBLE), 0.25::DOUBLE) / 0.25::DOUBLE, 6) + 0.0 AS x
FROM pairs""",
}
