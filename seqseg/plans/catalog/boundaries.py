"""Transition labels, soft labels, peaks and segments from probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqseg.operators import peaks as pk, resample as rs, transitions as tr
from seqseg.operators.ordered import FRAME, KEYS
from seqseg.plans import adapters as ad
from seqseg.plans.catalog._sql import EV, r6, with_

E = "episode_index"


def _steps(spark, sf):
    """Complete windows of 16 frames every 8, both streams."""
    return ad.ev_lengths(spark, sf).select(*KEYS, rs.window_count(F.col("length"), 16, 8, True).alias("t_feat"))


def coarse_frames(spark, sf):
    """Two labels only, so that some steps stay without a change."""
    label = F.when(F.col("label") == "purchase", 1).otherwise(0)
    return ad.ev_frames(spark, sf).select(*KEYS, FRAME, label.alias("label"))


def _boundaries(spark, sf, mode):
    frames = coarse_frames(spark, sf)
    return tr.step_boundaries(frames, _steps(spark, sf), 8, mode)


def frame_transitions(spark, sf):
    return tr.frame_transitions(ad.ev_frames(spark, sf)).select(E, FRAME, "changed")


def boundary_steps(spark, sf):
    return _boundaries(spark, sf, "code").select(E, "step", "boundary")


def boundary_steps_spec(spark, sf):
    return _boundaries(spark, sf, "spec").select(E, "step", "boundary")


def boundary_density(spark, sf):
    dense = tr.boundary_density(_boundaries(spark, sf, "code"))
    return dense.select(E, "n_pos", r6(F.col("share")).alias("share"))


def soft_boundaries(spark, sf):
    frames = ad.ev_frames(spark, sf)
    spikes = frames.select(*KEYS, F.col(FRAME).alias("step"), (F.col("value") > 120).cast("int").alias("boundary"))
    return tr.soft_boundaries(spikes).select(E, "step", r6(F.col("soft")).alias("soft"))


def step_probs(spark, sf):
    """Probabilities rounded to one digit, which makes plateaus."""
    probs = ad.ev_probs(spark, sf)
    return probs.select(*KEYS, FRAME, F.round("p", 1).alias("p"))


def plateau_peaks(spark, sf):
    return pk.plateau_peaks(step_probs(spark, sf)).select(E, "peak", "height")


def peaks_threshold(spark, sf):
    return pk.plateau_peaks(step_probs(spark, sf)).where("height >= 0.5").select(E, "peak", "height")


def local_peaks(spark, sf):
    found = pk.local_peaks(step_probs(spark, sf), 3, 0.15, suppress=False)
    return found.select(E, "peak", "height")


def local_peaks_kept(spark, sf):
    return pk.local_peaks(step_probs(spark, sf), 3, 0.15).select(E, "peak", "height")


def peaks_full(spark, sf):
    found = pk.detect_peaks(ad.ev_probs(spark, sf), 0.3, 4, 0.1)
    return found.select(E, "peak", r6(F.col("height")).alias("height"))


def peak_prominence(spark, sf):
    found = pk.prominences(pk.value_runs(step_probs(spark, sf)), "p")
    return found.select(E, "peak", r6(F.col("prominence")).alias("prominence"))


def boundary_segments(spark, sf):
    peaks = pk.plateau_peaks(step_probs(spark, sf)).where("height >= 0.5")
    found = pk.segments_from_boundaries(peaks, ad.ev_lengths(spark, sf), 1)
    return found.select(E, "segment_index", "start_frame", "end_frame")


def segments_min_length(spark, sf):
    peaks = pk.plateau_peaks(step_probs(spark, sf)).where("height >= 0.5")
    found = pk.segments_from_boundaries(peaks, ad.ev_lengths(spark, sf), 5)
    return found.select(E, "segment_index", "start_frame", "end_frame")


def segments_from_probs(spark, sf):
    found = pk.segments_from_probs(ad.ev_probs(spark, sf), F.col("length") * 8 + 5)
    return found.select(E, "segment_index", "start_frame", "end_frame")


QUERIES = {
    "frame_transitions": frame_transitions,
    "boundary_steps": boundary_steps,
    "boundary_steps_spec": boundary_steps_spec,
    "boundary_density": boundary_density,
    "soft_boundaries": soft_boundaries,
    "plateau_peaks": plateau_peaks,
    "peaks_threshold": peaks_threshold,
    "local_peaks": local_peaks,
    "local_peaks_kept": local_peaks_kept,
    "peaks_full": peaks_full,
    "peak_prominence": peak_prominence,
    "boundary_segments": boundary_segments,
    "segments_min_length": segments_min_length,
    "segments_from_probs": segments_from_probs,
}

_COARSE = "co AS (SELECT episode_index, frame_index, CASE WHEN label = 'purchase' THEN 1 ELSE 0 END AS label FROM ev)"
_STEPS = """steps AS (
  SELECT episode_index, unnest(range(CASE WHEN t - 1 >= 16 THEN (t - 17) // 8 + 1 ELSE 0 END)) AS step
  FROM (SELECT episode_index, count(*)::BIGINT AS t FROM ev GROUP BY 1))"""


def _bound(inside: str) -> str:
    return f"""bound AS (
  SELECT s.episode_index, s.step::BIGINT AS step,
    max(CASE WHEN c.moved AND {inside} THEN 1 ELSE 0 END) AS boundary
  FROM steps s JOIN (SELECT *, label <> lag(label) OVER (PARTITION BY episode_index ORDER BY frame_index) AS moved FROM co) c
    ON c.episode_index = s.episode_index AND c.frame_index >= s.step * 8 AND c.frame_index < s.step * 8 + 8
  GROUP BY 1, 2)"""


_CODE = _bound("c.frame_index > s.step * 8")
_CURVE = """curve AS (SELECT episode_index, frame_index, round(value / (value + 100.0::DOUBLE), 1) AS p FROM ev)"""
_TOPS = """seg AS (
  SELECT *, sum(CASE WHEN p IS DISTINCT FROM before THEN 1 ELSE 0 END)
       OVER (PARTITION BY episode_index ORDER BY frame_index) AS run
  FROM (SELECT *, lag(p) OVER (PARTITION BY episode_index ORDER BY frame_index) AS before FROM curve)),
flat AS (SELECT episode_index, run, any_value(p) AS p, min(frame_index) AS s, max(frame_index) AS e FROM seg GROUP BY 1, 2),
tops AS (
  SELECT episode_index, ((s + e) // 2)::BIGINT AS peak, p AS height, s, e FROM flat
  QUALIFY p > lag(p) OVER (PARTITION BY episode_index ORDER BY run) AND p > lead(p) OVER (PARTITION BY episode_index ORDER BY run))"""
_SEGMENTS = """len AS (SELECT episode_index, count(*)::BIGINT AS t FROM ev GROUP BY 1),
edge AS (
  SELECT episode_index, 0::BIGINT AS b FROM len
  UNION SELECT episode_index, peak FROM tops WHERE height >= 0.5 AND peak > 0)"""
_PROMINENCE = """sides AS (
  SELECT t.episode_index, t.peak, t.height,
    coalesce((SELECT max(c.frame_index) FROM curve c WHERE c.episode_index = t.episode_index
       AND c.frame_index < t.s AND c.p > t.height), -1) AS l,
    coalesce((SELECT min(c.frame_index) FROM curve c WHERE c.episode_index = t.episode_index
       AND c.frame_index > t.e AND c.p > t.height), 9223372036854775807) AS r
  FROM tops t),
prom AS (
  SELECT s.episode_index, s.peak, s.height,
    s.height - greatest(min(c.p) FILTER (c.frame_index <= s.peak), min(c.p) FILTER (c.frame_index >= s.peak)) AS prominence
  FROM sides s JOIN curve c ON c.episode_index = s.episode_index AND c.frame_index > s.l AND c.frame_index < s.r
  GROUP BY 1, 2, 3)"""



def _greedy(source: str, distance: int, tie: str) -> str:
    """Visit peaks from the highest down, one recursion step per kept peak."""
    return f"""queue AS (
  SELECT episode_index, list({{'k': peak, 'h': height}} ORDER BY height DESC, peak {tie}) AS rest FROM {source} GROUP BY 1),
visit AS (
  SELECT episode_index, rest, []::STRUCT(k BIGINT, h DOUBLE)[] AS kept FROM queue
  UNION ALL
  SELECT episode_index, [x for x in rest[2:] if abs(x.k - rest[1].k) >= {distance}], list_append(kept, rest[1])
  FROM visit WHERE len(rest) > 0),
kept AS (SELECT episode_index, x.k AS peak, x.h AS height
  FROM (SELECT episode_index, unnest(kept) AS x FROM visit WHERE len(rest) = 0))"""


def _merged(min_length: int) -> str:
    """Merge the shortest segment into its shorter neighbour, one recursion step each."""
    return f"""tiles AS (
  SELECT e.episode_index, e.b AS s, coalesce(lead(e.b) OVER (PARTITION BY e.episode_index ORDER BY e.b), l.t)::BIGINT AS e
  FROM edge e JOIN len l USING (episode_index)),
st AS (
  SELECT episode_index, list({{'s': s, 'e': e}} ORDER BY s) AS g FROM tiles GROUP BY 1
  UNION ALL
  SELECT episode_index, g[:lo - 1] || [{{'s': g[lo].s, 'e': g[lo + 1].e}}] || g[lo + 2:]
  FROM (
    SELECT episode_index, g, CASE WHEN i = 1 THEN 1 WHEN i = len(g) THEN i - 1
        WHEN g[i - 1].e - g[i - 1].s <= g[i + 1].e - g[i + 1].s THEN i - 1 ELSE i END AS lo
    FROM (SELECT episode_index, g, list_position([x.e - x.s for x in g], list_min([x.e - x.s for x in g])) AS i
          FROM st WHERE len(g) > 1 AND list_min([x.e - x.s for x in g]) < {min_length}))),
final AS (SELECT episode_index, g FROM st WHERE len(g) = 1 OR list_min([x.e - x.s for x in g]) >= {min_length})"""


_FINAL = """SELECT episode_index, (i - 1)::BIGINT AS segment_index, g[i].s AS start_frame, g[i].e AS end_frame
FROM (SELECT episode_index, g, unnest(range(1, len(g) + 1)) AS i FROM final)"""
_NEAR = """near AS (SELECT *, lag(p) OVER w AS l, lead(p) OVER w AS r,
    min(p) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS low
  FROM curve WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
loc AS (SELECT episode_index, frame_index::BIGINT AS peak, p AS height FROM near
  WHERE p >= coalesce(l, -1) AND p >= coalesce(r, -1) AND (p > coalesce(l, -1) OR p > coalesce(r, -1)) AND p - low >= 0.15)"""
_RAW = """curve AS (SELECT episode_index, frame_index, value / (value + 100.0::DOUBLE) AS p FROM ev)"""
_UP = """n AS (SELECT episode_index, count(*)::BIGINT AS n, (count(*) * 8 + 5)::BIGINT AS k FROM ev GROUP BY 1),
curve AS (
  SELECT g.episode_index, g.j::BIGINT AS frame_index, e.value / (e.value + 100.0::DOUBLE) AS p
  FROM (SELECT episode_index, n, k, unnest(range(k)) AS j FROM n) g
  JOIN ev e ON e.episode_index = g.episode_index
   AND e.frame_index = least(floor((g.j + 0.5::DOUBLE) * (g.n::DOUBLE / g.k::DOUBLE))::BIGINT, g.n - 1))"""


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


ORACLES = {
    "frame_transitions": with_(EV)
    + """SELECT episode_index, frame_index::BIGINT AS frame_index,
  CASE WHEN label <> lag(label) OVER (PARTITION BY episode_index ORDER BY frame_index) THEN 1 ELSE 0 END AS changed FROM ev""",
    "boundary_steps": with_(EV, _COARSE, _STEPS, _CODE) + "SELECT * FROM bound",
    "boundary_steps_spec": with_(EV, _COARSE, _STEPS, _bound("TRUE")) + "SELECT * FROM bound",
    "boundary_density": with_(EV, _COARSE, _STEPS, _CODE)
    + "SELECT episode_index, sum(boundary)::BIGINT AS n_pos, round(avg(boundary), 6) AS share FROM bound GROUP BY 1",
    "soft_boundaries": with_(EV)
    + """SELECT a.episode_index, a.frame_index::BIGINT AS step,
  round(least(coalesce(sum(exp(-((a.frame_index - b.frame_index) * (a.frame_index - b.frame_index))::DOUBLE / 8.0)), 0.0), 1.0), 6) AS soft
FROM ev a LEFT JOIN ev b ON b.episode_index = a.episode_index AND b.value > 120
 AND b.frame_index BETWEEN a.frame_index - 6 AND a.frame_index + 6
GROUP BY 1, 2""",
    "plateau_peaks": with_(EV, _CURVE, _TOPS) + "SELECT episode_index, peak, height FROM tops",
    "peaks_threshold": with_(EV, _CURVE, _TOPS) + "SELECT episode_index, peak, height FROM tops WHERE height >= 0.5",
    "local_peaks": with_(EV, _CURVE, _NEAR) + "SELECT episode_index, peak, height FROM loc",
    "local_peaks_kept": _recursive(EV, _CURVE, _NEAR, _greedy("loc", 3, "ASC"))
    + "SELECT episode_index, peak, height FROM kept",
    "peaks_full": _recursive(EV, _RAW, _TOPS, _PROMINENCE, _greedy("tops", 4, "DESC"))
    + """SELECT k.episode_index, k.peak, round(k.height, 6) AS height
FROM kept k JOIN prom p ON p.episode_index = k.episode_index AND p.peak = k.peak
WHERE k.height >= 0.3 AND p.prominence >= 0.1""",
    "segments_min_length": _recursive(EV, _CURVE, _TOPS, _SEGMENTS, _merged(5)) + _FINAL,
    "segments_from_probs": _recursive(
        EV,
        _UP,
        _TOPS,
        _PROMINENCE,
        _greedy("tops", 3, "DESC"),
        """len AS (SELECT episode_index, k AS t FROM n)""",
        """edge AS (SELECT episode_index, 0::BIGINT AS b FROM len UNION
          SELECT k.episode_index, k.peak FROM kept k JOIN prom p ON p.episode_index = k.episode_index AND p.peak = k.peak
          WHERE k.height >= 0.5 AND p.prominence >= 0.1)""",
        _merged(5),
    )
    + _FINAL,
    "peak_prominence": with_(EV, _CURVE, _TOPS, _PROMINENCE)
    + "SELECT episode_index, peak, round(prominence, 6) + 0.0 AS prominence FROM prom",
    "boundary_segments": with_(EV, _CURVE, _TOPS, _SEGMENTS)
    + """SELECT e.episode_index, (row_number() OVER w - 1)::BIGINT AS segment_index, e.b AS start_frame,
  coalesce(lead(e.b) OVER w, l.t)::BIGINT AS end_frame
FROM edge e JOIN len l USING (episode_index) WINDOW w AS (PARTITION BY e.episode_index ORDER BY e.b)""",
}
