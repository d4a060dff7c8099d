"""Boundary curves to segments: peaks, suppression, prominence, minimum length.

Frames are only touched by windows over ``(episode, bucket)``. The order-dependent
steps work on peaks or segments after these are cut into independent groups:

* suppression: a peak that is the highest within the distance is always kept and its
  neighbours always go. What is left is cut wherever two peaks are at least the
  distance apart; peaks of different groups cannot influence each other;
* minimum length: nothing ever merges across the border of two adjacent segments
  that are both long enough, so episodes are cut there;
* prominence: blocks of runs answer what they can alone; scans that leave their block
  climb a pyramid of block maxima and minima, a join per level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from seqseg.session import settle, ship
from seqseg.operators.ordered import (
    BUCKET,
    BUCKET_ROWS,
    FRAME,
    KEYS,
    bucket_of,
    bucket_window,
    carry,
    halo,
    link,
    map_sorted_groups,
    neighbours,
)
from seqseg.operators.runs import runs

# Levels of the pyramid with more blocks than this are joined by sorting, others are sent to all tasks.
SENT_BLOCKS = 4096


def value_runs(
    frames: DataFrame, value: str = "p", keys: Sequence[str] = KEYS, order: str = FRAME, rows: int = BUCKET_ROWS
) -> DataFrame:
    """Stretches of equal value with the values just before and after."""
    found = runs(frames, value, keys, order, rows, edges=True)
    middle = F.floor((F.col("start_frame") + F.col("end_frame") - 1) / F.lit(2)).cast("long")
    top = (F.col(f"previous_{value}") < F.col(value)) & (F.col(f"next_{value}") < F.col(value))
    return found.withColumn("peak", middle).withColumn("is_peak", F.coalesce(top, F.lit(False)))


def plateau_peaks(
    frames: DataFrame, value: str = "p", keys: Sequence[str] = KEYS, order: str = FRAME, rows: int = BUCKET_ROWS
) -> DataFrame:
    """Local maxima; a plateau counts once, at its middle (rounded down).

    Both neighbours must be lower, so the ends of an episode are never peaks.
    """
    return (
        value_runs(frames, value, keys, order, rows)
        .where("is_peak")
        .select(*keys, "peak", F.col(value).alias("height"), "length")
    )


def suppress_near(
    peaks: DataFrame,
    distance: int,
    prefer: str = "later",
    keys: Sequence[str] = KEYS,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Keep the highest peaks so that none are closer than ``distance``.

    Peaks are visited from the highest down; of equal heights the ``prefer``
    ("later" or "earlier") position comes first. A visited peak removes all others
    closer than ``distance``.
    """
    if distance <= 1:
        return peaks
    reach = distance - 1
    sign = 1 if prefer == "later" else -1
    columns = peaks.columns
    rank = F.struct(F.col("height"), (F.col("peak") * sign).alias("_tie"))
    window = bucket_window(keys, "peak")
    near, behind = window.rangeBetween(-reach, reach), window.rangeBetween(-reach, -1)
    # Three chained windows of reach `distance - 1` on one exchange.
    tagged = (
        halo(peaks, 3 * reach, 2 * reach, "peak", rows)
        .withColumn("_top", F.max(rank).over(near) == rank)
        .withColumn("_open", ~F.max("_top").over(near))
        .withColumn("_linked", F.coalesce(F.max("_open").over(behind), F.lit(False)))
        .where(F.col("_own") & (F.col("_top") | F.col("_open")))
        .drop(BUCKET, "_own")
    )
    tagged = settle(tagged)
    kept = tagged.where("_top").select(*columns)
    rest = tagged.where("_open").select(
        *columns, F.when(~F.col("_linked"), F.col("peak")).alias("_cut")
    )
    grouped = carry(rest, {"_before": ("last", F.col("_cut"))}, keys, "peak", rows)
    grouped = grouped.withColumn("_group", F.coalesce("_cut", "_before"))

    def visit(group):
        import numpy as np

        position, height = group["peak"], group["height"]
        alive = np.ones(len(position), dtype=bool)
        chosen = np.zeros(len(position), dtype=bool)
        for i in np.lexsort((-sign * position, -height)):
            if alive[i]:
                low = np.searchsorted(position, position[i] - reach, "left")
                high = np.searchsorted(position, position[i] + reach, "right")
                alive[low:high] = False
                chosen[i] = True
        return {name: values[chosen] for name, values in group.items()}

    passed = [c for c in columns if c not in keys]
    picked = map_sorted_groups(
        grouped,
        [*keys, "_group"],
        ["peak"],
        visit,
        f"{_schema(peaks, keys)}, _group bigint, {_schema(peaks, passed)}",
        passed,
    )
    return kept.unionByName(picked.select(*columns))


def _schema(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def prominences(
    curve: DataFrame,
    value: str = "value",
    keys: Sequence[str] = KEYS,
    rows: int = BUCKET_ROWS,
    fan_in: int = 64,
) -> DataFrame:
    """All peaks with their height above the higher of the two side minima.

    ``curve`` is the result of ``value_runs``. Each side of a peak is scanned up to
    the next *higher* value or the end of the episode. Blocks of ``fan_in`` runs answer
    what they can alone. Other sides climb a pyramid of block maxima and minima until a
    later (earlier) block has a higher value, and go down to that value again; minima
    of the blocks passed on the way are kept. Returns ``keys, peak, height, length,
    prominence``.
    """
    items = curve.select(
        *keys,
        F.col("segment_index").alias("_at"),
        F.floor(F.col("segment_index") / fan_in).cast("long").alias("_block"),
        F.col(value).cast("double").alias("height"),
        "peak",
        "is_peak",
        "length",
    )
    item = F.struct("_at", "height", "peak", "is_peak", "length")
    blocks = settle(items.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(item)).alias("items")))
    top = blocks.agg(F.max("_block")).first()[0]
    heights = F.transform("items", lambda x: x["height"])
    levels = [blocks.select(*keys, "_block", heights.alias("hi"), heights.alias("lo"))]
    while top:  # each level is written once; as a plan it would compute all levels below again wherever it is met
        levels.append(settle(_coarser(levels[-1], keys, fan_in)))
        top //= fan_in
    tops = blocks.select(*keys, "_block", heights.alias("hi"), heights.alias("lo"), F.posexplode("items").alias("_pos", "i"))
    tops = tops.where("i.is_peak").select(*keys, "_block", "hi", "lo", "_pos", "i.peak", "i.height", "i.length")
    sides = (("left", -1), ("right", 1))
    for name, side in sides:
        tops = _scan(tops.withColumn("_side", F.lit(side)), f"_{name}", fan_in)
    tops = tops.drop("hi", "lo", "_side")
    columns = [*keys, "peak", "height", "length"]

    def result(df: DataFrame, low) -> DataFrame:
        return df.select(*columns, (F.col("height") - low).alias("prominence"))

    if len(levels) == 1:
        return result(tops, F.greatest("_left_low", "_right_low"))
    # Few blocks go to the scans that meet in them; of many, Spark knows only the compressed size of their files.
    levels = [level.hint("merge" if level.count() > SENT_BLOCKS else "broadcast") for level in levels]
    tops = settle(tops)
    inside = F.col("_left_at").isNotNull() & F.col("_right_at").isNotNull()
    near = result(tops.where(inside), F.greatest("_left_low", "_right_low"))
    side = [
        F.struct(F.lit(s).alias("_side"), F.col(f"_{name}_at").alias("_found"), F.col(f"_{name}_low").alias("_low"))
        for name, s in sides
    ]
    far = tops.where(~inside).select(*columns, F.col("_block").alias("_node"), F.inline(F.array(*side)))
    ended, climbing, found = [far.where("_found IS NOT NULL").drop("_node", "_found")], far.where("_found IS NULL"), {}
    for k in range(1, len(levels)):
        step = _visit(climbing.drop("_found"), levels[k], keys, fan_in, own=False)
        step = settle(step)
        found[k] = step.where("_found IS NOT NULL").withColumn("_node", F.col("_found")).drop("_found")
        climbing = step.where("_found IS NULL")
    ended.append(climbing.drop("_node", "_found"))  # reached an end of the episode
    going = found[len(levels) - 1]
    for k in range(len(levels) - 2, -1, -1):
        going = _visit(going, levels[k], keys, fan_in, own=True)
        going = going.withColumn("_node", F.col("_found")).drop("_found")
        if k:
            going = going.unionByName(found[k])
    ended.append(going.drop("_node"))
    both = reduce(DataFrame.unionByName, [e.select(*columns, "_low") for e in ended])
    return near.unionByName(result(both.groupBy(*columns).agg(F.max("_low").alias("_low")), F.col("_low")))


def _coarser(level: DataFrame, keys: Sequence[str], fan_in: int) -> DataFrame:
    """The next level of the pyramid: maxima and minima of ``fan_in`` blocks each."""
    child = F.struct("_block", F.array_max("hi").alias("hi"), F.array_min("lo").alias("lo"))
    parent = F.floor(F.col("_block") / fan_in).cast("long")
    grouped = level.select(*keys, parent.alias("_parent"), child.alias("_child")).groupBy(*keys, "_parent")
    children = grouped.agg(F.sort_array(F.collect_list("_child")).alias("_children"))
    return children.select(
        *keys,
        F.col("_parent").alias("_block"),
        F.transform("_children", lambda c: c["hi"]).alias("hi"),
        F.transform("_children", lambda c: c["lo"]).alias("lo"),
    )


def _scan(df: DataFrame, out: str, fan_in: int) -> DataFrame:
    """Next entry of ``hi`` above ``height``, from ``_pos`` on towards ``_side``.

    Adds its number over all blocks (``<out>_at``, null if there is none) and the least
    ``lo`` that was passed (``<out>_low``).
    """
    right = F.col("_side") > 0

    def ahead(column: str):
        return F.when(right, F.slice(column, F.col("_pos") + 2, fan_in)).otherwise(
            F.reverse(F.slice(column, F.lit(1), F.greatest(F.col("_pos"), F.lit(0))))
        )

    df = df.withColumns({"_hi": ahead("hi"), "_lo": ahead("lo")})
    df = df.withColumn("_step", F.array_position(F.transform("_hi", lambda x: x > F.col("height")), F.lit(True)))
    passed = F.slice("_lo", F.lit(1), F.when(F.col("_step") > 0, F.col("_step") - 1).otherwise(fan_in).cast("int"))
    at = F.col("_block") * fan_in + F.col("_pos") + F.col("_step") * F.col("_side")
    return df.withColumns({f"{out}_low": F.array_min(passed), f"{out}_at": F.when(F.col("_step") > 0, at)}).drop("_hi", "_lo", "_step")


def _visit(scans: DataFrame, level: DataFrame, keys: Sequence[str], fan_in: int, own: bool) -> DataFrame:
    """Go on with scans in their block of a level.

    ``_node`` is the entry they come from; with ``own`` it is the block itself, which is
    scanned from its near end. ``_node`` becomes the block, ``_found`` the entry with a
    higher value, if any, and ``_low`` takes in what was passed.
    """
    block = F.col("_node") if own else F.floor(F.col("_node") / fan_in).cast("long")
    met = scans.withColumn("_block", block).join(level, [*keys, "_block"])
    if own:
        position = F.when(F.col("_side") > 0, F.lit(-1)).otherwise(F.size("hi"))
    else:
        position = (F.col("_node") - F.col("_block") * fan_in).cast("int")
    met = _scan(met.withColumn("_pos", position), "_next", fan_in)
    met = met.withColumns({"_low": F.least("_low", "_next_low"), "_node": F.col("_block"), "_found": F.col("_next_at")})
    return met.drop("_block", "hi", "lo", "_pos", "_next_low", "_next_at")


def detect_peaks(
    frames: DataFrame,
    threshold: float = 0.5,
    min_distance: int = 3,
    prominence: float = 0.1,
    value: str = "p",
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Boundary frames: plateau peaks, then distance, prominence and threshold.

    Prominence looks at one peak and the curve, so it is measured first, in the one
    pass over the curve. Peaks below the threshold leave before the distance test: a
    lower peak never removes a higher one, so the result is the same.
    """
    curve = value_runs(frames, value, keys, order, rows)
    if prominence > 0:
        tops = prominences(curve, value, keys, rows)
    else:
        height = F.col(value).alias("height")
        tops = curve.where("is_peak").select(*keys, "peak", height, "length", F.lit(0.0).alias("prominence"))
    high = tops.where(F.col("height") >= threshold)
    chosen = suppress_near(high, max(1, min_distance), "later", keys, rows)
    return chosen.where(F.col("prominence") >= prominence).drop("prominence")


def local_peaks(
    frames: DataFrame,
    min_distance: int = 3,
    prominence: float = 0.1,
    value: str = "p",
    suppress: bool = True,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Simpler detector: not below either neighbour and above at least one.

    Episode ends may be peaks and step edges count twice. Prominence is the height
    above the lowest value within ``min_distance`` frames; then the highest peaks
    suppress their neighbours, the earlier of two equal ones first.
    """
    radius = max(1, min_distance)
    around = lambda w: w.rowsBetween(-radius, radius)
    found = neighbours(
        frames.select(*keys, order, value),
        {
            "_left": lambda w: F.lag(value).over(w),
            "_right": lambda w: F.lead(value).over(w),
            "_low": lambda w: F.min(value).over(around(w)),
        },
        before=radius,
        after=radius,
        keys=keys,
        order=order,
        rows=rows,
    )
    v, left, right = F.col(value), F.col("_left"), F.col("_right")
    candidate = (
        (left.isNull() | (v >= left))
        & (right.isNull() | (v >= right))
        & (left.isNull() | right.isNull() | (v > left) | (v > right))
    )
    found = found.where(candidate)
    if prominence > 0:
        found = found.where(v - F.col("_low") >= prominence)
    peaks = found.select(*keys, F.col(order).alias("peak"), v.alias("height"))
    return suppress_near(peaks, radius, "earlier", keys, rows) if suppress else peaks


def segments_from_boundaries(
    boundaries: DataFrame,
    episodes: DataFrame,
    min_length: int = 5,
    position: str = "peak",
    keys: Sequence[str] = KEYS,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Half-open segments between boundaries; short ones are merged away.

    ``boundaries`` carries the episode ``length``; positions outside ``(0, length)``
    and repeats are ignored. ``episodes`` (keys, length) supplies the first segment of
    every episode. Returns ``keys, segment_index, start_frame, end_frame, length``.
    """
    inner = boundaries.where((F.col(position) > 0) & (F.col(position) < F.col("length")))
    starts = (
        inner.select(*keys, F.col(position).cast("long").alias("start_frame"), "length")
        .distinct()
        .unionByName(
            episodes.where("length > 0").select(*keys, F.lit(0).cast("long").alias("start_frame"), "length")
        )
    )
    tiled = link(starts, keys, "start_frame", rows=rows)
    tiled = tiled.select(
        *keys,
        F.col("_index").alias("segment_index"),
        "start_frame",
        F.coalesce("_next", "length").cast("long").alias("end_frame"),
        "length",
    )
    return merge_short(settle(tiled), min_length, keys, rows) if min_length > 1 else tiled


def merge_short(
    segments: DataFrame, min_length: int, keys: Sequence[str] = KEYS, rows: int = BUCKET_ROWS
) -> DataFrame:
    """Merge segments shorter than ``min_length`` until none (or one segment) is left.

    The shortest one goes first (leftmost of equals), into its shorter neighbour
    (left of equals). Groups between two adjacent long segments are independent;
    groups without a short segment pass through untouched. A group of any size streams
    through its task: merging makes segments longer than the ones it started from, so
    going from the shortest up is one left-to-right pass per length.
    """
    short = (F.col("end_frame") - F.col("start_frame") < min_length).cast("int")
    tagged = neighbours(
        segments.withColumn("_short", short),
        {
            "_left": lambda w: F.lag("_short", 1, 0).over(w),
            "_right": lambda w: F.lead("_short", 1, 0).over(w),
        },
        before=1,
        after=1,
        keys=keys,
        order="segment_index",
        rows=rows,
    )
    # A group without a short segment is a single long one between long ones.
    calm = F.greatest("_short", "_left", "_right") == 0
    idle = tagged.where(calm).select(*keys, "start_frame", "end_frame", "length")
    cut = F.when(F.greatest("_short", "_left") == 0, F.col("segment_index"))
    busy = tagged.where(~calm).withColumn("_cut", cut)
    busy = carry(busy, {"_before": ("last", F.col("_cut"))}, keys, "segment_index", rows)
    busy = busy.withColumn("_group", F.coalesce("_cut", "_before", F.lit(-1).cast("long")))

    ship(segments.sparkSession)
    merged = busy.select(*keys, "_group", "segment_index", "start_frame", "end_frame", "length")
    merged = (
        merged.repartition(*keys, "_group")
        .sortWithinPartitions(*keys, "_group", "segment_index")
        .mapInPandas(
            partial(_merge_stream, keys=[*keys, "_group"], min_length=min_length),
            f"{_schema(segments, keys)}, _group bigint, start_frame bigint, end_frame bigint, length bigint",
        )
        .drop("_group")
    )
    whole = settle(idle.unionByName(merged))
    return link(whole, keys, "start_frame", rows=rows).select(
        *keys, F.col("_index").alias("segment_index"), "start_frame", "end_frame", "length"
    )


class _LengthPass:
    """Merge all segments of one length, left to right, holding two segments."""

    __slots__ = ("size", "done", "open")

    def __init__(self, size: int):
        self.size, self.done, self.open = size, None, None

    def push(self, segment: tuple):
        """Take the next segment; return one that cannot change any more, if any."""
        current, self.open = self.open, segment
        if current is None:
            return None
        if current[1] - current[0] != self.size:
            finished, self.done = self.done, current
            return finished
        left = self.done
        if left is not None and left[1] - left[0] <= segment[1] - segment[0]:
            self.done = (left[0], current[1])
        else:
            self.open = (current[0], segment[1])
        return None

    def drain(self) -> list:
        left, current = self.done, self.open
        self.done = self.open = None
        if left is not None and current[1] - current[0] == self.size:
            return [(left[0], current[1])]
        return [x for x in (left, current) if x is not None]


def _merge_stream(batches, keys, min_length):
    """Merge short segments of sorted groups; state is two segments per length."""
    import pandas as pd

    passes = [_LengthPass(size) for size in range(1, min_length)]
    group, total = None, 0

    def feed(segment, first):
        for level in range(first, len(passes)):
            segment = passes[level].push(segment)
            if segment is None:
                return
        out.append((*group, int(segment[0]), int(segment[1]), total))

    def close():
        for level in range(len(passes)):
            for segment in passes[level].drain():
                feed(segment, level + 1)

    columns = [*keys, "start_frame", "end_frame", "length"]
    out = []
    for batch in batches:
        for row in zip(*[batch[c].tolist() for c in columns]):
            if row[: len(keys)] != group:
                if group is not None:
                    close()
                group, total = row[: len(keys)], row[-1]
            feed(row[-3:-1], 0)
        if out:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if group is not None:
        close()
    if out:
        yield pd.DataFrame(out, columns=columns)


def segments_from_probs(
    probs: DataFrame,
    target,
    threshold: float = 0.5,
    min_distance: int = 3,
    min_length: int = 5,
    prominence: float = 0.1,
    value: str = "p",
    keys: Sequence[str] = KEYS,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Step probabilities to segments in frame positions.

    ``target`` is the number of frames as an expression over ``length`` (steps).
    """
    from seqseg.operators.ordered import with_length
    from seqseg.operators.resample import resample

    sized = with_length(probs, keys=keys, rows=rows).withColumn("_frames", target.cast("long"))
    up = resample(
        sized, [value], F.col("_frames"), "centre", source=F.col("length"), keys=keys, rows=rows
    )
    peaks = detect_peaks(up, threshold, min_distance, prominence, value, keys, FRAME, rows)
    episodes = sized.groupBy(*keys).agg(F.max("_frames").alias("length"))
    return segments_from_boundaries(peaks, episodes, min_length, "peak", keys, rows)
