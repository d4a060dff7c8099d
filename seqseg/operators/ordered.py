"""Ordered operations inside an episode that never need the whole episode in one task.

``Window.partitionBy(episode)`` puts an episode into one task. One episode may hold
a third of a 100 TB table, so every operator here partitions by
``(episode, bucket)`` instead, where a bucket is a fixed range of frame positions:

* *bounded reach* (previous frame, next frame, +-r frames): ``halo`` copies only the
  rows near a bucket edge into the neighbouring bucket; one exchange, no join;
* *unbounded reach* (running sums, next start, episode length): one small row per
  bucket is aggregated first, the running value is computed over those rows and
  joined back on ``(episode, bucket)``. That table is ``BUCKET_ROWS`` times smaller
  than the frames.

The frame position is dense and starts at zero (``rank_rows`` makes one).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

KEYS = ("dataset", "episode_index")
FRAME = "frame_index"
BUCKET = "_bucket"
BUCKET_ROWS = 65_536


def bucket_of(position: Column, rows: int) -> Column:
    return F.floor(position / F.lit(rows)).cast("long")


def placed_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows that have a key and a position (all rows, by contract).

    Saying so lets both sides of a bucket join read one exchange: otherwise Spark adds
    the null filter to one side only and the two no longer match.
    """
    return reduce(lambda d, c: d.where(F.col(c).isNotNull()), (*keys, order), df)


def bucket_window(keys: Sequence[str], order: str = FRAME) -> WindowSpec:
    return Window.partitionBy(*keys, BUCKET).orderBy(order)


_LOWEST = {"string": "", "date": "0001-01-01", "timestamp": "0001-01-01", "timestamp_ntz": "0001-01-01"}


def _no_null(value: Column, kind: str) -> Column:
    """Nulls sort first, so they may share the group of the lowest value."""
    lowest = _LOWEST.get(kind, "-Infinity" if kind in ("double", "float") else None)
    if lowest is None:
        bits = {"tinyint": 7, "smallint": 15, "int": 31}.get(kind, 63)
        return F.coalesce(value, F.lit(-(1 << bits)).cast(kind))
    return F.coalesce(value, F.lit(lowest).cast(kind))


def time_hours(df: DataFrame, column: str) -> Column:
    """Number of the hour a timestamp lies in; never decreases with the timestamp, in any time zone."""
    ts = F.col(column)
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.unix_date(ts.cast("date")) * 24 + F.hour(ts)
    return F.floor(F.unix_micros(ts) / F.lit(3_600_000_000)).cast("long")


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    coarse: Sequence[Column],
    out: str = FRAME,
    total: str | None = None,
) -> DataFrame:
    """Dense zero-based position of each row inside its key.

    ``coarse`` must not decrease along ``order`` (the hour of a timestamp, a date, a
    block of numbers). Rows are numbered inside ``(key, coarse)`` and the counts of
    earlier coarse groups are added, for every key alike, so a key that holds a third
    of the rows is spread over many tasks. ``total`` names an optional column for the
    number of rows of the key. For one order over all rows see ``rank_all``.
    """
    names = [f"_c{i}" for i in range(len(coarse))]
    filled = [f"_k{i}" for i in range(len(keys))]
    # Nulls become values plus a mark, so that one plain exchange serves windows and join.
    nulls = reduce(lambda a, k: a * 2 + F.isnull(k).cast("int"), keys, F.lit(0)).alias("_nulls")
    sources = [*[F.col(k).alias(n) for k, n in zip(keys, filled)], *[c.alias(n) for c, n in zip(coarse, names)]]
    tagged = df.select("*", *sources, nulls)
    kinds = {f.name: f.dataType.simpleString() for f in tagged.select(*filled, *names).schema}
    tagged = tagged.withColumns({n: _no_null(F.col(n), kind) for n, kind in kinds.items()})
    whole, part = [*filled, "_nulls"], [*filled, "_nulls", *names]
    group = Window.partitionBy(*part)
    numbered = tagged.withColumn("_rn", F.row_number().over(group.orderBy(*order)))
    earlier = (
        Window.partitionBy(*whole)
        .orderBy(*names)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = tagged.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*whole)))
    # Spark plans this join from the compressed size of the source files: never broadcast the groups.
    joined = numbered.join(offsets.drop("_n").hint("merge"), part)
    joined = joined.withColumn(out, (F.col("_before") + F.col("_rn") - 1).cast("long"))
    return joined.drop(*part, "_rn", "_before")


def rank_all(df: DataFrame, order: Sequence[Column | str], out: str = FRAME) -> DataFrame:
    """Dense zero-based position of each row in one order over the whole table.

    The table is sorted by ranges that Spark takes from its values, so no prefix or name can
    gather in one task; the written copy is read twice: for the size of each range (one
    row per partition) and for the rows.
    """
    from seqseg.session import settle

    place = F.monotonically_increasing_id()  # partition number, then row number in it
    split = lambda c: (F.shiftright(c, 33).alias("_part"), c.bitwiseAND((1 << 33) - 1).alias("_row"))
    placed = settle(df.orderBy(*order).select("*", place.alias("_place"))).select("*", *split(F.col("_place")))
    sizes = placed.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = placed.join(starts, "_part").withColumn(out, (F.col("_before") + F.col("_row")).cast("long"))
    return ranked.drop("_part", "_row", "_place", "_before")


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Columns of several one-row tables in one row: a union and one aggregate, no join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def halo(
    df: DataFrame,
    before: int = 0,
    after: int = 0,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Assign buckets, with copies of edge rows where a neighbour needs them.

    After this, windows over ``bucket_window`` see ``before`` earlier and ``after``
    later positions of every row with ``_own`` true. Drop the copies with
    ``where(_own)`` once the window values are computed.
    """
    position = F.col(order)
    home = bucket_of(position, rows)
    if before == 0 and after == 0:
        return df.withColumn(BUCKET, home).withColumn("_own", F.lit(True))
    first = F.greatest(bucket_of(position - after, rows), F.lit(0).cast("long"))
    last = bucket_of(position + before, rows)
    return df.withColumn(BUCKET, F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col(BUCKET) == home
    )


def neighbours(
    df: DataFrame,
    columns: dict[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add window columns whose reach is bounded by ``before`` / ``after`` positions."""
    window = bucket_window(keys, order)
    spread = halo(df, before, after, order, rows)
    for name, build in columns.items():
        spread = spread.withColumn(name, build(window))
    return spread.where("_own").drop(BUCKET, "_own")


def lengths(frames: DataFrame, keys: Sequence[str] = KEYS, order: str = FRAME) -> DataFrame:
    """One row per episode with its number of frames."""
    return frames.groupBy(*keys).agg((F.max(order) + 1).cast("long").alias("length"))


def with_length(
    frames: DataFrame,
    per_episode: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
    values: dict[str, Column] | None = None,
) -> DataFrame:
    """Attach the episode length, and optionally other per-episode values, to each frame.

    The join runs on ``(episode, bucket)``, never on the episode alone. ``values``
    maps a name to an aggregate expression over the whole episode that is also its
    own merge (``max``, ``min``, ``max_by`` of a struct, ...).
    """
    if "length" in frames.columns and per_episode is None and not values:
        return frames
    tagged = frames.withColumn(BUCKET, bucket_of(F.col(order), rows))
    partial = [(F.max(order) + 1).cast("long").alias("length")]
    partial += [agg.alias(name) for name, agg in (values or {}).items()]
    whole = Window.partitionBy(*keys)
    per_bucket = tagged.groupBy(*keys, BUCKET).agg(*partial)
    per_bucket = per_bucket.withColumn("length", F.max("length").over(whole))
    for name in values or {}:
        per_bucket = per_bucket.withColumn(name, F.max(name).over(whole))
    if per_episode is not None:
        per_bucket = per_bucket.join(per_episode, list(keys), "left")
    return tagged.join(per_bucket, [*keys, BUCKET]).drop(BUCKET)


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def carry(
    df: DataFrame,
    specs: dict[str, tuple[str, Column]],
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Running values over all *earlier* rows of the episode (exclusive).

    ``specs`` maps an output name to ``(kind, expression)`` with kind one of
    ``sum``, ``max``, ``min`` or ``last`` (latest non-null). ``order`` is an integer
    column, unique inside the episode; gaps are allowed.
    """
    tagged = df.withColumn(BUCKET, bucket_of(F.col(order), rows))
    for name, (_, expression) in specs.items():
        tagged = tagged.withColumn(f"_v_{name}", expression)
    earlier_rows = bucket_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    earlier_buckets = (
        Window.partitionBy(*keys)
        .orderBy(BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local, summary = tagged, []
    for name, (kind, _) in specs.items():
        value = F.col(f"_v_{name}")
        if kind == "last":
            local = local.withColumn(
                f"_l_{name}", F.last(value, ignorenulls=True).over(earlier_rows)
            )
            summary.append(
                F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(f"_b_{name}")
            )
        else:
            local = local.withColumn(f"_l_{name}", _MERGE[kind](value).over(earlier_rows))
            summary.append(_MERGE[kind](value).alias(f"_b_{name}"))
    bounds = tagged.groupBy(*keys, BUCKET).agg(*summary)
    for name, (kind, _) in specs.items():
        value = F.col(f"_b_{name}")
        merged = (
            F.last(value, ignorenulls=True) if kind == "last" else _MERGE[kind](value)
        )
        bounds = bounds.withColumn(f"_p_{name}", merged.over(earlier_buckets))
    bounds = bounds.drop(*[f"_b_{n}" for n in specs])
    out = local.join(bounds, [*keys, BUCKET])
    for name, (kind, _) in specs.items():
        here, prior = F.col(f"_l_{name}"), F.col(f"_p_{name}")
        if kind == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
        elif kind == "max":
            value = F.greatest(here, prior)
        elif kind == "min":
            value = F.least(here, prior)
        else:
            value = F.coalesce(here, prior)
        out = out.withColumn(name, value)
    drop = [f"_{p}_{n}" for n in specs for p in "vlp"]
    return out.drop(BUCKET, *drop)


def link(
    items: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    payload: Sequence[str] = (),
    rows: int = BUCKET_ROWS,
    per_bucket: DataFrame | None = None,
) -> DataFrame:
    """Number sparse items of an episode and look up the following item.

    Adds ``_index`` (zero-based), ``_next`` (position of the next item, null for the
    last) and ``_next_<column>`` for each payload column. ``items`` may already carry
    ``_bucket``. ``per_bucket`` may supply the bucket rows (item count ``_n``, first item
    ``_head``) when they come from the same exchange as the items; the episode maximum
    of any further column in it is returned too. It may leave out episodes that fit
    in one bucket.
    """
    if BUCKET not in items.columns:
        items = placed_rows(items, keys, order).withColumn(BUCKET, bucket_of(F.col(order), rows))
    head = link_head(order, payload)
    window = bucket_window(keys, order)
    local = items.withColumn("_rn", F.row_number().over(window)).withColumn(
        "_lead", F.lead(head).over(window)
    )
    if per_bucket is None:
        per_bucket = items.groupBy(*keys, BUCKET).agg(
            F.count(F.lit(1)).alias("_n"), F.min_by(head, F.col(order)).alias("_head")
        )
    extra = [c for c in per_bucket.columns if c not in (*keys, BUCKET, "_n", "_head")]
    by_bucket = Window.partitionBy(*keys).orderBy(BUCKET)
    backwards = Window.partitionBy(*keys).orderBy(F.desc(BUCKET))
    prior = (Window.unboundedPreceding, -1)
    bounds = per_bucket.select(
        *keys,
        BUCKET,
        *[F.max(c).over(Window.partitionBy(*keys)).alias(c) for c in extra],
        F.sum("_n").over(by_bucket.rowsBetween(*prior)).alias("_base"),
        F.last("_head", ignorenulls=True).over(backwards.rowsBetween(*prior)).alias("_after"),
    )
    following = F.coalesce(F.col("_lead"), F.col("_after"))
    out = (
        local.join(bounds, [*keys, BUCKET], "left")
        .withColumn("_index", (F.coalesce("_base", F.lit(0)) + F.col("_rn") - 1).cast("long"))
        .withColumn("_next", following[order])
    )
    for name in payload:
        out = out.withColumn(f"_next_{name}", following[name])
    return out.drop("_rn", "_lead", "_base", "_after")


def link_head(order: str, payload: Sequence[str]) -> Column:
    return F.struct(F.col(order), *[F.col(p) for p in payload])


def spine(
    episodes: DataFrame,
    length: str = "length",
    keys: Sequence[str] = KEYS,
    out: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """All positions ``0 .. length-1`` of every episode, spread over tasks by bucket."""
    size = F.col(length)
    chunks = (
        episodes.where(size > 0)
        .withColumn(BUCKET, F.explode(F.sequence(F.lit(0).cast("long"), bucket_of(size - 1, rows))))
        .repartition(*keys, BUCKET)
    )
    return chunks.withColumn(out, F.explode(bucket_range(F.col(BUCKET), F.lit(0), size, rows))).drop(BUCKET)


def bucket_range(bucket: Column, start: Column, end: Column, rows: int) -> Column:
    """Positions of ``[start, end)`` that lie in ``bucket`` (which must overlap it)."""
    low = F.greatest(bucket * rows, start.cast("long"))
    high = F.least((bucket + 1) * rows, end.cast("long")) - 1
    return F.sequence(low, high)


def map_sorted_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable,
    schema: str,
    columns: Iterable[str],
) -> DataFrame:
    """Grouped map over *small* groups with one Python call per Arrow batch.

    Spark shuffles by ``keys`` and sorts; the Python side only cuts the stream at key
    changes. ``fn`` receives a dict of NumPy arrays (the listed ``columns``, one
    group) and returns ``None`` or a dict of equally long arrays; key columns are
    repeated by this helper. Used only for order-dependent greedy steps on peaks and
    segments, after the groups were cut to independent pieces.
    """
    import numpy as np
    import pandas as pd

    from seqseg.session import ship

    key_names, column_names = list(keys), list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
            changed = np.zeros(len(block), dtype=bool)
            changed[0] = True
            for key in key_names:
                values = block[key].to_numpy()
                changed[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(changed)
            ends = np.append(starts[1:], len(block))
            arrays = {c: block[c].to_numpy() for c in column_names}
            pieces, sizes = [], []
            for a, b in zip(starts, ends):
                result = fn({c: v[a:b] for c, v in arrays.items()})
                size = 0 if result is None else len(next(iter(result.values())))
                sizes.append(size)
                if size:
                    pieces.append(result)
            if not pieces:
                return
            out = {k: np.repeat(block[k].to_numpy()[starts], sizes) for k in key_names}
            for name in pieces[0]:
                out[name] = np.concatenate([p[name] for p in pieces])
            yield pd.DataFrame(out)

        open_blocks: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = tuple(batch[k].iloc[-1] for k in key_names)
            same = np.ones(len(batch), dtype=bool)
            for key, value in zip(key_names, last):
                same &= batch[key].to_numpy() == value
            cut = len(batch) if not same.any() else int(np.flatnonzero(same)[0])
            if cut == 0 and open_blocks and all(
                open_blocks[-1][k].iloc[-1] == v for k, v in zip(key_names, last)
            ):
                open_blocks.append(batch)
                continue
            closed = [*open_blocks, batch.iloc[:cut]]
            block = pd.concat(closed, ignore_index=True)
            if len(block):
                yield from flush(block)
            open_blocks = [batch.iloc[cut:]]
        if open_blocks:
            block = pd.concat(open_blocks, ignore_index=True)
            if len(block):
                yield from flush(block)

    ship(df.sparkSession)
    kept = list(dict.fromkeys([*key_names, *order, *column_names]))
    return (
        df.select(*kept)
        .repartition(*key_names)
        .sortWithinPartitions(*key_names, *order)
        .mapInPandas(run, schema)
    )
