"""Grammars, feature context, trajectories, run logs and batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqseg.operators import features as ft, grammar as gr, runlog as rl, runs as rn, trajectory as tj, vocab as vc
from seqseg.operators.ordered import FRAME, KEYS, neighbours, with_length
from seqseg.plans import adapters as ad
from seqseg.plans.catalog._sql import EV, VOCAB, r6, runs_cte, with_

E = "episode_index"


def _grammar(spark, sf):
    """Two tasks over the event types: in order of frequency, and of largest value."""
    stats = ad.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.count(F.lit(1)).cast("double").alias("by_count"), F.max("value").alias("by_max")
    )
    from pyspark.sql import Window

    long = stats.select("name", F.inline(F.array(
        F.struct(F.lit("by_count").alias("task"), F.col("by_count").alias("score")),
        F.struct(F.lit("by_max").alias("task"), F.col("by_max").alias("score")),
    )))
    order = Window.partitionBy("task").orderBy("score", "name")
    return long.select("task", (F.row_number().over(order) - 1).alias("pos"), "name")


def _vocab(spark, sf):
    return vc.union_vocab(ad.table(spark, sf, "events"), "event_type")


def grammar_edges(spark, sf):
    return gr.edges(_grammar(spark, sf))


def allowed_pairs(spark, sf):
    return gr.allowed_pairs(_grammar(spark, sf), _vocab(spark, sf))


def forbidden_pairs(spark, sf):
    vocab = _vocab(spark, sf)
    return gr.forbidden_pairs(gr.allowed_pairs(_grammar(spark, sf), vocab), vocab)


def forbidden_summary(spark, sf):
    vocab = _vocab(spark, sf)
    found = gr.pair_summary(gr.allowed_pairs(_grammar(spark, sf), vocab), vocab)
    return found.withColumn("density", r6(F.col("density")))


def unrestricted_pairs(spark, sf):
    return gr.all_pairs(_vocab(spark, sf))


def grammar_missing(spark, sf):
    """Grammar names that no high-value event has."""
    high = ad.table(spark, sf, "events").where("event_type <> 'signup'").select(F.col("event_type").alias("name"))
    return gr.missing_names(_grammar(spark, sf), high.distinct())


def transition_audit(spark, sf):
    allowed = gr.allowed_pairs(_grammar(spark, sf), _vocab(spark, sf))
    return gr.audit_transitions(rn.runs(ad.ev_frames(spark, sf)), allowed)


def lag_context(spark, sf):
    found = ft.lag_context(ad.ev_frames(spark, sf).select(*KEYS, FRAME, "value"), "value", 4, (0.25, 0.5, 0.25))
    lags = ft.fibonacci(4)
    names = [f"{p}_{n}" for n in lags for p in ("before", "after")]
    return found.select(E, FRAME, *names, *[r6(F.col(f"mix_{n}")).alias(f"mix_{n}") for n in lags])


def _demos(spark, sf):
    """Event values of a user as a trajectory; the first event type is the sub-task."""
    at_start = F.col(FRAME) == 0
    rows = ad.ev_frames(spark, sf).select(*KEYS, FRAME, F.col("value").alias("y"), "label", "length")
    facts = rows.groupBy(*KEYS).agg(
        F.max("length").alias("n"),
        F.max(F.when(at_start, F.col("label"))).alias("subtask"),
        F.max(F.when(at_start, F.col("y"))).alias("y0"),
        F.max(F.when(F.col(FRAME) == F.col("length") - 1, F.col("y"))).alias("goal"),
    )
    steps = tj.first_demo_steps(facts.withColumnRenamed("n", "length"), ["subtask"], E)
    known = facts.drop("n").join(steps, "subtask")
    return with_length(rows.drop("label", "length"), known)


def demo_derivatives(spark, sf):
    found = tj.derivatives(_demos(spark, sf))
    return found.select(E, FRAME, "subtask", r6(F.col("dy")).alias("dy"), r6(F.col("ddy")).alias("ddy"))


def _weights(spark, sf):
    return tj.forcing_weights(_demos(spark, sf).where("length >= 3"), keys=[*KEYS, "subtask"])


def demo_weights(spark, sf):
    # Weights grow with the squared frame rate; four digits keep the comparison sharp.
    found = _weights(spark, sf)
    return found.select(E, "subtask", "basis", (F.round("weight", 4) + F.lit(0.0)).alias("weight"))


def demos_too_short(spark, sf):
    """Demonstrations that have no weights, as they have fewer than three frames."""
    first = ad.ev_frames(spark, sf).where((F.col(FRAME) == 0) & (F.col("length") < 3))
    return first.select(E, F.col("label").alias("subtask"), F.col("length").cast("long").alias("n_frames"))


def demo_library(spark, sf):
    found = tj.primitive_library(_weights(spark, sf), ["subtask"], E)
    return found.select(
        "subtask", "basis", (F.round("weight", 3) + F.lit(0.0)).alias("weight"), r6(F.col("y0")).alias("y0"), r6(F.col("goal")).alias("goal"), "n_demos"
    )


def _log(spark, sf):
    """Event types as runs, days as epochs, events as steps with two metrics."""
    events = ad.table(spark, sf, "events")
    return events.select(
        F.col("event_type").alias("run_id"),
        F.dayofmonth("ts").cast("long").alias("epoch"),
        F.col("event_id").alias("step"),
        F.inline(F.array(
            F.struct(F.lit("loss").alias("metric"), F.col("value").alias("value")),
            F.struct(F.lit("acc").alias("metric"), (F.col("value") / (F.col("value") + 100)).alias("value")),
        )),
    )


def _epochs(spark, sf):
    return rl.epoch_metrics(_log(spark, sf), ["loss", "acc"])


def epoch_metrics(spark, sf):
    return _epochs(spark, sf).select("run_id", "epoch", r6(F.col("loss")).alias("loss"), r6(F.col("acc")).alias("acc"), "num_batches")


def _scored(spark, sf):
    """Largest value of the day as the monitored score; days below 150 have none."""
    top = F.max("value")
    return (
        ad.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("run_id"), F.dayofmonth("ts").cast("long").alias("epoch"))
        .agg(F.when(top >= 150, top).alias("score"))
    )


def top_epochs(spark, sf):
    found = rl.top_epochs(_scored(spark, sf), "score", 3, "min")
    return found.select("run_id", "epoch", "score", F.col("rank").cast("long").alias("rank"))


def best_so_far(spark, sf):
    return rl.best_so_far(_scored(spark, sf), "score").select("run_id", "epoch", "best", "improved")


def early_stop(spark, sf):
    return rl.early_stop(_scored(spark, sf), "score", 3)


def early_stop_margin(spark, sf):
    """Every event is an epoch of its type; an improvement beats the last one by more than 5."""
    epochs = ad.table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"), F.col("event_id").cast("long").alias("epoch"), F.col("value").alias("score")
    )
    return rl.early_stop(epochs, "score", 400, "max", 5.0)


def monitored_metric(spark, sf):
    """Metric lookup over maps that hold it only sometimes."""
    rows = ad.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("f1"), F.col("o_totalprice"))).alias("val_metrics"),
        F.when(F.col("o_orderpriority") > "3", F.create_map(F.lit("f1"), F.col("o_totalprice") * 2)).alias("train_metrics"),
        F.create_map(F.lit("loss"), F.col("o_totalprice")).alias("metrics"),
        F.lit(-1.0).alias("f1"),
    )
    return rows.select("o_orderkey", rl.pick_metric("f1").alias("score"))


def label_changes(spark, sf):
    """Batch twin of the label-change stream, with the action lookup."""
    from seqseg.streaming.changes import attach_actions, label_changes_batch

    high = ad.table(spark, sf, "events").where("event_type <> 'signup'").select(F.col("event_type").alias("label"))
    actions = high.distinct().withColumn("action", F.concat(F.lit("do_"), F.col("label")))
    changes = label_changes_batch(ad.ev_frames(spark, sf).select(*KEYS, FRAME, "label"), KEYS)
    return attach_actions(changes, actions).select(E, FRAME, "label", "action")


def rolling_clip(spark, sf):
    """Batch twin of the clip stream: the last 16 frames at every frame."""
    from seqseg.streaming.clips import rolling_clips_batch

    clips = rolling_clips_batch(ad.ev_frames(spark, sf).select(*KEYS, FRAME, "value"), "value", 16)
    return clips.select(
        E, FRAME, F.size("clip").cast("long").alias("n"), F.element_at("clip", 1).alias("first"),
        F.element_at("clip", -1).alias("last"), r6(F.aggregate("clip", F.lit(0.0), lambda a, x: a + x)).alias("total"),
    )


QUERIES = {
    "grammar_edges": grammar_edges,
    "allowed_pairs": allowed_pairs,
    "forbidden_pairs": forbidden_pairs,
    "forbidden_summary": forbidden_summary,
    "unrestricted_pairs": unrestricted_pairs,
    "grammar_missing": grammar_missing,
    "transition_audit": transition_audit,
    "lag_context": lag_context,
    "demo_derivatives": demo_derivatives,
    "demo_weights": demo_weights,
    "demos_too_short": demos_too_short,
    "demo_library": demo_library,
    "epoch_metrics": epoch_metrics,
    "top_epochs": top_epochs,
    "best_so_far": best_so_far,
    "early_stop": early_stop,
    "early_stop_margin": early_stop_margin,
    "monitored_metric": monitored_metric,
    "label_changes": label_changes,
    "rolling_clip": rolling_clip,
}

_GRAMMAR = """gram AS (
  SELECT task, row_number() OVER (PARTITION BY task ORDER BY score, name) - 1 AS pos, name FROM (
    SELECT 'by_count' AS task, event_type AS name, count(*)::DOUBLE AS score FROM events GROUP BY 2
    UNION ALL SELECT 'by_max', event_type, max(value) FROM events GROUP BY 2)),
edge AS (SELECT DISTINCT a.name AS src, b.name AS dst FROM gram a JOIN gram b ON b.task = a.task AND b.pos = a.pos + 1),
ok AS (
  SELECT name AS src, name AS dst FROM vocab UNION SELECT src, dst FROM edge
  UNION SELECT 'background', name FROM gram UNION SELECT name, 'background' FROM gram),
pairs AS (SELECT a.name AS src, b.name AS dst FROM vocab a CROSS JOIN vocab b)"""
_DEMOS = """demo AS (
  SELECT episode_index AS e, frame_index AS t, value AS y, count(*) OVER w AS n,
    first_value(label) OVER o AS subtask, first_value(value) OVER o AS y0, last_value(value) OVER o AS goal
  FROM ev WINDOW w AS (PARTITION BY episode_index),
    o AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
step AS (SELECT subtask, 1.0::DOUBLE / greatest(arg_min(n, e) - 1, 1) AS dt FROM demo GROUP BY 1),
d0 AS (SELECT * FROM demo JOIN step USING (subtask)),
d1 AS (SELECT *, CASE WHEN t = 0 THEN (lead(y) OVER w - y) / dt WHEN t = n - 1 THEN (y - lag(y) OVER w) / dt
  ELSE (lead(y) OVER w - lag(y) OVER w) / (dt * 2) END AS dy FROM d0 WINDOW w AS (PARTITION BY e ORDER BY t)),
d2 AS (SELECT *, CASE WHEN t = 0 THEN (lead(dy) OVER w - dy) / dt WHEN t = n - 1 THEN (dy - lag(dy) OVER w) / dt
  ELSE (lead(dy) OVER w - lag(dy) OVER w) / (dt * 2) END AS ddy FROM d1 WINDOW w AS (PARTITION BY e ORDER BY t))"""
_WEIGHTS = """basis AS (SELECT i, exp(-(i / 9.0::DOUBLE)) AS c,
    1.0 / (pow(exp(-(least(i, 8) / 9.0::DOUBLE)) - exp(-((least(i, 8) + 1) / 9.0::DOUBLE)), 2) + 1e-8) AS h
  FROM (SELECT unnest(range(10)) AS i)),
ph AS (SELECT *, pow(greatest(1 - dt, 0), t) AS x, ddy - 25.0 * (6.25 * (goal - y) - dy) AS f FROM d2 WHERE n >= 3),
wt AS (SELECT e, subtask, i::BIGINT AS basis, any_value(y0) AS y0, any_value(goal) AS goal,
    sum(x * (goal - y0) * exp(-h * pow(x - c, 2)) * f) / (sum(pow(x * (goal - y0), 2) * exp(-h * pow(x - c, 2))) + 1e-10) AS weight
  FROM ph CROSS JOIN basis GROUP BY 1, 2, 3)"""
_SCORED = """ep AS (SELECT event_type AS run_id, day(ts)::BIGINT AS epoch,
  CASE WHEN max(value) >= 150 THEN max(value) END AS score FROM events GROUP BY 1, 2)"""

ORACLES = {
    "grammar_edges": with_(VOCAB, _GRAMMAR) + "SELECT src, dst FROM edge",
    "allowed_pairs": with_(VOCAB, _GRAMMAR) + "SELECT src, dst FROM ok",
    "forbidden_pairs": with_(VOCAB, _GRAMMAR) + "SELECT src, dst FROM pairs EXCEPT SELECT src, dst FROM ok",
    "forbidden_summary": with_(VOCAB, _GRAMMAR)
    + """SELECT count(DISTINCT src)::BIGINT AS num_classes, count(*) FILTER (good)::BIGINT AS n_allowed,
  count(*) FILTER (NOT good)::BIGINT AS n_forbidden, round((count(*) FILTER (good)) / count(*), 6) AS density
FROM (SELECT p.src, p.dst, EXISTS (SELECT 1 FROM ok WHERE ok.src = p.src AND ok.dst = p.dst) AS good FROM pairs p)""",
    "unrestricted_pairs": with_(VOCAB, _GRAMMAR) + "SELECT src, dst FROM pairs",
    "grammar_missing": """SELECT name FROM (SELECT event_type AS name FROM events UNION SELECT 'background')
WHERE name NOT IN (SELECT event_type FROM events WHERE event_type <> 'signup')""",
    "transition_audit": with_(EV, VOCAB, _GRAMMAR, runs_cte("ev"))
    + """SELECT a.label AS src, b.label AS dst, count(*)::BIGINT AS n,
  EXISTS (SELECT 1 FROM ok WHERE ok.src = a.label AND ok.dst = b.label) AS allowed
FROM runs a JOIN runs b ON b.episode_index = a.episode_index AND b.segment_index = a.segment_index + 1 GROUP BY 1, 2""",
    "lag_context": with_(
        EV,
        "c AS (SELECT episode_index, frame_index::BIGINT AS frame_index, value, "
        + ", ".join(
            f"lag(value, {n}, 0.0) OVER w AS before_{n}, lead(value, {n}, 0.0) OVER w AS after_{n}" for n in (1, 2, 3, 5)
        )
        + " FROM ev WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))",
    )
    + "SELECT episode_index, frame_index, "
    + ", ".join(
        f"before_{n}, after_{n}, round(0.25 * before_{n} + 0.5 * value + 0.25 * after_{n}, 6) AS mix_{n}" for n in (1, 2, 3, 5)
    )
    + " FROM c",
    "demo_derivatives": with_(EV, _DEMOS)
    + "SELECT e AS episode_index, t::BIGINT AS frame_index, subtask, round(dy, 6) + 0.0 AS dy, round(ddy, 6) + 0.0 AS ddy FROM d2",
    "demo_weights": with_(EV, _DEMOS, _WEIGHTS) + "SELECT e AS episode_index, subtask, basis, round(weight, 4) + 0.0 AS weight FROM wt",
    "demos_too_short": with_(EV)
    + """SELECT episode_index, arg_min(label, frame_index) AS subtask, count(*)::BIGINT AS n_frames
FROM ev GROUP BY 1 HAVING count(*) < 3""",
    "demo_library": with_(EV, _DEMOS, _WEIGHTS)
    + """SELECT subtask, basis, round(avg(weight), 3) + 0.0 AS weight, round(avg(y0), 6) AS y0, round(avg(goal), 6) AS goal,
  count(DISTINCT e)::BIGINT AS n_demos FROM wt GROUP BY 1, 2""",
    "epoch_metrics": """SELECT event_type AS run_id, day(ts)::BIGINT AS epoch, round(avg(value), 6) AS loss,
  round(avg(value / (value + 100)), 6) AS acc, count(*)::DOUBLE AS num_batches FROM events GROUP BY 1, 2""",
    "top_epochs": with_(_SCORED)
    + """SELECT run_id, epoch, score, row_number() OVER w AS rank FROM ep WHERE score IS NOT NULL
WINDOW w AS (PARTITION BY run_id ORDER BY score, epoch DESC) QUALIFY rank <= 3""",
    "best_so_far": with_(_SCORED)
    + """SELECT run_id, epoch, max(score) OVER (PARTITION BY run_id ORDER BY epoch) AS best,
  score IS NOT NULL AND score > coalesce(max(score) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS improved
FROM ep""",
    "early_stop": with_(
        _SCORED,
        """a AS (SELECT run_id, epoch, row_number() OVER w AS i,
          score > coalesce(max(score) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better
          FROM ep WHERE score IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY epoch))""",
        "b AS (SELECT *, i - max(CASE WHEN better THEN i END) OVER (PARTITION BY run_id ORDER BY epoch) AS waited FROM a)",
    )
    + "SELECT run_id, min(CASE WHEN waited >= 3 THEN epoch END) AS stop_epoch FROM b GROUP BY 1",
    "early_stop_margin": """WITH RECURSIVE ep AS (SELECT event_type AS run_id, event_id AS epoch, value AS score FROM events WHERE value IS NOT NULL),
acc(run_id, epoch, score) AS (
  SELECT run_id, min(epoch), arg_min(score, epoch) FROM ep GROUP BY 1
  UNION ALL
  SELECT e.run_id, min(e.epoch), arg_min(e.score, e.epoch) FROM acc a JOIN ep e
    ON e.run_id = a.run_id AND e.epoch > a.epoch AND e.score > a.score + 5 GROUP BY e.run_id),
i AS (SELECT run_id, epoch, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS i FROM ep),
w AS (SELECT i.run_id, i.epoch, i - max(CASE WHEN acc.epoch IS NOT NULL THEN i END) OVER (PARTITION BY i.run_id ORDER BY i.epoch) AS waited
  FROM i LEFT JOIN acc ON acc.run_id = i.run_id AND acc.epoch = i.epoch)
SELECT run_id, min(CASE WHEN waited >= 400 THEN epoch END)::BIGINT AS stop_epoch FROM w GROUP BY 1""",
    "monitored_metric": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice
  WHEN o_orderpriority > '3' THEN o_totalprice * 2 ELSE -1.0 END AS score FROM orders""",
    "label_changes": with_(EV)
    + """SELECT c.episode_index, c.frame_index::BIGINT AS frame_index, c.label,
  CASE WHEN c.label IN (SELECT event_type FROM events WHERE event_type <> 'signup') THEN 'do_' || c.label ELSE '(no primitive)' END AS action
FROM (SELECT *, lag(label) OVER (PARTITION BY episode_index ORDER BY frame_index) AS before FROM ev) c
WHERE c.label IS DISTINCT FROM c.before""",
    "rolling_clip": with_(EV)
    + """SELECT episode_index, frame_index::BIGINT AS frame_index, 16::BIGINT AS n, first_value(value) OVER w AS first,
  value AS last, round(sum(value) OVER w, 6) AS total FROM ev
WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)
QUALIFY frame_index >= 15""",
}
