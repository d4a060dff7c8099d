"""Shared pieces of the checking SQL, and rounding used on both sides."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(value: Column) -> Column:
    """Six digits; adding zero turns a negative zero into zero."""
    return F.round(value, 6) + F.lit(0.0)


EV = """ev AS (
  SELECT user_id AS episode_index,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
         event_id, ts, event_type AS label, value
  FROM events)"""

LI = """li AS (
  SELECT l_orderkey AS episode_index,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber,
           l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_linestatus) - 1 AS frame_index,
         l_returnflag AS label
  FROM lineitem)"""

EM = """em AS (
  SELECT vec_id // 50 AS episode_index, vec_id % 50 AS frame_index,
         label::BIGINT AS label, embedding::DOUBLE[] AS embedding,
         embedding[1:32]::DOUBLE[] AS rgb, embedding[33:64]::DOUBLE[] AS flow
  FROM embeddings)"""


def runs_cte(source: str, label: str = "label", out: str = "runs") -> str:
    """Plain run-length encoding of one frame relation."""
    return f"""{out}_f AS (
  SELECT episode_index, frame_index, {label} AS label,
         CASE WHEN lag({label}) OVER w IS NOT DISTINCT FROM {label} AND frame_index > 0
              THEN 0 ELSE 1 END AS is_start
  FROM {source} WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
{out}_g AS (
  SELECT *, sum(is_start) OVER (PARTITION BY episode_index ORDER BY frame_index) AS run
  FROM {out}_f),
{out} AS (
  SELECT episode_index, (run - 1)::BIGINT AS segment_index,
         min(frame_index)::BIGINT AS start_frame,
         (max(frame_index) + 1)::BIGINT AS end_frame, any_value(label) AS label
  FROM {out}_g GROUP BY episode_index, run)"""


VOCAB = """vocab AS (
  SELECT 'background' AS name, 0::BIGINT AS id
  UNION ALL
  SELECT name, row_number() OVER (ORDER BY name COLLATE "C") AS id FROM (
    SELECT DISTINCT event_type AS name FROM events WHERE event_type <> 'background'))""".replace(
    ' COLLATE "C"', ""
)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
