"""Query of the conversation prefix trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqseg.llm.conversation_trie import conversation_trie


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_BYTE = "list_reduce(list_prepend(xor(c, b::BIGINT), [1, 2, 3, 4, 5, 6, 7, 8]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"

QUERIES = {"op12_conversation_trie": op12_conversation_trie}
ORACLES = {
    "op12_conversation_trie": f"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS c FROM t
  UNION ALL
  SELECT conv_id, s, i + 1, {_BYTE} FROM (SELECT *, ascii(s[i + 1]) AS b FROM crc WHERE i < len(s))),
h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE i = len(s)),
r AS (
  SELECT h.conv_id, t.p, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 WHERE t.p <= h
  UNION ALL SELECT h.conv_id, t.p + 1000000, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id WHERE t.p > h),
k AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d FROM r),
chain AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS node, '' AS up, 0::BIGINT AS size FROM h
  UNION ALL
  SELECT chain.conv_id, k.d, sha256(chain.node || ':' || length(k.role) || ':' || k.role || k.text), chain.node, strlen(k.text)
  FROM chain JOIN k ON k.conv_id = chain.conv_id AND k.d = chain.d + 1),
ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS names
  FROM (SELECT conv_id, arg_max(node, d) AS node FROM chain GROUP BY conv_id) GROUP BY node),
n AS (SELECT node, d, any_value(up) AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n FROM chain GROUP BY node, d),
c AS (SELECT up AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
path AS (
  SELECT node AS top, node, d FROM n
  UNION ALL SELECT path.top, n.node, n.d FROM path JOIN n ON n.up = path.node AND n.d = path.d + 1),
sums AS (
  SELECT top, sum((n.n - 1) * size)::BIGINT AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM path JOIN n USING (node) LEFT JOIN c USING (node) GROUP BY top)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens, sha256(coalesce(names, '')) AS ends_sha256
FROM n JOIN sums ON sums.top = n.node LEFT JOIN c ON c.node = n.node LEFT JOIN ends ON ends.node = n.node
     LEFT JOIN n u ON u.node = n.up AND n.d > 0
"""
}
