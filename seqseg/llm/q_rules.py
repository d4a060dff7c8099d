"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqseg.llm.quality_rules import RULES, STOP_WORDS, quality_rules


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOPS = ", ".join(f"'{w}'" for words in STOP_WORDS.values() for w in words)
_KEPT = " AND ".join(
    f"NOT coalesce({bad}, false)"
    for r in RULES
    for bad in (
        [f"({r.value}) < {r.low}"] * (r.low is not None) + [f"({r.value}) > {r.high}"] * (r.high is not None)
    )
)

#: Measures of every document; other checks build on it.
MEASURES_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) >= 8),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM pos),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) >= 2),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(hit.n, 0) AS n_repeat_words,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         len(list_distinct(list_filter(list_transform(words, lambda w: lower(w)), lambda w: w IN ({_STOPS})))) AS n_stop_words
  FROM t LEFT JOIN hit ON hit.doc_id IS NOT DISTINCT FROM t.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {_KEPT} AS kept
FROM m
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {
    "op8_quality_rules": f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({MEASURES_SQL})
"""
}
