"""Query of the phrase mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqseg.llm.phrases import collocations, top_phrases


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return top_phrases(scored, 2000).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op13_phrase_mining": op13_phrase_mining}
ORACLES = {
    "op13_phrase_mining": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) AS sizes(k) WHERE len(w) >= k)
  GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM g WHERE k > 1 AND f >= 30),
inside AS (
  SELECT lang, array_to_string(s[i:i + m - 1], ' ') AS phrase, max(a) AS f
  FROM (SELECT lang, s, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) AS lengths(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE inside.f IS NULL OR 100 * inside.f < 80 * a),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, cut, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = array_to_string(s[1:cut], ' ')
            JOIN g y ON y.lang = cuts.lang AND y.phrase = array_to_string(s[cut + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
}
