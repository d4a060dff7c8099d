"""Document quality rules as one projection.

A table of thresholds over measured values (lengths, symbol, stop-word and line ratios) is
compiled into Spark expressions; no user function runs. Repeated 8-word windows are found by
the hash of each window inside its document, so no row ever leaves its document.

Defined results: null text and text without words count as empty (all counts 0) and fail
``min_words``. A null ratio cannot occur: every division is guarded. Rows are judged one by
one, so repeated rows and ties give equal results; only the named columns are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "a", "are", "it"),
    "de": ("der", "die", "das", "und", "ist", "von", "zu", "mit", "den", "ein", "eine", "im"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "est", "en", "du", "qui"),
    "es": ("el", "los", "las", "y", "que", "no", "por", "con", "para", "al", "se", "su"),
}


@dataclass(frozen=True)
class Rule:
    """``value`` must lie in [low, high]; a missing bound does not restrict."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (F.expr(self.value) < F.lit(self.low))
        if self.high is not None:
            bad = bad | (F.expr(self.value) > F.lit(self.high))
        return F.coalesce(bad, F.lit(False))


#: The part of the rules that is fixed by contract.
BASE_RULES = (
    Rule("min_words", "n_words", low=20),
    Rule("repeated_windows", "100 * n_repeat_words - 30 * n_words", high=0),
)
#: Rules of this operator; each needs clear evidence, so that ordinary prose passes.
RULES = (
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", low=1.5, high=40.0),
    Rule("symbol_ratio", "n_symbols / greatest(n_words, 1)", high=0.3),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.5),
    Rule("upper_case_letters", "n_upper / greatest(word_chars, 1)", high=0.6),
    Rule("stop_words", "CASE WHEN n_words >= 200 THEN n_stop_words ELSE 1 END", low=1),
)


def words_of(text: Column) -> Column:
    """The words of a text, in order; a word is a run of anything but ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), lambda w: w != "")


def with_repeats(df: DataFrame, hashes: str, width: int, out: str) -> DataFrame:
    """Add the number of words inside windows of ``width`` words that occur at least twice.

    Steps are separate projections: a later step reads the arrays of an earlier one by
    position, and an expression repeated inside a lambda would be computed for every element.
    """
    last = F.size(hashes) - width  # zero-based start of the last window
    starts = F.when(last >= 1, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i + 1, F.lit(width)))))
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    near = lambda k: F.get("_sorted", k)["h"]
    hits = F.transform(
        "_sorted", lambda x, k: F.when((near(k - 1) == x["h"]) | (near(k + 1) == x["h"]), x["i"])
    )
    covered = F.aggregate(
        F.array_sort(F.filter(hits, lambda i: i.isNotNull())),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct(
            (a["n"] + i + width - F.greatest(i, a["end"])).alias("n"), (i + width).alias("end")
        ),
    )["n"]
    return df.withColumn(out, covered).drop("_windows", "_sorted")


def measure(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per row of ``docs``: every value that rules may use.

    ``_row`` holds the id and the columns of ``keep``, so that they cannot clash with values.
    """
    stops = F.array(*[F.lit(w) for words in STOP_WORDS.values() for w in words])
    base = docs.select(
        F.struct(*[F.col(c) for c in dict.fromkeys((id_col, *keep))]).alias("_row"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    ).select(
        "*",
        words_of(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    base = base.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    values = [
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_repeats").cast("long").alias("n_repeat_words"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.size(F.array_intersect(F.transform("_words", lambda w: F.lower(w)), stops)).cast("long").alias("n_stop_words"),
    ]
    return with_repeats(base, "_hashes", window, "_repeats").select("_row", *values)


def apply_rules(
    measured: DataFrame, base: Sequence[Rule] = BASE_RULES, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Add ``base_failed``, ``failed`` (names of all failed rules) and ``kept``.

    The verdict carries a condition that is always true but that Spark cannot look through.
    Without it a filter on ``kept`` would be pushed below the measures and repeat all their
    steps inside one condition, the steps inside lambdas once for every element.
    """
    here = F.monotonically_increasing_id() >= 0
    names = F.filter(
        F.array(*[F.when(r.failed(), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull()
    )
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | rule.failed()
    return measured.select(
        "*", (base_failed & here).alias("base_failed"), names.alias("failed"), ((F.size(names) == 0) & here).alias("kept")
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """Id, columns ``keep``, measures and verdict for every row of ``docs``.

    A measure whose name a kept column has is left out of the result (not of the verdict);
    ``base_failed``, ``failed`` and ``kept`` always are the verdict.
    """
    judged = apply_rules(measure(docs, id_col, text_col, keep=keep))
    verdict = ("base_failed", "failed", "kept")
    own = [c for c in dict.fromkeys((id_col, *keep)) if c not in verdict]
    rest = [c for c in judged.columns if c != "_row" and c not in own]
    return judged.select(*[F.col("_row")[c].alias(c) for c in own], *rest)
