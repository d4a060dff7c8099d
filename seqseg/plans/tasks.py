"""Task text of an episode from the several forms it is stored in."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def resolve_task_text(
    episodes: DataFrame, tasks: DataFrame, raw: bool = False
) -> DataFrame:
    """Attach ``task_text``.

    In order: first entry of ``tasks`` if it is a string; if it is a number, its
    dictionary text; dictionary text of ``task_index``; ``task``; the empty string.
    ``tasks`` is JSON text, because an array of strings and an array of numbers must
    stay distinguishable. A number without an entry falls through, a string does not,
    even an empty one. With ``raw`` a number is used as text instead.
    """
    first = F.try_variant_get(F.try_parse_json("tasks"), "$[0]", "variant")
    kind = F.schema_of_variant(first)
    text = F.try_variant_get(first, "$", "string")
    named = episodes.withColumn("_kind", kind).withColumn("_first", text)
    is_text = F.col("_kind") == "STRING"
    is_number = F.col("_kind") == "BIGINT"
    if raw:
        return named.withColumn(
            "task_text", F.coalesce(F.when(is_text | is_number, F.col("_first")), F.lit(""))
        ).drop("_kind", "_first")
    on = [c for c in ("dataset",) if c in tasks.columns]

    # The first entry wins where a number is listed twice.
    text = F.min_by("task", "place") if "place" in tasks.columns else F.min("task")

    def lookup(key: str, out: str) -> DataFrame:
        return tasks.groupBy(*on, F.col("task_index").alias(key)).agg(text.alias(out))

    return (
        named.withColumn("_id", F.when(is_number, F.col("_first").cast("long")))
        .join(lookup("_id", "_by_list"), [*on, "_id"], "left")
        .join(lookup("task_index", "_by_index"), [*on, "task_index"], "left")
        .withColumn(
            "task_text",
            F.coalesce(
                F.when(is_text, F.col("_first")),
                F.col("_by_list"),
                F.col("_by_index"),
                F.col("task"),
                F.lit(""),
            ),
        )
        .drop("_kind", "_first", "_id", "_by_list", "_by_index")
    )
