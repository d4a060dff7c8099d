"""Chat formatting from an event log, with DataFrame functions only.

The log holds what a chat front end records: whole messages, streamed deltas, edits and
regenerations. Folding keeps, for every message, what follows its last reset; rendering puts
the messages of a conversation into one string with turn marks; reading back splits that
string again. Work is dealt by (conversation, turn) until the last step, which has to bring
each conversation together because its rendering is one value.

Event kinds: ``message`` and ``edit`` replace the text, ``regenerate`` clears what was there
and starts with its own text, ``delta`` (and any other or null kind) appends. The role of a
message is its last non-null role.

Template: ``<s>[INST] text [/INST]`` for users, ``<s> text </s>`` for assistants and
``<s><<SYS>>role\\ntext<</SYS>>`` for every other role. All control strings begin with ``<``
or ``[``; inside texts and roles these are written as character references, and so is ``&``,
so that escaping is reversible and no text can forge a mark.

Defined results: null text and null role are empty strings; a null conversation id is a
conversation of its own; events with equal sequence numbers are taken in the order of kind,
role and text; a repeated event is applied as often as it is there. An empty log gives an
empty table. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))
USER, ASSISTANT = "user", "assistant"
START = "<s>"
USER_MARKS, ASSISTANT_MARKS, OTHER_MARKS = ("[INST] ", " [/INST]"), (" ", " </s>"), ("<<SYS>>", "<</SYS>>")


def escape(text: Column, pairs=ESCAPES) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescape(text: Column, pairs=ESCAPES) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(pairs), text)


def log_of_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Event log of finished turns. Rows that share a turn become parts of it, in order of role and text."""
    order = Window.partitionBy(conv, turn).orderBy("role", "text")
    return turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.row_number().over(order).alias("part"),
        F.lit(0).cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def streamed_log(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", chars: int = 256) -> DataFrame:
    """Event log that a front end would have recorded for finished turns; folding it gives the turns.

    Every message begins with a draft and a delta to it. Then it is regenerated in deltas of
    ``chars`` characters, or, for about half of them, replaced by an edit. Events of a message
    come last first, so that their order is known from ``seq`` alone.
    """
    event = lambda seq, kind, role, text: F.struct(
        F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text")
    )
    none, role, text = F.lit(None).cast("string"), F.col("role"), F.col("text")
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s).{1,%d}" % chars), F.lit(0))
    deltas = F.transform(
        pieces, lambda p, i: F.struct((i + 3).cast("long").alias("seq"), F.lit("delta").alias("kind"), none.alias("role"), p.alias("text"))
    )
    draft = F.array(event(0, "message", role, F.substring(text, 1, 20)), event(1, "delta", none, F.lit(" (draft)")))
    again = F.concat(F.array(event(2, "regenerate", role, F.lit(""))), deltas)
    edited = F.array(event(2, "edit", role, text))
    is_edit = F.pmod(F.xxhash64("conv_id", "turn", "part"), F.lit(2)) == 0
    finished = log_of_turns(turns, conv, turn)
    events = F.reverse(F.concat(draft, F.when(is_edit, edited).otherwise(again)))
    return finished.select("conv_id", "turn", "part", F.inline(events))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of a log (conv_id, turn, part, seq, kind, role, text)."""
    event = F.struct("seq", "kind", "role", "text")
    folded = events.groupBy("conv_id", "turn", "part").agg(F.sort_array(F.collect_list(event)).alias("_log"))
    reset = F.transform(
        "_log",
        lambda e, i: F.when(F.coalesce(e["kind"].isin("message", "edit", "regenerate"), F.lit(False)), i).otherwise(0),
    )
    folded = folded.withColumn("_from", F.array_max(reset))
    roles = F.filter(F.transform("_log", lambda e: e["role"]), lambda r: r.isNotNull())
    last = F.slice("_log", F.col("_from") + 1, F.size("_log") - F.col("_from"))
    return folded.select(
        "conv_id",
        "turn",
        "part",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(last, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` and ``mask``.

    ``mask`` holds one (skip, take) pair of code-point counts per turn: after ``skip``
    characters that carry no loss, ``take`` characters do.
    """
    role, body = F.col("role"), escape(F.col("text"))
    other = F.concat(escape(role, ROLE_ESCAPES), F.lit("\n"))
    head = (
        F.when(role == USER, F.lit(START + USER_MARKS[0]))
        .when(role == ASSISTANT, F.lit(START + ASSISTANT_MARKS[0]))
        .otherwise(F.concat(F.lit(START + OTHER_MARKS[0]), other))
    )
    tail = (
        F.when(role == USER, F.lit(USER_MARKS[1]))
        .when(role == ASSISTANT, F.lit(ASSISTANT_MARKS[1]))
        .otherwise(F.lit(OTHER_MARKS[1]))
    )
    pieces = messages.select(
        "conv_id", "turn", "part", F.concat(head, body, tail).alias("piece"),
        F.length(head).alias("head"), F.length(body).alias("body"), F.length(tail).alias("tail"),
        (role == ASSISTANT).alias("loss"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "part", "piece", "head", "body", "tail", "loss")))
    grouped = pieces.groupBy("conv_id").agg(ordered.alias("_p"))
    before = lambda i: F.when(i > 0, F.get("_p", i - 1))
    rest = lambda p: F.when(p["loss"], p["tail"]).otherwise(p["head"] + p["body"] + p["tail"])
    mask = F.transform(
        "_p",
        lambda p, i: F.struct(
            (F.coalesce(rest(before(i)), F.lit(0)) + F.when(p["loss"], p["head"]).otherwise(0)).alias("skip"),
            F.when(p["loss"], p["body"]).otherwise(0).alias("take"),
        ),
    )
    return grouped.select(
        "conv_id", F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("formatted"), mask.alias("mask")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text, loss) parsed from ``formatted`` alone."""
    parts = F.split(F.substring("formatted", len(START) + 1, 2**31 - 1), START)
    between = lambda p, marks: F.substring(
        p, F.lit(len(marks[0]) + 1), F.length(p) - len(marks[0]) - len(marks[1])
    )
    split = formatted.withColumn("_parts", parts)

    def turn(p: Column) -> Column:
        is_user, is_other = p.startswith(USER_MARKS[0]), p.startswith(OTHER_MARKS[0])
        role = (
            F.when(is_user, F.lit(USER))
            .when(is_other, unescape(F.substring_index(between(p, OTHER_MARKS), "\n", 1), ROLE_ESCAPES))
            .otherwise(F.lit(ASSISTANT))
        )
        inner = between(p, OTHER_MARKS)
        text = (
            F.when(is_user, between(p, USER_MARKS))
            .when(is_other, F.substring(inner, F.length(F.substring_index(inner, "\n", 1)) + 2, F.length(inner)))
            .otherwise(between(p, ASSISTANT_MARKS))
        )
        return F.struct(
            role.alias("role"), unescape(text).alias("text"), (~(is_user | is_other)).alias("loss")
        )

    return split.withColumn("turns", F.transform("_parts", turn)).drop("_parts")
