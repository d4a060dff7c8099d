"""Text expressions: cleaning of generated labels, ids, chat examples."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# These must equal the established formats for equal results.
SYSTEM_PROMPT = (
    "You label robot manipulation subtasks. Given a short video segment and the overall task "
    "instruction, respond with a single concise verb phrase describing the subtask "
    "(e.g., 'reach for the cup', 'place on shelf'). No explanations, no punctuation beyond the phrase."
)
SEGMENT_QUESTION = (
    "Task: %s. What subtask is happening in the video segment? "
    "Answer with a short verb phrase."
)
SUMMARY_SYSTEM_PROMPT = (
    "You summarize robot demonstrations into a single short "
    "task instruction. Reply with one short imperative phrase."
)
SUMMARY_QUESTION = (
    "You will see frames sampled across an entire robot "
    "demonstration. Describe the overall task in a single short "
    'instruction (e.g., "pick and place the cup", "wipe the table").'
)
VIDEO_PLACEHOLDER = "<video>"
SPECIAL_TOKENS = ("<|im_end|>", "<|endoftext|>", "<|im_start|>")
UNKNOWN_LABEL = "unknown"
BACKGROUND = "background"

# Every character that counts as white space at the ends of a label.
_SPACE = "".join(
    [" ", *map(chr, range(0x09, 0x0E)), *map(chr, range(0x1C, 0x20)), chr(0x85), chr(0xA0), chr(0x1680)]
    + [*map(chr, range(0x2000, 0x200B)), chr(0x2028), chr(0x2029), chr(0x202F), chr(0x205F), chr(0x3000)]
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(_SPACE))


def _without_prefix(text: Column, prefix: str) -> Column:
    """Drop a leading ``prefix`` (any case) and the white space behind it."""
    size = len(prefix)
    starts = F.lower(F.substring(text, 1, size)) == prefix
    return F.when(starts, strip(F.substring(text, size + 1, 2_147_483_647))).otherwise(text)


def clean_label(text: Column) -> Column:
    """Generated text to a usable label; nothing usable becomes ``unknown``.

    A leading role marker on its own line is removed, then up to two
    ``assistant:`` prefixes, then the special tokens.
    """
    out = strip(text.cast("string"))
    for marker in ("assistant\n", "assistant:", "assistant:"):
        out = _without_prefix(out, marker)
    for token in SPECIAL_TOKENS:
        out = F.replace(out, F.lit(token), F.lit(""))
    return F.coalesce(F.nullif(strip(out), F.lit("")), F.lit(UNKNOWN_LABEL))


def segment_id(
    dataset: Column, episode: Column, camera: Column, start: Column, end: Column
) -> Column:
    """``name__ep000001__camera__000000_000010``."""
    return F.format_string(
        "%s__ep%06d__%s__%06d_%06d", dataset, episode, camera, start, end
    )


def episode_id(dataset: Column, episode: Column) -> Column:
    """``name__episode_000001``."""
    return F.format_string("%s__episode_%06d", dataset, episode)


def _part(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("text"))


def _message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def segment_chat(task_text: Column, target: Column | None = None) -> Column:
    """Messages of one segment example; the answer turn only when a target exists."""
    question = F.format_string(SEGMENT_QUESTION, task_text)
    prompt = F.array(
        _message("system", _part("text", F.lit(SYSTEM_PROMPT))),
        _message(
            "user",
            _part("video", F.lit(VIDEO_PLACEHOLDER)),
            _part("text", question),
        ),
    )
    if target is None:
        return prompt
    answer = F.array(_message("assistant", _part("text", target)))
    return F.when(target.isNull(), prompt).otherwise(F.concat(prompt, answer))


def summary_chat(n_frames: int) -> Column:
    """Messages that ask for the task of a whole episode."""
    images = [_part("image", F.lit(f"frame_{i}")) for i in range(n_frames)]
    return F.array(
        _message("system", _part("text", F.lit(SUMMARY_SYSTEM_PROMPT))),
        _message("user", *images, _part("text", F.lit(SUMMARY_QUESTION))),
    )
