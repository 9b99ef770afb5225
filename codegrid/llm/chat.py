"""Chat formatting with a loss mask, the template taken as a black box.

A template is a function from a list of (role, text) turns to one string. Nothing of its inside is read: the turns of a conversation are
rendered as growing prefixes, and consecutive outputs are compared. Where the output for k turns starts with that for k - 1, turn k's
span is what was added. Where only a tail behind the last text changed (a closing mark that moves on), the span starts at the first
difference. Where the first difference stands before the end of an earlier turn's text, the template rewrites history: ``rewrites`` names the first turn
that does so, and the conversation has no spans and no loss mask, since no place of its last rendering is known to hold a turn.

Inside a span the text is found by rendering the prefix twice more with two one-letter texts in the turn's place: what both share in front is
the header, what they share behind is the footer. If the real output does not stand between these two, the header or footer depends on the text,
and the conversation is treated like one whose history is rewritten (``rewrites`` is that turn).

Renderings of a conversation take time quadratic in its length, as black-box prefixes must; a conversation is one row of the result, so it has to
fit a task, and only one is held at a time.

Templates escape control strings in roles and texts reversibly: a backslash is doubled, and one is put behind the first character of a control
string, so that none is left in a text. ``read`` parses a formatted string back to its turns, without the spans.

Null roles and texts count as empty strings; other roles than system, user and assistant are written out. Turns are ordered by turn (nulls
last), then role and text, so equal turns have a defined order; repeated rows are turns of their own. Rows with a null conv_id are one
conversation. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# fixed values: the control strings of the bracket template, and of the one with tags
BRACKETS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[END]"]
TAGS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>"]
#: characters of formatted text in one frame of the result
_FRAME = 1 << 22


class Escape:
    """A reversible escape of control strings, none of which holds a backslash or starts inside another."""

    def __init__(self, controls: list[str]) -> None:
        self.find = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)]))

    def put(self, text: str) -> str:
        return self.find.sub(lambda m: m.group() + "\\", text)

    @staticmethod
    def take(text: str) -> str:
        return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text


ESCAPES = {"brackets": Escape(BRACKETS), "tags": Escape(TAGS)}


def brackets(turns: list[Turn]) -> str:
    """<s>, then [SYS] ... [/SYS], [INST] ... [/INST], the plain answer up to </s>, and [ROLE] name [/ROLE] ... [END] for other roles."""
    put, out = ESCAPES["brackets"].put, ["<s>"]
    for role, text in turns:
        if role == "system":
            out.append(f"[SYS] {put(text)} [/SYS]")
        elif role == "user":
            out.append(f"[INST] {put(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {put(text)} </s>")
        else:
            out.append(f"[ROLE] {put(role)} [/ROLE] {put(text)} [END]")
    return "".join(out)


def tags(turns: list[Turn]) -> str:
    """<|im_start|>role<|im_sep|>text<|im_end|> for every turn."""
    put = ESCAPES["tags"].put
    return "".join(f"<|im_start|>{put(role)}<|im_sep|>{put(text)}<|im_end|>" for role, text in turns)


TEMPLATES: dict[str, Template] = {"brackets": brackets, "tags": tags}
_READERS = {
    "brackets": re.compile(r"(?s)\[SYS\] (?P<system>.*?) \[/SYS\]|\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>"
                           r"|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<text>.*?) \[END\]"),
    "tags": re.compile(r"(?s)<\|im_start\|>(?P<role>.*?)<\|im_sep\|>(?P<text>.*?)<\|im_end\|>"),
}


def read(formatted: str, template: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    take, at, out = ESCAPES[template].take, 3 if template == "brackets" else 0, []
    while at < len(formatted):
        m = _READERS[template].match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        found = {k: take(v) for k, v in m.groupdict().items() if v is not None}
        out.append((found["role"], found["text"]) if "role" in found else next(iter(found.items())))
        at = m.end()
    return out


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _frame(render: Template, before: list[Turn], role: str) -> tuple[str, str]:
    """What stands before and behind the text of a turn of this role, whatever the text."""
    a, b = (render([*before, (role, probe)]) for probe in "01")
    head = shared(a, b)
    tail = shared(a[head + 1:][::-1], b[head + 1:][::-1])
    return a[:head], a[len(a) - tail:]


def locate(render: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """(formatted, [(start, end, text start, text end) per turn], None); spans are empty, and the last value is the first turn that
    changed what stood before, if the template rewrites history."""
    now, spans = render([]), []
    for k, (role, _) in enumerate(turns):
        before, now = now, render(turns[:k + 1])
        start = shared(before, now)
        head, tail = _frame(render, turns[:k], role)
        fits = now.startswith(head) and now.endswith(tail) and len(now) >= len(head) + len(tail)
        if not fits or len(head) < start or (spans and start < spans[-1][3]):
            return render(turns), [], k
        if spans and start < spans[-1][1]:
            spans[-1] = (spans[-1][0], start, *spans[-1][2:])
        spans.append((start, len(now), len(head), len(now) - len(tail)))
    return now, spans, None


def _conversations(frames):
    """(conv_id, turns) one after the other, from rows in the order of conversations."""
    held, turns = None, []
    for pdf in frames:
        for key, role, text in zip(pdf["key"], pdf["role"], pdf["text"]):
            if key != held and held is not None:
                yield held, turns
                turns = []
            held = key
            turns.append((role, text))
    if held is not None:
        yield held, turns


def _formatted(template: Template, trained: tuple[str, ...]):
    def run(frames):
        rows, size = [], 0
        for key, turns in _conversations(frames):
            formatted, spans, rewrites = locate(template, turns)
            marked = [{"role": role, "start": a, "end": b, "text_start": c, "text_end": d, "trained": role in trained}
                      for (role, _), (a, b, c, d) in zip(turns, spans)]
            rows.append((key, len(turns), formatted, marked, rewrites))
            size += len(formatted)
            if size > _FRAME:
                yield _frame_of(rows)
                rows, size = [], 0
        if rows:
            yield _frame_of(rows)
    return run


def _frame_of(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "n_turns", "formatted", "spans", "rewrites"])
    return out.assign(rewrites=out["rewrites"].astype("Int32"))


def format_conversations(conversations: DataFrame, template: str | Template = "brackets", *, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, formatted, spans, rewrites) of every conversation of ``conversations`` (conv_id, turn, role, text). ``spans`` tells for each turn
    where it stands in ``formatted``, where its text stands (in code points from 0), and whether its text is under the loss mask. ``template`` is
    a name of ``TEMPLATES`` or a function from turns to a string."""
    render = TEMPLATES[template] if isinstance(template, str) else template
    kind = dict(conversations.dtypes)["conv_id"]
    empty = F.lit("")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), empty).alias("key"), "turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"),
                                F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    # a conversation is one string in the end, so its turns meet in one task, in order; others follow it there one by one
    rows = rows.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_last(), "role", "text").select("key", "role", "text")
    span = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int,trained:boolean>>"
    out = rows.mapInPandas(_formatted(render, trained), f"key string, n_turns long, formatted string, spans {span}, rewrites int")
    return out.select(F.when(F.col("key") != "", F.col("key")).cast(kind).alias("conv_id"), "n_turns", "formatted", "spans", "rewrites")


def _digests(template: str):
    def run(frames):
        take = ESCAPES[template].take
        for pdf in frames:
            out = []
            for formatted, spans in zip(pdf["formatted"], pdf["spans"]):
                turns = read(formatted, template)
                loss = "".join(take(formatted[s["text_start"]:s["text_end"]]) for s in spans if s["trained"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            yield pd.concat([pdf[["conv_id"]].reset_index(drop=True),
                             pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])], axis=1)
    return run


def digests(formatted: DataFrame, template: str = "brackets") -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted strings: turns by the template's
    reader, the text under the loss mask by the spans."""
    kind = dict(formatted.dtypes)["conv_id"]
    rows = formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "spans")
    out = rows.mapInPandas(_digests(template), "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))
