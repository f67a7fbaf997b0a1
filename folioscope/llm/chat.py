"""Chat formatting with spans found by rendering.

A template is a black box: it turns a list of (role, text) turns into one string. Rendering each prefix of a conversation
and comparing it with the prefix before locates each turn's span: what the new output adds. A template whose output for
k turns doesn't begin with its output for k-1 turns rewrites history; that is reported, and the spans are then of the
final rendering as far as they can be told.

Every prefix is rendered, whatever a template declares, until PREFIX_CHARS characters of one conversation have been put out. That is the
square of a conversation's length, and only conversations of very many turns pass it. Past it, a template may declare, by an
attribute `window`, that what a turn adds depends on so many turns at the end only, itself included; the added text is then found by rendering
these turns with and without the newest, and the pieces are compared with one full rendering. If they differ, and for a template that declares
nothing, all prefixes are rendered, whatever it costs.

The template here (`Marked`) writes `<|turn|>role\\ntext<|end|>\\n`. Control strings inside roles and texts, and the escape
character itself, are escaped reversibly, so that no text can end its turn or open another. Formatted output is parsed
back by `Marked.parse`, without the conversation at hand.

Nulls: a null text or role is empty; a null turn sorts first; a null conv_id is a conversation of its own. Equal turn
numbers are ordered by role, then text; repeated rows are turns like others. An empty table gives only conversation -1 of
the query. Only the four columns are read. A conversation is held in memory as a whole (its digest is of one string);
conversations stream through a task one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Turn = tuple[str, str]
#: Strings with which a text could pass for markup, of this template and of common others.
CONTROLS = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
#: Characters of a conversation's prefixes that are rendered before a declared window is used.
PREFIX_CHARS = 1 << 28
#: Turns of up to so many characters whose output is remembered, and how many of them.
SHORT_CHARS, SHORT_TURNS = 1 << 16, 512


@lru_cache(maxsize=16)
def _any_of(strings: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile("|".join(re.escape(c) for c in sorted(strings, key=len, reverse=True)))


@dataclass(frozen=True)
class Marked:
    """Marks turns by control strings. Escapes: the escape character doubled; a control string as the escape character, its
    number's letter and nothing else; a line end in a role likewise."""

    turn: str = "<|turn|>"
    end: str = "<|end|>"
    controls: tuple[str, ...] = CONTROLS
    window: int = 2  # a turn's output depends on the turn alone
    _codes: dict[str, str] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        self._codes.update({c: ESCAPE + chr(ord("a") + k) for k, c in enumerate(dict.fromkeys((self.turn, self.end, *self.controls)))} | {ESCAPE: ESCAPE * 2})

    def escape(self, text: str) -> str:
        """Scans from left to right, the longest control string first."""
        return _any_of(tuple(self._codes)).sub(lambda m: self._codes[m[0]], text)

    def unescape(self, text: str) -> str:
        back = {v: k for k, v in self._codes.items()} | {ESCAPE + "N": "\n"}
        return re.sub(re.escape(ESCAPE) + ".", lambda m: back[m[0]], text, flags=re.DOTALL)

    def one(self, turn: Turn) -> str:
        """The output of a turn."""
        role, text = turn
        return f"{self.turn}{self.escape(role).replace(chr(10), ESCAPE + 'N')}\n{self.escape(text)}{self.end}\n"

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(_remembered(self, t) if len(t[1]) <= SHORT_CHARS and len(t[0]) <= SHORT_CHARS else self.one(t) for t in turns)

    def parse(self, output: str) -> list[tuple[str, int, int]]:
        """(role, start, end) of each turn: where its escaped text lies in the output."""
        found, at = [], 0
        while at < len(output):
            if not output.startswith(self.turn, at):
                raise ValueError(f"no turn at {at}")
            line = output.index("\n", at)
            end = output.index(self.end, line)
            found.append((self.unescape(output[at + len(self.turn) : line]), line + 1, end))
            at = end + len(self.end) + 1
        return found


@lru_cache(maxsize=SHORT_TURNS)
def _remembered(template: Marked, turn: Turn) -> str:
    """A turn's output, which the prefixes of a conversation repeat."""
    return template.one(turn)


@dataclass(frozen=True)
class Rendered:
    text: str
    spans: list[tuple[int, int]]  # of each turn, in order
    rewrites: bool  # a prefix's output isn't how the next begins


def render(template: Callable[[list[Turn]], str], turns: list[Turn], chars: int = PREFIX_CHARS) -> Rendered:
    """The whole output and each turn's span, by comparing the outputs of successive prefixes."""
    window = getattr(template, "window", None)
    before, spans, rewrites, done = template([]), [], False, 0
    for k in range(1, len(turns) + 1):
        if window is not None and done > chars and not rewrites and k > window:
            rest = _by_window(template, turns, k - 1, before, spans, window)
            if rest:
                return rest
            window = None
        now = template(turns[:k])
        done += len(now)
        start = len(before)
        if not now.startswith(before):
            rewrites = True
            start = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
            spans = [(min(a, start), min(b, start)) for a, b in spans]
        spans.append((start, len(now)))
        before = now
    return Rendered(before, spans, rewrites)


def _by_window(template: Callable[[list[Turn]], str], turns: list[Turn], known: int, before: str, spans: list[tuple[int, int]], window: int) -> Rendered | None:
    """The turns from number `known` on, by what each adds to the few before it; None if that isn't what the template makes of them all.
    before, spans: the output of the turns before, and where they are in it."""
    parts, spans, at = [before], list(spans), len(before)
    for k in range(known, len(turns)):
        recent = turns[k - window + 1 : k + 1]
        without, now = template(recent[:-1]), template(recent)
        if not now.startswith(without):
            return None
        parts.append(now[len(without) :])
        spans.append((at, at + len(parts[-1])))
        at = spans[-1][1]
    whole = "".join(parts)
    return Rendered(whole, spans, False) if whole == template(turns) else None


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Whole conversations, one after the other, from sorted batches."""
    rows = (r for b in batches for lo in range(0, b.num_rows, 1024) for r in zip(*(b.column(c).slice(lo, 1024).to_pylist() for c in ("conv_id", "role", "text"))))
    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, [(role or "", text or "") for _, role, text in own]


def _format(template: Callable[[list[Turn]], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "formatted", "starts", "ends", "rewrites"])
            rows.clear()
            return out

        for conv, turns in _conversations(batches):
            got = render(template, turns)
            rows.append((conv, got.text, [a for a, _ in got.spans], [b for _, b in got.spans], got.rewrites))
            size += len(got.text)
            if size > 4_000_000:
                yield flush()
                size = 0
        yield flush()

    return run


def format_chats(conversations: DataFrame, template: Callable[[list[Turn]], str] | None = None) -> DataFrame:
    """conv_id, formatted, starts and ends (code points) of each turn's span, rewrites."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return rows.mapInArrow(_format(template or Marked()), "conv_id long, formatted string, starts array<long>, ends array<long>, rewrites boolean")


def _digest(template: Marked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())]
        for batch in batches:
            rows = []
            for conv, text, starts, ends, rewrites in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "starts", "ends", "rewrites"))):
                if [0, *ends] != [*starts, len(text)]:
                    raise ValueError("spans don't cover the output")
                turns, loss, loss_chars = hashlib.sha256(), hashlib.sha256(), 0
                for a, b in zip(starts, ends):  # each span is a turn by itself
                    ((role, start, end),) = template.parse(text[a:b])
                    own = template.unescape(text[a + start : a + end])
                    turns.update(f"{role}\n{own}\n".encode())
                    if role == "assistant":
                        loss.update(own.encode())
                        loss_chars += len(own)
                rows.append((conv, len(ends), turns.hexdigest(), loss_chars, loss.hexdigest(), len(text), rewrites))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * 7, kinds)], [n for n, _ in kinds])

    return run


def digests(formatted: DataFrame, template: Marked | None = None) -> DataFrame:
    """What the formatted output says when each turn's span is parsed: numbers of turns and characters, and digests of all turns and of the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"
    return formatted.select("conv_id", "formatted", "starts", "ends", "rewrites").mapInArrow(_digest(template or Marked()), schema)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(format_chats(rows.unionByName(extra)))
