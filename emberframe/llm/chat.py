"""Chat formatting: a state machine over roles, a declarative template, and text segments with loss flags.

A conversation's output is the concatenation of its turns' segments, by place. Each turn is an opening
marker, the escaped text and a closing marker. Control strings inside texts are broken by an escape sign, so
a marker in the output is always a marker, and reading back gives the texts as they were.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberframe.operators import ordered


@dataclass(frozen=True)
class Role:
    """after: states in which the role may speak, "" being the start; loss: whether its text is learned."""

    after: tuple[str, ...]
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers, roles and control strings of a chat format.

    ``opening`` and ``closing`` begin and end a turn; the role stands between ``opening`` and ``named``. Each
    control string has two signs or more, its first sign occurs in no control string again, and the escape
    sign occurs in none; then a control string in the output can only be where the template put it.
    """

    opening: str
    named: str
    closing: str
    roles: dict[str, Role] = field(hash=False)
    controls: tuple[str, ...] = ()
    escape: str = "\x1b"

    def __post_init__(self):
        marks = self.marks
        firsts = {m[:1] for m in marks}
        if any(len(m) < 2 or self.escape in m or firsts & set(m[1:]) for m in marks):
            raise ValueError("a control string is too short, holds the escape sign or repeats a first sign")
        if len(self.named) != 1 or len(self.escape) != 1 or self.named == self.escape:
            raise ValueError("the role ends with one sign other than the escape sign")

    @property
    def marks(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.opening, self.closing, *self.controls)))

    def escaped(self, text: Column) -> Column:
        """The escape sign becomes escape 0; escape 1 goes in after the first sign of each control string."""
        any_mark = "|".join(re.escape(m) for m in self.marks)
        doubled = F.replace(text, F.lit(self.escape), F.lit(f"{self.escape}0"))
        return F.regexp_replace(doubled, f"(?s)(?=(?:{any_mark}))(.)", f"$1{self.escape}1")

    def escaped_role(self, role: Column) -> Column:
        return F.replace(self.escaped(role), F.lit(self.named), F.lit(f"{self.escape}2"))

    def plain(self, text: str) -> str:
        if self.escape not in text:
            return text
        return text.replace(f"{self.escape}1", "").replace(f"{self.escape}2", self.named).replace(f"{self.escape}0", self.escape)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of formatted text, found by the markers alone."""
        at = 0
        while at < len(formatted):
            if not formatted.startswith(self.opening, at):
                raise ValueError(f"no turn begins at {at}")
            name = formatted.index(self.named, at + len(self.opening))
            end = formatted.index(self.closing, name + 1)
            yield self.plain(formatted[at + len(self.opening) : name]), self.plain(formatted[name + 1 : end])
            at = end + len(self.closing)


#: Turns between im_start and im_end; control strings of other common formats are broken in texts as well.
CHAT = Template(
    opening="<|im_start|>",
    named="\n",
    closing="<|im_end|>",
    roles={
        "system": Role(after=("",)),
        "user": Role(after=("", "system", "assistant")),
        "assistant": Role(after=("user",), loss=True),
    },
    controls=("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]"),
)


def format_turns(conversations: DataFrame, template: Template) -> DataFrame:
    """(conv_id, place, role, segments, refused): one row a turn, whose segments joined are its formatted text.

    conversations has conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, ties
    by role and text, null turns first; place counts them from 1. segments are (text, loss): marker, escaped
    text, marker; under loss is the whole text of a role that is learned and nothing else. A null text or role
    is empty. The state of the machine is the role that spoke last; refused says that the role is unknown or
    may not speak in that state. Refused turns are formatted all the same. A null conv_id is a conversation;
    repeated rows are turns; an empty table gives an empty result.

    A turn needs only the role before it, so a conversation with most of all turns is cut by ``ordered.scan``.
    """
    rows = conversations.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.col("turn").isNotNull().alias("_known"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    series = ordered.Series(("conv_id",), ("turn", "_known", "role", "text"))
    placed = ordered.scan(rows, series, {"place": ordered.row_index(), "_before": ordered.previous(F.col("role"))})
    allowed, loss = F.lit(False), F.lit(False)
    for name, role in template.roles.items():
        first = F.lit("" in role.after)
        spoke = F.col("_before").isin([x for x in role.after if x])
        allowed = allowed | ((F.col("role") == name) & F.when(F.col("_before").isNull(), first).otherwise(spoke))
        if role.loss:
            loss = loss | (F.col("role") == name)
    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    opening = F.concat(F.lit(template.opening), template.escaped_role(F.col("role")), F.lit(template.named))
    segments = F.array(
        segment(opening, F.lit(False)), segment(template.escaped(F.col("text")), loss), segment(F.lit(template.closing), F.lit(False))
    )
    return placed.select("conv_id", "place", "role", segments.alias("segments"), (~allowed).alias("refused"))


class _Reading:
    """What has been read of one conversation: counts and running digests, no texts."""

    def __init__(self):
        self.turns, self.loss_chars, self.chars, self.refused_at = 0, 0, 0, None
        self.texts, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, template: Template, segments: list[dict], refused: bool) -> None:
        formatted = "".join(s["text"] for s in segments)
        self.chars += len(formatted)
        for role, text in template.turns(formatted):
            self.turns += 1
            self.texts.update(f"{role}\n{text}\n".encode())
        for s in segments:
            if s["loss"]:
                text = template.plain(s["text"])
                self.loss_chars += len(text)
                self.learned.update(text.encode())
        if refused and self.refused_at is None:
            self.refused_at = self.turns

    def row(self) -> tuple:
        return (self.turns, self.texts.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.refused_at)


_READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, refused_at long"


def _reader(template: Template, kind: pa.DataType) -> Callable:
    names = ["conv_id", *(x.split()[0] for x in _READ.split(", "))]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        own, now = None, None
        for batch in batches:
            done = []
            for conv_id, segments, refused in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != own:
                    if now is not None:
                        done.append((own, *now.row()))
                    own, now = conv_id, _Reading()
                now.add(template, segments, refused)
            if done:
                yield packed(done)
        if now is not None:
            yield packed([(own, *now.row())])

    return read


def read_back(formatted: DataFrame, template: Template) -> DataFrame:
    """One row a conversation of what ``format_turns`` wrote, parsed from the formatted text and its loss flags.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline a turn), loss_chars and loss_sha256 (of all
    text under loss, unescaped), formatted_chars, refused_at (number of the first refused turn, else null).
    Conversations stream through their task by place; only counts and digests are held.
    """
    field_type = formatted.schema["conv_id"].dataType
    streamed = formatted.select("conv_id", "place", "segments", "refused").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return streamed.drop("place").mapInArrow(_reader(template, to_arrow_type(field_type)), f"conv_id {field_type.simpleString()}, {_READ}")
