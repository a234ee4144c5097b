"""Chat formatting: a finite-state machine over roles and a declarative template.

A template says, per role, what stands before and after a turn's text and
whether the text counts for the loss. The machine reads the roles in order and
says whether they may follow each other; a conversation that breaks the order
is still formatted, and marked. Each turn gives three segments (mark, text,
mark) with a loss flag each; only the text of an assistant turn has it.

Control strings inside a text are escaped: the first character of each is
written as an entity, and an ``&`` that already starts such an entity too, so
that ``unescape`` gives the text back and the marks are the only control
strings in the output. ``read_back`` parses the formatted text alone.

Turns are dealt by conversation, sorted, and streamed: what is held is one
turn and a few numbers, so a conversation of any length fits a task.

Cases: a null text is empty, a null role is the empty role; roles that the
template lacks get a general mark with their (escaped) name; turns with the
same number go by role, then text; null turns come first; rows with a null
conversation form one; an empty table gives no segments; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ship, stored


@dataclass(frozen=True)
class Marks:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role; ``other`` takes the role's name. Each ``before`` starts
    with a control string of its own; ``after`` never holds another mark."""

    roles: tuple[tuple[str, Marks], ...]
    other: Marks
    control: tuple[str, ...]

    def marks(self, role: str) -> Marks:
        found = dict(self.roles).get(role)
        return found or Marks(self.other.before.replace("{role}", escape(role, self)), self.other.after, self.other.loss)


#: Written for this engine in the common instruction style.
INSTRUCTION = Template(
    roles=(("system", Marks("<<SYS>>", "<</SYS>>")), ("user", Marks("[INST] ", " [/INST]")), ("assistant", Marks("<s>", "</s>", True))),
    other=Marks("<|role|>{role}<|text|>", "<|end|>"),
    control=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>"),
)
#: State after a role, from the state before; a pair that is missing breaks the order.
TURNS = {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
#: States in which a conversation may end.
ENDS = {"assistant"}
_PATTERNS: dict[Template, tuple[re.Pattern, re.Pattern]] = {}


def _patterns(template: Template) -> tuple[re.Pattern, re.Pattern]:
    """What to escape (control strings, the start of one at the end of a text,
    an ``&`` before an entity) and the entities."""
    if template not in _PATTERNS:
        whole = sorted(template.control, key=len, reverse=True)
        starts = sorted({c[:i] for c in whole for i in range(1, len(c))}, key=len, reverse=True)
        names = "|".join(sorted({str(ord(c[0])) for c in whole} | {"38"}))
        entity = rf"&#(?:{names});"
        _PATTERNS[template] = (re.compile("|".join([f"(?={'|'.join(map(re.escape, whole))}).", f"(?=(?:{'|'.join(map(re.escape, starts))})\\Z).", f"&(?=#(?:{names});)"]), re.S), re.compile(entity))
    return _PATTERNS[template]


def escape(text: str, template: Template) -> str:
    return _patterns(template)[0].sub(lambda m: f"&#{ord(m[0])};", text)


def unescape(text: str, template: Template) -> str:
    return _patterns(template)[1].sub(lambda m: chr(int(m[0][2:-1])), text)


SEGMENTS = "conv_id long, position long, segment int, text string, loss boolean, state string"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("segment", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("state", pa.string())])


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         template: Template = INSTRUCTION) -> DataFrame:
    """Segments ``(conv_id, position, segment, text, loss, state)``; ``position``
    counts a conversation's turns from 0, ``state`` is the machine's after the
    turn (``broken`` from the first turn that may not follow)."""
    ship(turns.sparkSession)
    picked = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, state, rows = (), 0, "", []
        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if now != (conv,):
                    now, position, state = (conv,), 0, "start"
                state = TURNS.get((state, role), "broken")
                marks = template.marks(role)
                rows += [{"conv_id": conv, "position": position, "segment": i, "text": t, "loss": own, "state": state}
                         for i, (t, own) in enumerate([(marks.before, False), (escape(text, template), marks.loss), (marks.after, False)])]
                position += 1
                if len(rows) >= 3000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SEGMENTS)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SEGMENTS)

    return ordered.mapInArrow(segments, SEGMENTS)


class Reader:
    """Turns out of formatted text that arrives in parts, marks and texts alike."""

    def __init__(self, template: Template):
        self.template = template
        self.roles = [(m.before, role, m.after) for role, m in template.roles]
        self.named, _, self.mid = template.other.before.partition("{role}")
        self.rest = ""

    def turns(self, part: str) -> Iterator[tuple[str, str]]:
        """The turns that end with ``part``."""
        self.rest += part
        while (turn := self._next()) is not None:
            yield turn

    def _next(self) -> tuple[str, str] | None:
        text = self.rest
        for before, role, after in self.roles:
            if text.startswith(before):
                return self._take(role, len(before), after)
        if text.startswith(self.named) and (at := text.find(self.mid, len(self.named))) >= 0:
            return self._take(unescape(text[len(self.named):at], self.template), at + len(self.mid), self.template.other.after)
        return None

    def _take(self, role: str, start: int, after: str) -> tuple[str, str] | None:
        end = self.rest.find(after, start)
        if end < 0:
            return None
        text, self.rest = self.rest[start:end], self.rest[end + len(after):]
        return role, unescape(text, self.template)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """One row per conversation, from its formatted text and loss mask alone:
    counts and digests of the turns that it parses into and of the text under
    the mask, and whether the machine accepted it."""
    ship(segments.sparkSession)
    ordered = segments.select(*SEGMENTS_COLUMNS).repartition("conv_id").sortWithinPartitions("conv_id", "position", "segment")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def row() -> pa.RecordBatch:
            if reader.rest:
                raise ValueError(f"conversation {now[0]}: formatted text that is no turn: {reader.rest[:80]!r}")
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now[0], n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, state in ENDS), schema)], schema=schema)

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
        for batch in batches:
            for conv, text, masked, after in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "state"))):
                if now != (conv,):
                    if now is not None:
                        yield row()
                    now, reader, turns, loss, n, loss_n, chars = (conv,), Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                state, chars = after, chars + len(text)
                if masked:
                    plain = unescape(text, template)
                    loss_n += len(plain)
                    loss.update(plain.encode())
                for role, said in reader.turns(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
        if now is not None:
            yield row()

    return ordered.mapInArrow(digests, DIGESTS)


SEGMENTS_COLUMNS = ("conv_id", "position", "segment", "text", "loss", "state")


def write_and_read_back(turns: DataFrame, template: Template = INSTRUCTION, name: str = "chat") -> DataFrame:
    """Format, write the segments to the shared folder, and read them back."""
    return read_back(stored(format_conversations(turns, template=template), name), template)
