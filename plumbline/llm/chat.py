"""Chat formatting that survives a round trip through its grammar.

A turn is an opening mark, a blank, the text, a blank and a closing mark. A
deterministic parser reads rendered text back; where a text contains what the
parser takes for a mark, the recovered turn differs from the source, and the
conflicting strings get one more backslash, until both are identical. Blanks
keep a text from running into the marks around it.

    <s>[INST] a question [/INST][BOT] an answer </s>

Turns are rendered and checked one by one, in any number of tasks. Whatever
needs a conversation in order streams its sorted turns, one at a time, so a very
long conversation costs time in one task but no memory; a digest of a whole
conversation allows nothing else.

Defined results: a null text is empty; a null role is an empty role; any other
role has a general pair of marks; turns are ordered by turn, role, text, nulls
first; repeated rows are repeated turns; rows without a conversation id form one
conversation; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import mapped
from plumbline.session import ship

ship(__name__)

BEGIN = "<s>"
#: Opening and closing mark of each role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[BOT]", "</s>")}
#: Opening mark of any other role, with the role's name in percent encoding.
OTHER = ("[ROLE=", "]", "[/ROLE]")
#: A mark after any number of backslashes, all of them; only without one it is a mark.
CONTROL = r"(?<!\\)(\\*)(<s>|</s>|\[INST\]|\[/INST\]|\[BOT\]|<<SYS>>|<</SYS>>|\[ROLE=[A-Za-z0-9_.~%-]*\]|\[/ROLE\])"
LOSS_ROLE = "assistant"

_CONTROL = re.compile(CONTROL)
_ROLE_OF = {opening: role for role, (opening, _) in MARKS.items()}


class Unparsable(ValueError):
    """The text does not follow the grammar."""


def marks_of(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (OTHER[0] + quote(role, safe="") + OTHER[1], OTHER[2])


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns (role, text) of rendered text, without its begin mark."""
    turns: list[tuple[str, str]] = []
    role, closing, parts, at = None, "", [], 0
    for found in _CONTROL.finditer(rendered):
        between, slashes, mark = rendered[at:found.start()], found[1], found[2]
        at = found.end()
        if role is None:
            if between or slashes:
                raise Unparsable("text outside of turns")
            role = _ROLE_OF.get(mark)
            if role is None:
                if not mark.startswith(OTHER[0]):
                    raise Unparsable(f"{mark} opens no turn")
                role = unquote(mark[len(OTHER[0]):-1])
            closing, parts = marks_of(role)[1], []
        elif slashes:
            parts += [between, slashes[1:], mark]
        elif mark == closing:
            text = "".join([*parts, between])
            if len(text) < 2 or text[0] != " " or text[-1] != " ":
                raise Unparsable("marks without blanks")
            turns.append((role, text[1:-1]))
            role = None
        else:
            raise Unparsable(f"{mark} inside a turn")
    if role is not None or at < len(rendered):
        raise Unparsable("text after the last turn")
    return turns


def render(role: str, text: str) -> str:
    """The rendered turn that parses back to exactly this turn."""
    opening, closing = marks_of(role)
    body = text
    while True:
        rendered = f"{opening} {body} {closing}"
        try:
            if parse(rendered) == [(role, text)]:
                return rendered
        except Unparsable:
            pass
        if body != text:
            raise Unparsable("escaping doesn't restore the turn")
        body = escape(text)


def formatted(turns: DataFrame) -> DataFrame:
    """Every turn with its `rendered` text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = ([v or "" for v in c.to_pylist()] for c in batch.columns[2:4])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(roles, pa.string()), pa.array([render(r, t) for r, t in zip(roles, texts)], pa.string())], names=["conv_id", "turn", "role", "rendered"])

    wanted = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return mapped(wanted, run, "conv_id long, turn long, role string, rendered string")


def _in_order(rendered: DataFrame) -> DataFrame:
    return rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")


def pieces(turns: DataFrame) -> DataFrame:
    """Every turn with its place in the formatted conversation: `start`, `end`
    and, for a turn under the loss mask, the span of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, begun = None, 0, False
        for batch in batches:
            rows = []
            for conv, turn, role, rendered in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != last:
                    last, at, begun, rendered = conv, 0, True, BEGIN + rendered
                    skip = len(BEGIN)
                else:
                    skip = 0
                opening, closing = marks_of(role)
                inside = (at + skip + len(opening) + 1, at + len(rendered) - len(closing) - 1) if role == LOSS_ROLE else (None, None)
                rows.append((conv, turn, role, rendered, at, at + len(rendered), *inside))
                at += len(rendered)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "turn", "role", "rendered", "start", "end", "loss_start", "loss_end"])

    return mapped(_in_order(formatted(turns)), run, "conv_id long, turn long, role string, rendered string, start long, end long, loss_start long, loss_end long")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation what the parser reads back from the formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun = None, False
        n = chars = loss_chars = 0
        turns_sha = loss_sha = None

        def row():
            return last, n, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars

        for batch in batches:
            rows = []
            for conv, rendered in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if not begun or conv != last:
                    if begun:
                        rows.append(row())
                    last, begun, n, chars, loss_chars = conv, True, 0, len(BEGIN), 0
                    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                chars += len(rendered)
                for role, text in parse(rendered):
                    n += 1
                    turns_sha.update(f"{role}\n{text}\n".encode())
                    if role == LOSS_ROLE:
                        loss_chars += len(text)
                        loss_sha.update(text.encode())
            if rows:
                yield _digest_batch(rows)
        if begun:
            yield _digest_batch([row()])

    return mapped(_in_order(formatted(turns)), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
