"""Wrapped lines to logical lines by a fold over the text gathered so far (inventory L19).

Whether a line goes on depends on the whole text it would be added to (an open bracket, an open address, how that text
ends), on the line itself, on the one after it and, in paragraph mode, on the distance between the two.  Lines are dealt
by their keys, sorted within tasks and folded as they stream by: a task holds one logical line and one line ahead, and
carries both over the ends of Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How far apart lines of a paragraph may stand, in heights of their type, and words that never end a line
# (articles, prepositions and conjunctions of four languages).
PARAGRAPH_GAP, USUAL_SIZE = 1.6, 10.0
DANGLING = frozenset(
    "a an the of to in on at by for with from and or into onto over each every "
    "le la les un une des du de au aux en dans sur avec pour par et ou chaque "
    "der die das den dem des ein eine einen einem einer eines und oder mit von zu zum zur im am in auf für "
    "el los las un una unos unas del al en con por para y o cada".split()
)
#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = frozenset("m. st. sts. rep. tog. rnd. rnds. approx. ca. bzw. env. rg. rgs. aprox. no. fig. p. pp. etc.".split())
_ENDS = ".!?:…"
_ITEM = re.compile(r"(?:[-*•–]\s|\d+[.)]\s|[A-Za-z][.)]\s)")
_BRACKET = re.compile("[()]")
_KEY_VALUE = re.compile(r"[^\W\d_][^:=]{0,30}\s?[:=](?:\s|$)")


class Line(NamedTuple):
    """One line of the page: its keys, text, height above the foot, type size and weight."""

    key: tuple
    at: int
    text: str
    y: float | None
    size: float | None
    bold: bool


class Gathered:
    """A logical line in the making; how many brackets are open is kept, so a line costs its own length only."""

    def __init__(self, line: Line):
        self.line, self.parts, self.y, self.bold, self.open, self.tail = line, [], line.y, line.bold, 0, ""
        self._take(line.text.strip(), "")

    def _take(self, text: str, glue: str) -> None:
        self.parts += [glue, text] if self.parts else [text]
        for c in _BRACKET.findall(text):
            self.open = self.open + 1 if c == "(" else max(0, self.open - 1) if c == ")" else self.open
        self.tail = (self.tail + (glue if self.tail else "") + text)[-400:]

    def add(self, line: Line, glue: str) -> None:
        self._take(line.text.strip(), glue)
        self.bold, self.y = self.bold or line.bold, line.y if line.y is not None else self.y

    def ends_open_address(self) -> bool:
        if "://" not in self.tail:
            return False
        word = last_word(self.tail)
        return "://" in word and "(" in word.split("://")[0] and ")" not in word


def last_word(text: str) -> str:
    """What stands after the last blank within the text; found from the end, whatever the text is like."""
    return "".join(text.rsplit(None, 1)[-1:])


def begins_anew(text: str) -> bool:
    """Whether a line stands for itself whatever went before: an item, a pair of name and value, a copyright line."""
    head = text.lower()
    return bool(_ITEM.match(text)) or bool(_KEY_VALUE.match(text)) or head.startswith(("©", "(c) ", "copyright"))


def glue(so_far: Gathered, line: Line, following: str | None, paragraphs: bool) -> str | None:
    """What to put between the text so far and a line that goes on with it; None if the line begins a new one."""
    text, before = line.text.strip(), so_far.tail
    if not text or not before:
        return None
    if so_far.ends_open_address() and not any(c.isspace() for c in text):
        return ""
    closes = text.find(")")
    if so_far.open and closes >= 0 and "(" not in text[:closes]:
        return " "  # closes the bracket, so "110) stitches" is no item
    if begins_anew(text):
        return None
    last = last_word(before).lower()
    ended = before[-1] in _ENDS and last not in ABBREVIATIONS
    if not ended:
        if so_far.open and (following is None or not begins_anew(following.strip())):
            return " "
        if text[0].islower() or last.strip("(") in DANGLING or before[-1] in ",;-–(" or (text[0].isdecimal() and text[-1:] == ")" and last[-1].isdecimal()):
            return " "
    elif before[-1] == ":" and so_far.open == 0 and text.startswith("("):
        return " "
    if paragraphs and so_far.y is not None and line.y is not None and 0 < so_far.y - line.y <= PARAGRAPH_GAP * (line.size or USUAL_SIZE):
        return " "
    return None


def fold(lines: Iterator[Line], paragraphs: bool = False) -> Iterator[tuple[Line, str, bool, int]]:
    """(first line, text, bold, lines) of every logical line; lines of one key stand together in reading order."""
    held: Gathered | None = None
    many, line = 0, next(lines, None)
    while line is not None:
        ahead = next(lines, None)
        if held is not None and held.line.key == line.key:
            following = ahead.text if ahead is not None and ahead.key == line.key else None
            between = glue(held, line, following, paragraphs)
            if between is not None:
                held.add(line, between)
                many, line = many + 1, ahead
                continue
        if held is not None:
            yield held.line, "".join(held.parts), held.bold, many
        held, many, line = Gathered(line), 1, ahead
    if held is not None:
        yield held.line, "".join(held.parts), held.bold, many


def reflow_lines(lines: DataFrame, keys: tuple[str, ...] = ("doc", "page"), paragraphs: bool = False, most: int = 2048) -> DataFrame:
    """Logical lines: the keys, line_no (of the first line), text, bold, lines.

    ``lines`` has the keys, ``line_no`` and ``text``, and may have y, size and bold.  Null texts and blank lines are left out.
    """
    extra = {"y": "double", "size": "double", "bold": "boolean"}
    known = [F.col(c).cast(t).alias(c) if c in lines.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()]
    rows = lines.where(F.trim("text") != "").select(*keys, F.col("line_no").cast("long").alias("line_no"), "text", *known)
    schema = ", ".join([*(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys), "line_no long, text string, bold boolean, lines int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def read() -> Iterator[Line]:
            for b in batches:
                kinds[:] = [b.schema.field(k).type for k in keys]
                columns = [b.column(c).to_pylist() for c in (*keys, "line_no", "text", "y", "size", "bold")]
                for row in zip(*columns):
                    yield Line(row[: len(keys)], row[-5], row[-4], row[-3], row[-2], bool(row[-1]))

        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([h[0].key[i] for h in held], t) for i, t in enumerate(kinds)]
            rest = [pa.array([h[0].at for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string()), pa.array([h[2] for h in held], pa.bool_()), pa.array([h[3] for h in held], pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, *rest], names=[*keys, "line_no", "text", "bold", "lines"])

        for logical in fold(read(), paragraphs):
            held.append(logical)
            if len(held) == most:
                yield out()
                held.clear()
        if held:
            yield out()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "line_no").mapInArrow(run, schema)
