"""Size vectors: values for several sizes written side by side in a line (inventory L20, L21).

A line is cut into numbers, blanks and single characters; five families are then read from these tokens:

* ``list``: values and groups between commas, one group at least: ``6, [10, 14], 20``;
* ``group``: round groups of values after commas or semicolons, or square ones after colons, with values before and
  behind: ``80 (90, 100) 110``, ``4 [6:8:10]``;
* ``dashed``: the same with a dash in a group for a size that has no value: ``3 (-, 4, 5)``;
* ``slash``: three values or more between slashes: ``80/90/100``;
* ``dash``: three or more between dashes: ``80-90-100``, groups in between too.

Families take their places in that order; a later one yields where an earlier one stands, but a dashed one takes the place
of vectors that lie within it.  A number right before a comma and two digits without a blank is a decimal, and ``4 - 6``
outside of dashes is one value, a range.  A factor (``x 4 (5)``) and a colour code behind a colour's name are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
DASHES, TIMES, MOST_IN_A_ROW = "-–—", "x×*", 24
COLOUR_WORDS = ("color", "colors", "colour", "colours", "couleur", "couleurs", "coloris", "farbe", "farben", "farve", "farver", "farge", "farger", "kleur", "kleuren", "kolor", "kolory")
FAMILIES = ("list", "group", "dashed", "slash", "dash")


class Vector(NamedTuple):
    start: int
    end: int
    family: str
    values: list[str]


class _Token(NamedTuple):
    text: str
    start: int
    number: bool


def _cut(line: str) -> list[_Token]:
    return [_Token(m[0], m.start(), m[0][0].isdecimal()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+)?|\s+|.", line, re.DOTALL)]


class _Reader:
    """Reads parts of a vector from token ``i`` on; each part gives the token behind it, or None."""

    def __init__(self, line: str):
        self.line, self.tokens = line, _cut(line)

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def number(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].number

    def skip(self, i: int) -> int:
        return i + 1 if self.at(i).isspace() else i

    def start(self, i: int) -> int:
        return self.tokens[i].start if i < len(self.tokens) else len(self.line)

    def simple(self, i: int) -> int | None:
        """A number, with a decimal comma."""
        if not self.number(i):
            return None
        return i + 3 if self.at(i + 1) == "," and self.number(i + 2) and "." not in self.at(i) + self.at(i + 2) else i + 1

    def value(self, i: int) -> int | None:
        """A number or a range of two."""
        end = self.simple(i)
        if end is None:
            return None
        dash = self.skip(end)
        other = self.simple(self.skip(dash + 1)) if self.at(dash) == "-" else None
        return other or end

    def blank(self, i: int, inside: bool) -> int | None:
        """A dash for no value: no part of a word or a range."""
        if self.at(i) not in DASHES or not self.at(i):
            return None
        before = self.at(i - 2) if self.at(i - 1).isspace() else self.at(i - 1)
        after = self.at(self.skip(i + 1))
        joined = self.at(i - 1)[-1:].isalnum() or before[-1:].isdecimal() or after[:1].isdecimal()
        return None if joined or (not inside and self.at(i) != "-" and after[:1].isalpha()) else i + 1

    def item(self, i: int, dashed: bool, inside: bool) -> int | None:
        return self.value(i) or (self.blank(i, inside) if dashed else None)

    def group(self, i: int, marks: str, between: str, least: int, read, out: list[str]) -> int | None:
        """Items of ``read`` between the two ``marks``, separated by one of ``between``."""
        if self.at(i) != marks[0]:
            return None
        found, i = [], self.skip(i + 1)
        while True:
            end = read(i)
            if end is None:
                return None
            found.append(self.said(i, end))
            i = self.skip(end)
            if self.at(i) == marks[1] and len(found) >= least:
                out += found
                return i + 1
            if not self.at(i) or self.at(i) not in between:
                return None
            i = self.skip(i + 1)

    def row(self, i: int, read, commas: bool, out: list[str]) -> int:
        """Items side by side, blanks or (with ``commas``) commas and blanks between; as far as they go."""
        end = i
        for _ in range(MOST_IN_A_ROW + 1):
            there = read(i)
            if there is None:
                break
            out.append(self.said(i, there))
            end, i = there, self.skip(there)
            if commas and self.at(i) == "," and self.at(i + 1).isspace():
                i += 2
            elif i == there:
                break
        return end

    def said(self, i: int, end: int) -> str:
        return "".join(t.text for t in self.tokens[i:end] if not t.text.isspace())

    # families: the token behind a vector that begins at i, and its values

    def groups(self, i: int, dashed: bool = False) -> tuple[int, list[str]] | None:
        values: list[str] = []
        inner, outer = (lambda j: self.item(j, dashed, True)), (lambda j: self.item(j, dashed, False))
        end = self.row(i, outer, False, values) if outer(i) else i
        closed, holes = None, False
        while True:
            begin, own = self.skip(end), []
            here = self.group(begin, "()", ",;", 1, inner, own)
            if here is None and not dashed:
                here = self.group(begin, "[]", ":", 2, self.value, own)
            if here is None:
                break
            # a hole counts where a separator stands next to it on both sides
            holes = holes or (len(own) > 1 and any(v in DASHES for v in own))
            values += own
            closed = here
            tail = self.skip(here)
            end = self.row(tail, outer, True, values) if outer(tail) else here
            closed = max(closed, end)
        if closed is None or (dashed and not (holes and any(v[0].isdecimal() for v in values))):
            return None
        return closed, values

    def comma_list(self, i: int) -> tuple[int, list[str]] | None:
        if not self.number(i) or self.at(i - 1) in ("(", "[", ".", ","):
            return None
        values, end, grouped = [self.at(i)], i + 1, False
        one = lambda j: j + 1 if self.number(j) else None
        while self.at(comma := self.skip(end)) == ",":
            step, own = self.skip(comma + 1), []
            here = self.group(step, "()", ",", 1, one, own) or self.group(step, "[]", ",", 1, one, own)
            grouped = grouped or here is not None
            if here is None:
                here, own = one(step), [self.at(step)]
            if here is None:
                break
            values, end = values + own, here
        return (end, values) if grouped else None

    def between(self, i: int, mark: str, read) -> tuple[int, list[str]] | None:
        """Three items or more with ``mark`` between."""
        if self.at(i - 1) in (mark, ".", ",") and (self.at(i - 1) == mark or self.number(i - 2)):
            return None
        values, end = [], i
        while (there := read(end)) is not None:
            values.append(self.said(end, there))
            last, mark_at = there, self.skip(there)
            if self.at(mark_at) != mark:
                break
            end = self.skip(mark_at + 1)
        else:
            return None
        if len(values) < 3 or self.at(last) == mark:
            return None
        if mark == "-":  # groups in between
            while self.at(g := self.skip(last)) == "(":
                own: list[str] = []
                close = self.group(g, "()", "-", 2, self.simple, own)
                rest = self._dashes(self.skip(close)) if close else None
                if rest is None:
                    break
                values, last = values + own + rest[1], rest[0]
        return last, values

    def _dashes(self, i: int) -> tuple[int, list[str]] | None:
        values: list[str] = []
        while (there := self.simple(i)) is not None:
            values.append(self.said(i, there))
            mark = self.skip(there)
            if self.at(mark) != "-":
                return (there, values) if len(values) > 1 else None
            i = self.skip(mark + 1)
        return None

    def every(self, family: str) -> Iterator[Vector]:
        """Vectors of one family, leftmost first, none within another."""
        read = {
            "list": self.comma_list, "group": self.groups, "dashed": lambda i: self.groups(i, True),
            "slash": lambda i: self.between(i, "/", self.value), "dash": lambda i: self.between(i, "-", self.simple),
        }[family]
        i = 0
        while i < len(self.tokens):
            got = read(i) if self.tokens[i].number or self.tokens[i].text in "([" + DASHES else None
            if got:
                yield Vector(self.start(i), self.tokens[got[0] - 1].start + len(self.tokens[got[0] - 1].text), family, got[1])
                i = got[0]
            else:
                i += 1


def _is_factor(before: str) -> bool:
    head = before.rstrip()
    return head[-1:] in TIMES and bool(head) and not head[-2:-1].isalpha()


def _is_colour(before: str, v: Vector) -> bool:
    words = re.findall(r"\w+", before.rstrip())
    return len(v.values) == 2 and len(v.values[1]) == 3 and v.values[1].isdecimal() and v.values[0].isdecimal() and bool(words) and before.rstrip().endswith(words[-1]) and words[-1].lower() in COLOUR_WORDS


def find_vectors(line: str) -> list[Vector]:
    """All vectors of a line, left to right."""
    if not any(c.isdecimal() for c in line):
        return []
    reader, taken = _Reader(line), []
    for family in FAMILIES:
        for v in reader.every(family):
            before = line[: v.start]
            if len(v.values) < (3 if family in ("slash", "dash") else 2) or family in ("group", "dashed") and (_is_factor(before) or _is_colour(before, v)):
                continue
            met = [t for t in taken if v.start < t.end and v.end > t.start]
            if met and (family != "dashed" or any(t.start < v.start or t.end > v.end for t in met)):
                continue
            taken = [t for t in taken if t not in met] + [v]
    return sorted(taken)


def with_placeholders(line: str, sizes: int) -> tuple[str, list[list[str]]]:
    """The line with {{0}}, {{1}}, ... in place of its vectors of ``sizes`` values, and these."""
    held = [v for v in find_vectors(line) if len(v.values) == sizes] if sizes > 1 else []
    out, last = [], 0
    for i, v in enumerate(held):
        out += [line[last : v.start], f"{{{{{i}}}}}"]
        last = v.end
    return "".join([*out, line[last:]]), [v.values for v in held]


def _sizes_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("values", pa.list_(pa.string()))]))
    for b in batches:
        found = [[v._asdict() for v in find_vectors(t or "")] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "vectors"])


def size_vectors(lines: DataFrame) -> DataFrame:
    """Lines with ``vectors``: start, end (code points, end exclusive), family and values of each (L20).  Lines without a digit
    stay on the JVM's side."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in lines.dtypes)}, vectors array<struct<start:int,end:int,family:string,values:array<string>>>"
    digits = F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False))
    none = F.array().cast("array<struct<start:int,end:int,family:string,values:array<string>>>")
    return lines.where(digits).mapInArrow(_sizes_arrow, schema).unionByName(lines.where(~digits).withColumn("vectors", none))


def placeholder_lines(lines: DataFrame, sizes: str = "sizes") -> DataFrame:
    """Lines with ``t`` and ``c``: the text with placeholders for vectors of as many values as ``sizes`` says, and the values."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in lines.dtypes)}, t string, c array<array<string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [with_placeholders(t or "", n or 0) for t, n in zip(b.column("text").to_pylist(), b.column(sizes).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.list_(pa.string())))], names=[*b.schema.names, "t", "c"])

    return lines.mapInArrow(run, schema)
