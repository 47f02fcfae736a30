"""Fill-in-the-middle transformation with a streaming matcher that goes over each text twice.

The first pass counts a text's units, which are the matches of a pattern over its UTF-8 bytes from left to right. The two cut ranks
are drawn from a hash of the document's id. The second pass is a lazy iterator over the same matches that is advanced to the smaller
rank and then to the larger one; the ends of those two matches are the cuts. No list of units is ever held, so that a text costs no
memory beside itself, however long it is. What follows the last unit belongs to the suffix.

A NULL or empty text has no units and stays plain. A NULL id is hashed as the empty text. A text that holds a marker stays plain, so
a marker in an output that is not plain always separates its parts, and `restored` gives back the text exactly. Repeated rows get
equal results; only the two named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import batch, id_type, mapped, narrowed

#: Units: code points, words with the white space before them, lines with their ends.
UNITS = {"char": rb"(?s:.)[\x80-\xBF]*", "word": rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "line": rb"[^\n]*\n|[^\n]+"}
#: Units that the matcher takes in one step.
STRETCH = 64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(id_: object) -> tuple[int, ...]:
    """Four whole numbers of 32 bits from a document's id."""
    digest = hashlib.sha256(b"1:" + (b"" if id_ is None else str(id_).encode())).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def matches(pattern: re.Pattern, text: bytes, at: int) -> Iterator[int]:
    """Ends of matches that follow each other from `at`; never looks for one further on, so a text is read once."""
    while found := pattern.match(text, at):
        at = found.end()
        yield at


class Matcher:
    """A lazy iterator over a text's units, which are taken STRETCH at a time while so many are left to go."""

    def __init__(self, unit: bytes) -> None:
        self.one = re.compile(unit)
        self.stretch = re.compile(rb"(?:(?>%b)){%d}" % (unit, STRETCH))

    def count(self, text: bytes) -> int:
        """First pass: matches are counted as they come."""
        n = end = 0
        for pattern, units in ((self.stretch, STRETCH), (self.one, 1)):
            for end in matches(pattern, text, end):
                n += units
        return n

    def after(self, text: bytes, start: int, units: int) -> int:
        """Second pass: the byte position after so many more units from `start`."""
        for pattern, steps in ((self.stretch, units // STRETCH), (self.one, units % STRETCH)):
            if steps:
                start = next(islice(matches(pattern, text, start), steps - 1, None))
        return start


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", plain: int = 10, spm: int = 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_units, middle_units (NULL if plain), output.

    unit: a name of UNITS or a pattern over UTF-8 bytes that never matches nothing; units follow each other from the start. plain: texts in a hundred that stay as they are; spm: of the others, those in
    a hundred whose suffix comes first.
    """
    pattern = UNITS[unit] if unit in UNITS else unit.encode("latin-1")
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    schema = "doc_id long,n long,form string,prefix_units long,middle_units long,output string"

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        matcher = Matcher(pattern)
        columns: list[list] = [[] for _ in range(5)]
        ids = part.column("doc_id")
        for id_, text in zip(ids.to_pylist(), (x.as_buffer() for x in part.column("text")), strict=True):
            text = text.to_pybytes()
            n = matcher.count(text)
            h1, h2, h3, h4 = draws(id_)
            form = "plain" if not text or h3 % 100 >= 100 - plain or any(m in text for m in marks) else "spm" if h4 % 100 < spm else "psm"
            row = (n, form, None, None, text)
            if form != "plain":
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                a = matcher.after(text, 0, low)
                b = matcher.after(text, a, high - low)
                p, s, m = marks
                head, tail = (p, text[:a]), (s, text[b:])
                row = (n, form, low, high - low, b"".join((*(head + tail if form == "psm" else tail + head), m, text[a:b])))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        columns[4] = pa.array(columns[4], pa.binary()).cast(pa.string(), safe=False)
        return batch(schema, columns, ids)

    return mapped(narrowed(docs, id_col, text_col), kernel, schema.replace("doc_id long", f"doc_id {id_type(docs, id_col)}"))


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone; each marker stands once in an output that is not plain."""
    part = lambda text, mark, k: F.split_part(text, F.lit(mark), F.lit(k))
    middle = part(output, MIDDLE, 2)
    psm = F.concat(part(part(output, SUFFIX, 1), PREFIX, 2), middle, part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), middle, part(part(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
