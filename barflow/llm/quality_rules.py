"""Quality rules as a short-circuit cascade.

Each rule is a cheap predicate that rejects a document. On a bounded sample every rule is timed and its rejections are
counted; the rules are then ordered by rejections per second, and on the whole table a document meets them in that order
until the first one rejects it. The verdict is that of all rules together, so it does not depend on the order; only the
work does.

Words are `[^\\x20\\x09-\\x0D]+`. A NULL or blank text has no words, all counts 0, and fails the base rule (n_words < 20).
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import batch, id_type, mapped, narrowed, slices, space_words, trim, word_hashes

#: Rows of the sample on which rules are timed, at most; it decides the order of work and never a result.
SAMPLE_ROWS = 400
#: Text bytes of a sampled row, at most.
SAMPLE_BYTES = 65_536
#: Words in a window of the repetition count.
WINDOW = 8
#: Symbols that are counted (fixed values).
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_ASCII = bytes(range(128))
#: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han and their punctuation and full-width forms.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]")
_COEFF = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(64)], dtype=np.uint64)


class Doc:
    """A text with what rules ask of it; each is computed when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return space_words(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        inner = self.text.translate(None, _SPACE)
        return len(inner.decode("utf-8", "replace")) if not inner.isascii() else len(inner)

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @cached_property
    def wide(self) -> str:
        """The characters beyond ASCII."""
        return "" if self.text.isascii() else self.text.translate(None, _ASCII).decode("utf-8", "replace")

    @cached_property
    def letters(self) -> tuple[int, int]:
        """Letters of any script, and those of them that are capital."""
        upper = len(self.text) - len(self.text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        lower = len(self.text) - len(self.text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
        return upper + lower + sum(map(str.isalpha, self.wide)), upper + sum(map(str.isupper, self.wide))

    @cached_property
    def unspaced(self) -> bool:
        """Whether most characters that are no white space belong to a script without spaces between words."""
        return 2 * len(self.wide) > self.word_chars and 2 * len(_UNSPACED.findall(self.wide)) > self.word_chars


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found at two or more places of the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))
    key = np.zeros(n, np.uint64)
    for j in range(window):
        key += ids[j : j + n] * _COEFF[j]
    ordered = np.sort(key)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    # equal windows have equal keys; the few windows with a repeated key are compared word by word
    suspects = np.flatnonzero(np.isin(key, ordered[1:][same]))
    places: dict[tuple, list[int]] = {}
    for i in suspects.tolist():
        places.setdefault(tuple(words[i : i + window]), []).append(i)
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for at in places.values() if len(at) > 1 for i in at], np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


#: The base rules: too short, or too repetitive.
BASE = (
    Rule("few_words", lambda d: d.n_words < 20),
    Rule("repetitive", lambda d: 100 * d.n_repeat_words > 30 * d.n_words),
)
#: Further rules; each threshold leaves ordinary prose of any language far away.
MORE = (
    Rule("symbols", lambda d: 100 * d.n_symbols > 10 * d.word_chars),
    Rule("duplicate_lines", lambda d: d.n_dup_lines >= 3 and 100 * d.n_dup_lines > 30 * len(d.lines)),
    Rule("capitals", lambda d: d.letters[0] >= 40 and 100 * d.letters[1] > 50 * d.letters[0]),
    Rule("shouted_ends", lambda d: 100 * d.text.count(b"!!") > 30 * d.n_words),
    Rule("word_length", lambda d: d.word_chars < 2 * d.n_words or (d.word_chars > 20 * d.n_words and not d.unspaced)),
)
RULES = BASE + MORE


@dataclass(frozen=True)
class Estimate:
    rule: str
    seconds: float
    rejected: int
    seen: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and rejections of each rule from a bounded sample, in the order of work.

    The next rule is always the one that rejects most for its cost among the documents that the rules before it left: a rule that
    rejects the same documents as an earlier one is worth nothing after it. Costs are measured on fresh documents.

    The sample is the first rows of at most SAMPLE_BYTES of text that Spark finds (it reads as few partitions as it needs); it
    is timed on the driver. Only the order of work hangs on it.
    """
    rows = narrowed(docs, docs.columns[0], text_col).where(F.octet_length("text") <= SAMPLE_BYTES).select("text").limit(sample_rows).collect()
    texts = [bytes(r[0]) for r in rows]
    seconds, hits = {}, {}
    for rule in rules:
        fresh = [Doc(t) for t in texts]
        began = time.perf_counter()
        hits[rule.name] = {k for k, d in enumerate(fresh) if rule.rejects(d)}
        seconds[rule.name] = time.perf_counter() - began
    out, left = [], set(range(len(texts)))
    while hits:
        best = min((Estimate(k, seconds[k], len(v & left), len(texts)) for k, v in hits.items()), key=lambda e: (-e.worth, e.seconds, e.rule))
        left -= hits.pop(best.rule)
        out.append(best)
    return out


def cascade(rules: tuple[Rule, ...], d: Doc) -> str | None:
    """The first rule that rejects, or None; later rules are not evaluated."""
    return next((r.name for r in rules if r.rejects(d)), None)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """A row for each document: the base counts, base_failed, kept, and failed_rule (the first to reject in this run's order)."""
    ranked = [e.rule for e in estimate(docs, rules, text_col, sample_rows)]
    order = tuple(sorted(rules, key=lambda r: ranked.index(r.name)))
    schema = (
        f"doc_id {id_type(docs, id_col)},n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,"
        "base_failed boolean,kept boolean,failed_rule string"
    )

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in part.column("text").to_pylist():
            d = Doc(text)
            failed = cascade(order, d)
            base = d.n_words < 20 or 100 * d.n_repeat_words > 30 * d.n_words
            rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, base, not base and failed is None, failed))
        return batch(schema, list(zip(*rows, strict=True)), part.column("doc_id"))

    return mapped(narrowed(docs, id_col, text_col), kernel, schema)


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns, that no rule rejects. Rejected rows stop at the first rule; nothing else is counted."""
    ranked = [e.rule for e in estimate(docs, rules, text_col, sample_rows)]
    order = tuple(sorted(rules, key=lambda r: ranked.index(r.name)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            texts = part.column(text_col).cast(pa.binary()).to_pylist()
            yield part.filter(pa.array([cascade(order, Doc(t or b"")) is None for t in texts], pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)
