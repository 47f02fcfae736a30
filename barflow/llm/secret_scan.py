"""Secret scan: fixed forms, and strings whose compressed novelty is high where the text speaks of secrets.

Three fixed forms (assigned values, access keys, long hexadecimal runs) are always reported. Beyond them a candidate is a long run of
key characters of mixed classes (capitals, small letters, digits) with a sensitive word shortly before it. Its novelty is what it costs
to compress: zstandard, primed with the identifier dictionary, compresses the surroundings with and without it, and the difference is
held against its length. Names, paths and words are made of pieces that the dictionary or the surroundings hold and cost some 0.6 bytes
a character at most; random strings cost 0.8 and more, whether of base64 or hexadecimal digits, and those are reported.

The identifier dictionary is counted from the table itself: word pieces of all whole texts (camel and snake case taken apart), each once
a text, summed by Spark; the most frequent DICTIONARY of them, equal counts in order of the word, are the dictionary, at most
DICTIONARY * 25 bytes. Only letters are counted, so that no key with digits gets in, however often it is repeated. Other occurrences of
the candidate itself are taken out of its surroundings.

A NULL or empty text has no spans. Whole texts are scanned. Positions are code points, ends exclusive. A found string overlaps no
span of a fixed form; spans of different fixed forms may overlap each other. Repeated rows give a row each; of an empty table the
dictionary is empty and so is the result. Bytes that are no UTF-8 count as one code point each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import id_type, narrowed, slices, trim

#: Pieces of the identifier dictionary.
DICTIONARY = 2000
#: Code points before a candidate in which a sensitive word must stand, and code points of surroundings on either side.
REACH, AROUND = 48, 512
#: Characters of a candidate at least, and added bytes for each character from which it is reported.
LENGTH, NOVEL = 16, 0.76
#: Pieces that a task counts at once.
HELD = 200_000

# The three forms.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Words that speak of secrets.
SENSITIVE = r"pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|cred|bearer|private|signature|session|cookie|salt"

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access, _hex = re.compile(ACCESS), re.compile(HEX)
_words = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_sensitive = re.compile(SENSITIVE, re.IGNORECASE | re.ASCII)
_run = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LENGTH},}}")
_piece = re.compile(rb"[A-Z]?[a-z]{2,23}|[A-Z]{3,24}")
KINDS = ("assign", "access", "hex", "novel")


def fixed_spans(text: str, raw: bytes) -> list[tuple[int, int, int, float | None]]:
    """(start, kind's number, end, None) of the fixed forms; a kind's matches do not overlap."""
    out = []
    low = raw.lower()
    if any(w in low for w in _words):
        out += [(m.start(), 0, m.end(), None) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), None) for m in _access.finditer(text)]
    out += [(m.start(), 2, m.end(), None) for m in _hex.finditer(text)]
    return out


class Novelty:
    """Marginal compressed bytes of a string against identifiers and the text around it, all in lower case."""

    def __init__(self, identifiers: bytes) -> None:
        how = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=14, chain_log=14, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_checksum=0, write_content_size=0, write_dict_id=0
        )
        primed = zstandard.ZstdCompressionDict(identifiers or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(compression_params=how)
        self.coder = zstandard.ZstdCompressor(dict_data=primed, compression_params=how)

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes that text[start:end] adds to its compressed surroundings, for each of its characters."""
        raw = lambda x: x.lower().encode("utf-8", "replace")
        found, before, after = raw(text[start:end]), raw(text[max(0, start - AROUND) : start]), raw(text[end : end + AROUND])
        before, after = before.replace(found, b" "), after.replace(found, b" ")
        return (len(self.coder.compress(before + found + after)) - len(self.coder.compress(before + after))) / len(found)


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Long runs of key characters of mixed classes, near a sensitive word and clear of the spans `taken` (in order of start)."""
    at, covered = 0, 0
    for m in _run.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][0] < end:
            covered, at = max(covered, taken[at][1]), at + 1
        run = m[0]
        start, end = start + len(run) - len(run.lstrip("+/_.=-")), start + len(run.rstrip("+/_.-"))
        found = text[start:end]
        classes = any(c.isdigit() for c in found) + any(c.islower() for c in found) + any(c.isupper() for c in found[1:])
        if covered <= start and end - start >= LENGTH and classes > 1 and _sensitive.search(text, max(0, start - REACH), start):
            yield start, end


def spans(text: str, raw: bytes, novelty: Novelty) -> list[tuple[int, int, int, float | None]]:
    """All spans of a text by start, then by kind."""
    base = sorted(fixed_spans(text, raw))
    found = [(start, 3, end, cost) for start, end in candidates(text, [(x[0], x[2]) for x in base]) if (cost := novelty.of(text, start, end)) >= NOVEL]
    return sorted(base + found, key=lambda x: x[:3])


def identifiers(texts: DataFrame) -> bytes:
    """The dictionary of a table with binary `text`: its most frequent word pieces, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["piece", "n"])
            counts.clear()
            return done

        for part in slices(batches):
            for text in part.column("text").to_pylist():
                counts.update({w.lower() for w in set(_piece.findall(text))})
                if len(counts) > HELD:
                    yield out()
        yield out()
        trim()

    counted = texts.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return b" ".join(r[0].encode() for r in reversed(counted.orderBy(F.desc("n"), "piece").limit(DICTIONARY).collect()))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of (kind, start, end, novelty), by start and then by kind; novelty is NULL for the fixed forms."""
    texts = narrowed(docs, id_col, text_col)
    dictionary = identifiers(texts)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for part in slices(batches):
            found = []
            for raw in part.column("text").to_pylist():
                text = raw.decode("utf-8", "replace")
                found.append([{"kind": KINDS[k], "start": a, "end": b, "novelty": cost} for a, k, b, cost in spans(text, raw, novelty)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])
        trim()

    return texts.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, spans array<struct<kind:string,start:long,end:long,novelty:double>>")


def without_secrets(docs: DataFrame, mark: str = "[removed]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every found span replaced by `mark`; overlapping spans together by one. Further columns stay."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary")).alias("text"))
    dictionary = identifiers(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for part in slices(batches, column=text_col):
            at, out = part.schema.get_field_index(text_col), []
            for text in part.column(at).to_pylist():
                if text:
                    pieces, done = [], 0
                    for start, _, end, _ in spans(text, text.encode(), novelty):
                        if start >= done:
                            pieces += [text[done:start], mark]
                        done = max(done, end)
                    text = "".join((*pieces, text[done:]))
                out.append(text)
            yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))
        trim()

    return docs.mapInArrow(run, docs.schema)
