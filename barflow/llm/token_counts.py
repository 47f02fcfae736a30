"""Token counts by overlap resynchronisation.

Texts up to CHUNK bytes are encoded whole. A longer one is encoded in overlapping chunks, each with offsets, so that memory
stays bounded by the chunk. Two neighbours are spliced at a common boundary: an ASCII white-space character in the overlap,
with a visible character before it, where both encodings have a token boundary and agree on all tokens of SURE bytes on either
side. If no such boundary is found, the overlap doubles; at worst it reaches the whole text.

For tokenizer files of the form in WORD_SPEC the boundary is proven: every rule of the file (composition, lower case, the cut
into letters, digits and signs) stops at white space, which is dropped, so what stands right of it never changes what stands
left of it. There the words of a chunk are encoded one by one and remembered, and a token's offset is that of its word. For
other files the agreement on either side is the test; it is checked against the library on random text, not proven.

Counts equal those of the library on the whole text, without added, begin or end tokens; special strings inside texts are
handled by the library's defaults. A NULL or empty text has none. Repeated rows are counted each on its own; texts that are no
UTF-8 are read with replacement characters.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barflow.llm.common import batch, id_type, mapped, narrowed

#: Bytes of a chunk, and of the first overlap.
CHUNK, OVERLAP = 8192, 512
#: Bytes on both sides of a splice on which both encodings must agree.
SURE = 24
#: Tokens beyond which over_limit is true.
LIMIT = 2048
#: Words whose ids a worker keeps.
_MEMO = 400_000
#: Form of a tokenizers file whose words are independent (fixed values): normalizers, the pattern of the split, the steps after it.
WORD_SPEC = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


class Library:
    """A tokenizer file: ids, and ids with the bytes at which tokens start and end."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.by_word = False
        self._memo = _Memo(lambda w: np.array(self.word_ids(w), "<u4").tobytes())
        if path.endswith(".json"):
            import json

            from tokenizers import Tokenizer

            self._tok = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                self.by_word = _words_are_independent(json.load(f))
            self._bpe = self._tok.model
            self._ids = lambda texts: [e.ids for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            self._tok = None
            self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: self._sp.encode(texts, num_threads=1)

    def ids(self, text: str) -> list[int]:
        """The library's own ids."""
        return self._ids([text])[0]

    def whole(self, text: bytes) -> bytes:
        """Ids of a text as unsigned little-endian 32-bit numbers, in one go."""
        if self.by_word:
            return b"".join(map(self._memo.__getitem__, _words(text)))
        return np.array(self.ids(text.decode("utf-8", "replace")), "<u4").tobytes()

    def spans(self, text: bytes) -> Spans:
        """ids, first and end byte of each token (of its word, where words are independent)."""
        if self.by_word:
            ids = [self._memo[w] for w in _words(text)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
            blank = np.concatenate(([True], _SPACE[np.frombuffer(text, np.uint8)], [True]))
            edge = np.flatnonzero(blank[1:] != blank[:-1])
            return np.frombuffer(b"".join(ids), "<u4"), np.repeat(edge[::2], counts), np.repeat(edge[1::2], counts)
        s = text.decode("utf-8", "replace")
        if self._tok is not None:
            e = self._tok.encode(s, add_special_tokens=False)
            ids, char = e.ids, np.array(e.offsets, np.int64).reshape(-1, 2)
            # places are counted in characters
            lead = (np.frombuffer(s.encode(), np.uint8) & 0xC0) != 0x80
            at = np.concatenate((np.flatnonzero(lead), [len(lead)]))
            return np.array(ids, "<u4"), at[char[:, 0]], at[char[:, 1]]
        pieces = self._sp.encode(s, return_type="proto").pieces
        return tuple(np.array([getattr(p, k) for p in pieces], t) for k, t in (("id", "<u4"), ("begin", np.int64), ("end", np.int64)))

    def packed(self, text: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """Ids of a whole text as unsigned little-endian 32-bit numbers; a text over `chunk` bytes by overlap resynchronisation."""
        if len(text) <= chunk:
            return self.whole(text)
        return spliced(self, text, chunk, overlap).tobytes()

    def word_ids(self, word: bytes) -> list[int]:
        w = word.decode("utf-8", "replace")
        if _LETTERS.fullmatch(w):  # small letters: no normalizer changes them, no rule cuts them
            return [t.id for t in self._bpe.tokenize(w if w.isascii() else "".join(map(_BYTE_CHAR.__getitem__, word)))]
        m = _ENDED.fullmatch(w)
        if m:  # letters end where signs begin, whatever stands around
            return self.word_ids(m[1].encode()) + [t.id for t in self._bpe.tokenize(m[2])]
        return self.ids(w)


def _words(text: bytes) -> list[bytes]:
    # A-Z is lower-cased by such a file anyway, but for special strings, which it looks for first, and after composition:
    # a capital with a combining mark may stay two characters where the small letter has a composed form
    return (text.lower() if text.isascii() and b"<" not in text else text).split()


class _Memo(dict):
    """Word -> value, computed when first asked for; emptied when full, so a worker's memory stays bounded."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word: bytes):
        if len(self) >= _MEMO:
            self.clear()
        out = self[word] = self.value(word)
        return out


#: Lower-case letters that are one pre-token whatever follows, and signs after them that are another.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_ENDED = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!\"#$%&()*+,\\-./:;=?@^_`{}~\\[\\]]+)")


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


_BYTE_CHAR = _byte_chars()


def _words_are_independent(spec: dict) -> bool:
    """Whether a tokenizers file has the form of WORD_SPEC, byte pairs with an end mark, and no added token that reaches beyond a word."""
    normal, pre, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    return (
        (normal.get("normalizers"), pre.get("pretokenizers")) == WORD_SPEC
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and spec.get("post_processor") is None
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    )


@lru_cache(4)
def library(path: str) -> Library:
    return Library(path)


def _edge(text: bytes, at: int) -> int:
    """The first place from `at` on that does not cut a character."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(text))


def _cut(text: bytes, left: Spans, right: Spans, lo: int, hi: int) -> tuple[int, int] | None:
    """A stable boundary in text[lo:hi]: the number of tokens of `left` before it and of `right` before it.

    `left` and `right` are spans with bytes counted in the whole text. Places nearest to the middle are tried first.
    """
    (lids, lbeg, lend), (rids, rbeg, rend) = left, right
    blank = _SPACE[np.frombuffer(text, np.uint8, hi - lo + 1, lo - 1)]
    places = np.flatnonzero(blank[1:] & ~blank[:-1]) + lo
    for p in places[np.argsort(np.abs(2 * places - lo - hi), kind="stable")].tolist():
        i0, i, i1 = np.searchsorted(lbeg, (p - SURE, p, p + SURE)).tolist()
        j0, j, j1 = np.searchsorted(rbeg, (p - SURE, p, p + SURE)).tolist()
        if i == i0 or i1 == i or i - i0 != j - j0 or i1 - i0 != j1 - j0:
            continue
        if lend[i - 1] > p or rend[j - 1] > p:
            continue
        if (lids[i0:i1] == rids[j0:j1]).all() and (lbeg[i0:i1] == rbeg[j0:j1]).all():
            return i, j
    return None


#: Splices made by this process, for tests.
splices = 0


def spliced(lib: Library, text: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of the whole text from overlapping chunks."""
    global splices

    def encoded(a: int, b: int) -> Spans:
        ids, beg, end = lib.spans(text[a:b])
        return ids, beg + a, end + a

    n, out = len(text), []
    at, skip, mark = 0, 0, 0  # the chunk starts at `at`; its first `skip` tokens, those before byte `mark`, are already out
    end = _edge(text, min(n, chunk))
    cur = encoded(0, end)
    while end < n:
        width = min(overlap, chunk // 2)
        found = None
        while found is None:
            start = _edge(text, max(0, end - width))
            if start <= at:
                break
            stop = _edge(text, min(n, start + max(chunk, 2 * width)))
            nxt = encoded(start, stop)
            # the edges of a chunk are not stable: stay SURE bytes off the right chunk's start and the left one's end
            lo, hi = start + SURE, end - SURE
            found = _cut(text, cur, nxt, lo, hi) if hi > lo else None
            if found and found[0] < skip:
                found = None
            width *= 2
        if found is None:
            # the overlap holds the whole left chunk: widen that one to the right instead, from the same start
            end = _edge(text, min(n, at + 2 * (end - at) + width))
            cur = encoded(at, end)
            skip = int(np.searchsorted(cur[1], mark)) if at else 0
            continue
        i, j = found
        out.append(cur[0][skip:i])
        splices += 1
        mark = int(nxt[1][j]) if j < len(nxt[1]) else n
        cur, at, end, skip = nxt, start, stop, j
    return np.concatenate((*out, cur[0][skip:])).astype("<u4")


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; `tokenizer` is the path of a .json or .model file on all hosts."""
    schema = f"doc_id {id_type(docs, id_col)},n_bytes long,n_tokens long,over_limit boolean"

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        lib = library(tokenizer)
        n = [len(lib.packed(t, chunk, overlap)) // 4 for t in texts]
        return batch(schema, [[len(t) for t in texts], n, [x > limit for x in n]], part.column("doc_id"))

    return mapped(narrowed(docs, id_col, text_col), kernel, schema)
