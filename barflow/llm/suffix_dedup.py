"""Removal of repeated passages: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A string of `least` bytes is repeated if it starts at two or more places of the corpus (same document included, never across
documents); every byte under a repeated string is removed, judged on the input. The corpus is split so that equal strings
always meet, without a global suffix array:

1. Each string of `least` bytes is owned by its minimal GRAM-byte gram (least mixed hash, the first of equals). Neighbouring
   strings mostly share their owner, so a text has about one owner for each 77 bytes. Equal strings have equal owners.
2. Blocks ask for each distinct owner how often it stands anywhere; strings whose owner stands once are not repeated.
3. For the others, blocks send the stretch of text that an owner's strings cover (about 280 bytes) to the owner's shard; equal
   stretches are merged with a count first. A shard gathers the distinct stretches of an owner.
4. In a shard, all stretches whose owner has two or more different ones form a text with a Burrows-Wheeler transform. From the
   interval of the empty string, breadth first, all intervals are extended backward by every character (rank queries on a
   wavelet matrix); the level at which a row is first bounded is its common prefix with the row above, so common prefixes come
   out by increasing value. The expansion stops at `least`: rows never bounded share `least` bytes with the row above. An
   owner with one stretch has nothing to compare: its strings are repeated exactly if the stretch was counted twice.
5. An owner with more than HOT places (a passage that a large part of the documents share) would be an unbounded group. Its
   strings are instead spread by their own 128-bit hashes, one entry for each block and distinct string.

NULL and empty texts, and texts under `least` bytes, lose nothing. Repeated rows count as different places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barflow.llm.blocks import answered, asked, blocked, deflated, inflated, pack, rows_of, shard_slices, shards, texts, told, unpack, volume
from barflow.llm.common import id_type

#: Bytes of a repeated string.
LEAST = 200
#: Bytes of a gram.
GRAM = 48
#: Places beyond which an owner's strings are spread by hash.
HOT = 4096
#: Text bytes that one shard stands for; an owner's stretches in it are a few per cent of that.
PER_SHARD = 24 << 20
#: Bytes in one transform, about.
BWT_BYTES = 1 << 20
_CHUNK = 1 << 18
_RNG = np.random.default_rng(20240229)
_TABLES = _RNG.integers(1 << 62, (1 << 64) - 1, (2, 256), dtype=np.uint64)
_ODD = _RNG.integers(1 << 62, (1 << 64) - 1, (2, 16), dtype=np.uint64) | np.uint64(1)


def rolling(text: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of all n-byte substrings, built from those of powers of two."""
    power = [_TABLES[which][text]]
    size = 1
    while size * 2 <= n:
        h = power[-1]
        power.append(h[:-size] * _ODD[which, len(power)] + h[size:] if len(h) > size else h[:0])
        size *= 2
    out, done = None, 0
    for k in range(len(power) - 1, -1, -1):
        if n & (1 << k):
            h = power[k]
            if out is None:
                out = h
            else:
                m = len(text) - done - (1 << k) + 1
                out = out[:m] * _ODD[which, 8 + k] + h[done : done + m]
            done += 1 << k
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def owners(text: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one owner: first start, last start, the owner's hash. `ends`: where each document ends."""
    w = least - gram + 1
    begins = np.concatenate(([0], ends[:-1]))
    long = ends - begins >= least
    edge = np.zeros(len(text) + 1, np.int8)
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, ends[long] - least + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    out = []
    for a in range(0, len(text), _CHUNK):
        part = text[a : a + _CHUNK + least - 1]
        if len(part) < least or not valid[a : a + _CHUNK].any():
            continue
        h = rolling(part, gram)
        m = (_mixed(h) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= w:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < w:
            m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
        at = np.flatnonzero(valid[a : a + len(m)])
        own = (m[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(at)])) - 1
        out.append((at[first] + a, at[last] + a, h[own[first]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _joined(docs: pa.Table, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    each = texts(docs, text_col)
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum([len(t) for t in each], dtype=np.int64)


# --- the transform -----------------------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of text in the order of their first `depth` symbols, at least."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    take = 63 // bits
    key = np.zeros(n, np.int64)
    for j in range(take):
        key = (key << bits) | np.roll(text, -j)
    known = take
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
        if known >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1) + np.roll(rank, -known)
        known *= 2


class Wavelet:
    """Wavelet matrix of a transform: all backward extensions of many intervals at once."""

    def __init__(self, bwt: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        cur = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(cur) - self.ones[-1][-1]))
            cur = np.concatenate((cur[~bit], cur[bit]))
        counts = np.bincount(bwt, minlength=sigma)
        self.smaller = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.block = np.zeros(sigma, np.int64)  # where a symbol's rows begin in the last level's order
        first = np.concatenate(([True], cur[1:] != cur[:-1]))
        self.block[cur[first]] = np.flatnonzero(first)

    def extended(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + w for each interval of w and each symbol c before it."""
        symbol = np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[lo], ones[hi]
            left, right = b - a < hi - lo, b > a
            symbol = np.concatenate((symbol[left] * 2, symbol[right] * 2 + 1))
            lo, hi = np.concatenate(((lo - a)[left], a[right] + zeros)), np.concatenate(((hi - b)[left], b[right] + zeros))
        shift = self.smaller[symbol] - self.block[symbol]
        return lo + shift, hi + shift


def bounded_rows(bwt: np.ndarray, sigma: int, least: int) -> np.ndarray:
    """True for each row (and one past the end) whose common prefix with the row above is shorter than `least`."""
    n = len(bwt)
    bounded = np.zeros(n + 1, bool)
    bounded[0] = bounded[n] = True
    tree = Wavelet(bwt, sigma)
    lo, hi = np.array([0], np.int64), np.array([n], np.int64)
    for _ in range(least):
        lo, hi = tree.extended(lo, hi)
        new = ~bounded[hi]
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
        bounded[hi] = True
    return bounded


def repeated(stretches: list[bytes], weights: list[int], least: int) -> list[np.ndarray]:
    """For each stretch, which of its strings of `least` bytes start at two places (a stretch of weight 2 stands twice)."""
    sizes = np.array([len(s) + 1 for s in stretches], np.int64)
    raw = np.frombuffer(b"\0".join(stretches) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    raw[ends - 1] = 0
    present, text = np.unique(raw, return_inverse=True)
    order = suffix_order(text, least)
    bounded = bounded_rows(text[order - 1].astype(np.int64), len(present), least)
    cluster = np.cumsum(bounded[:-1]) - 1
    inside = np.repeat(ends, sizes) - 1 - np.arange(len(text)) >= least  # the string does not reach its stretch's end
    weight = np.where(inside, np.repeat(np.array(weights, np.int64), sizes), 0)[order]
    total = np.bincount(cluster, weights=weight)
    flag = np.empty(len(text), bool)
    flag[order] = total[cluster] >= 2
    flag &= inside
    return [flag[e - z : e - least] for e, z in zip(ends.tolist(), sizes.tolist(), strict=True)]


# --- questions and answers ---------------------------------------------------------------------------------------------


def _ask_owners(text_col: str, least: int, gram: int, n: int):
    def ask(docs: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, _, h = owners(*_joined(docs, text_col), least, gram)
        keys, counts = np.unique(h, return_counts=True)
        for shard, at in shard_slices(keys, n):
            yield shard, pack(keys[at], np.minimum(counts[at], HOT + 1).astype("<u2"))

    return ask


def _count_owners(got: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    parts = [unpack(p, "<u8", "<u2") for _, p in got]
    keys = np.concatenate([k for k, _ in parts])
    uniq, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([c for _, c in parts]), minlength=len(uniq))
    status = ((total >= 2).astype(np.uint8) + (total > HOT))[inverse].astype(np.uint8)
    at = 0
    for (block, _), (k, _) in zip(got, parts, strict=True):
        yield block, deflated(status[at : at + len(k)].tobytes())
        at += len(k)


def _send(text_col: str, least: int, gram: int, n: int):
    def use(block: int, docs: pa.Table, got: list[tuple[int, bytes]]) -> pa.Table:
        text, ends = _joined(docs, text_col)
        first, last, h = owners(text, ends, least, gram)
        keys, inverse = np.unique(h, return_inverse=True)
        status = np.frombuffer(b"".join(inflated(p) for _, p in got), np.uint8)
        of = status[inverse] if len(keys) else np.zeros(0, np.uint8)
        return pa.Table.from_batches([rows_of(block, _questions(text, first, last, h, of, least, n))])

    return use


def _questions(text: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray, status: np.ndarray, least: int, n: int) -> Iterator[tuple[int, bytes]]:
    data = text.tobytes()
    plain = np.flatnonzero(status == 1)
    merged: dict[tuple[int, bytes], list[int]] = {}
    for key, a, b in zip(h[plain].tolist(), first[plain].tolist(), last[plain].tolist(), strict=True):
        merged.setdefault((key, data[a : b + least]), []).append(a)
    found = sorted(merged, key=lambda k: k[0])
    keys = np.array([k for k, _ in found], np.uint64)
    for shard, at in shard_slices(keys, n):
        some = found[at]
        yield shard, b"S" + deflated(pack(
            keys[at], np.array([len(s) for _, s in some], "<u2"), np.array([len(merged[k]) for k in some], "<u4"),
            np.array([a for k in some for a in merged[k]], "<u4"), np.frombuffer(b"".join(s for _, s in some), np.uint8),
        ))
    hot = np.flatnonzero(status == 2)
    for i in range(0, len(hot), 8192):
        some = hot[i : i + 8192]
        sizes = last[some] - first[some] + least
        index = np.repeat(first[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        near = text[index]
        own = np.repeat(np.cumsum(sizes) - sizes, last[some] - first[some] + 1)
        counts = last[some] - first[some] + 1
        own = own + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        a, b, at = rolling(near, least, 0)[own], rolling(near, least, 1)[own], index[own]
        order = np.lexsort((at, b, a))
        a, b, at = _mixed(a)[order], b[order], at[order]
        order = np.argsort(a, kind="stable")
        a, b, at = a[order], b[order], at[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        start = np.flatnonzero(new)
        counts = np.diff(np.concatenate((start, [len(a)])))
        for shard, s in shard_slices(a[start], n):
            lo, hi = start[s.start], start[s.stop] if s.stop < len(start) else len(a)
            yield shard, b"H" + pack(a[start][s], b[start][s], counts[s].astype("<u4"), at[lo:hi].astype("<u4"))


def _judge(least: int):
    def answer(got: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        flagged: dict[int, list[np.ndarray]] = {}
        groups: dict[int, dict[bytes, list]] = {}
        for block, p in got:
            if p[:1] != b"S":
                continue
            keys, lengths, counts, at, data = unpack(inflated(p[1:]), "<u8", "<u2", "<u4", "<u4", "<u1")
            data, o, q = data.tobytes(), 0, 0
            for key, size, c in zip(keys.tolist(), lengths.tolist(), counts.tolist(), strict=True):
                entry = groups.setdefault(key, {}).setdefault(data[o : o + size], [0, []])
                entry[0] += c
                entry[1].append((block, at[q : q + c]))
                o, q = o + size, q + c

        def mark(entry: list, ok: np.ndarray | None, size: int) -> None:
            starts = np.arange(size - least + 1) if ok is None else np.flatnonzero(ok)
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) != 1)
                a, b = starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]
                for block, at in entry[1]:
                    at = at.astype(np.int64)
                    flagged.setdefault(block, []).append(np.stack(((at[:, None] + a).ravel(), (at[:, None] + b).ravel())))

        batch: list[tuple[bytes, list]] = []
        size = 0

        def expand() -> None:
            for (s, entry), ok in zip(batch, repeated([s for s, _ in batch], [e[0] for _, e in batch], least), strict=True):
                mark(entry, ok, len(s))

        for group in groups.values():
            if len(group) == 1:
                ((s, entry),) = group.items()
                if entry[0] >= 2:
                    mark(entry, None, len(s))
                continue
            batch += group.items()
            size += sum(map(len, group))
            if size > BWT_BYTES:
                expand()
                batch, size = [], 0
        if batch:
            expand()

        hashed = [(block, *unpack(p[1:], "<u8", "<u8", "<u4", "<u4")) for block, p in got if p[:1] == b"H"]
        if hashed:
            a, b = np.concatenate([x[1] for x in hashed]), np.concatenate([x[2] for x in hashed])
            counts = np.concatenate([x[3] for x in hashed]).astype(np.int64)
            order = np.lexsort((b, a))
            new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
            cluster = np.empty(len(a), np.int64)
            cluster[order] = np.cumsum(new) - 1
            twice = (np.bincount(cluster, weights=counts) >= 2)[cluster]
            o = 0
            for block, x, _, c, at in hashed:
                own = at[np.repeat(twice[o : o + len(x)], c)].astype(np.int64)
                if len(own):
                    own = np.sort(own)
                    cut = np.flatnonzero(np.diff(own) != 1)
                    flagged.setdefault(block, []).append(np.stack((own[np.concatenate(([0], cut + 1))], own[np.concatenate((cut, [len(own) - 1]))])))
                o += len(x)
        for block, ranges in flagged.items():
            lo, hi = np.concatenate(ranges, axis=1)
            yield block, deflated(pack(lo.astype("<u4"), hi.astype("<u4")))

    return answer


def _masks(docs: pa.Table, text_col: str, got: list[tuple[int, bytes]], least: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text with the bytes to remove."""
    each = texts(docs, text_col)
    edge = np.zeros(sum(map(len, each)) + 1, np.int32)
    for _, p in got:
        lo, hi = unpack(inflated(p), "<u4", "<u4")
        np.add.at(edge, lo.astype(np.int64), 1)
        np.add.at(edge, hi.astype(np.int64) + least, -1)
    mask = np.cumsum(edge[:-1]) > 0
    at = 0
    for t in each:
        yield t, mask[at : at + len(t)]
        at += len(t)


def flagged_blocks(docs: DataFrame, text_col: str, least: int, gram: int) -> tuple[DataFrame, int, DataFrame]:
    """Blocks of docs, their volume, and for each block the ranges of starts of repeated strings."""
    blocks = blocked(docs, text_col)
    size = volume(blocks)
    n = shards(size, PER_SHARD)
    seen = answered(asked(blocks, _ask_owners(text_col, least, gram, n)), _count_owners, n)
    sent = told(blocks, size, seen, _send(text_col, least, gram, n), "block long, shard int, payload binary")
    return blocks, size, answered(sent, _judge(least), n)


def _spans(mask: np.ndarray) -> np.ndarray:
    d = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(d == 1), np.flatnonzero(d == -1)), axis=1)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans (array of [first, end) bytes removed)."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    blocks, size, flags = flagged_blocks(own, "text", least, gram)
    kind = id_type(docs, id_col)

    def use(block: int, rows: pa.Table, got: list[tuple[int, bytes]]) -> pa.Table:
        out = []
        for t, mask in _masks(rows, "text", got, least):
            spans = _spans(mask)
            kept = t if not len(spans) else np.frombuffer(t, np.uint8)[~mask].tobytes()
            out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans.tolist()))
        a, b, c, d, e = zip(*out, strict=True)
        return pa.table({
            "doc_id": rows.column("doc_id"), "n_bytes": pa.array(a, pa.int64()), "n_removed": pa.array(b, pa.int64()), "n_spans": pa.array(c, pa.int64()),
            "kept_sha256": pa.array(d, pa.string()), "spans": pa.array(e, pa.list_(pa.list_(pa.int64()))),
        })

    return told(blocks, size, flags, use, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>")


def without_repeats(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """docs, every row and column, with repeated passages taken out of the text.

    A character goes if any of its bytes is under a repeated string. A NULL text stays NULL. chars_col, if given, is a column
    of character counts to renew.
    """
    blocks, size, flags = flagged_blocks(docs, text_col, least, gram)

    def use(block: int, rows: pa.Table, got: list[tuple[int, bytes]]) -> pa.Table:
        new = []
        for t, mask in _masks(rows, text_col, got, least):
            if mask.any():
                raw = np.frombuffer(t, np.uint8)
                char = np.cumsum((raw & 0xC0) != 0x80) - 1
                gone = np.zeros(int(char[-1]) + 1, bool)
                gone[char[mask]] = True
                t = raw[~gone[char]].tobytes()
            new.append(t.decode("utf-8", "replace"))
        old = rows.column(text_col)
        new = [x if ok else None for x, ok in zip(new, old.is_valid().to_pylist(), strict=True)]
        rows = rows.set_column(rows.schema.get_field_index(text_col), text_col, pa.array(new, pa.string()))
        if chars_col:
            at = rows.schema.get_field_index(chars_col)
            rows = rows.set_column(at, chars_col, pa.array([None if x is None else len(x) for x in new], rows.schema.field(at).type))
        return rows

    return told(blocks, size, flags, use, docs.schema)
