"""Benchmark decontamination with suffix arrays over the training text.

Every bounded slice of the training documents is a shard with its own suffix array, kept in the task that made it. Every suffix
of a test item is binary-searched in it at full length, which puts the test suffixes and the places of the shard in one order.
The longest verbatim match of a place is then the longer of its common prefixes with the test suffixes before and after it; it
counts if it has a whole window, that is `window` words, or the whole of an item with fewer words. So every place gets its
longest match, whatever else is in its slice, and the words under matches are exactly those inside occurrences of windows.

The array is sparse: a suffix enters it only if the next words are all benchmark words, as many as the shortest window
that starts with its word, since no test suffix can match elsewhere; and a test suffix is searched only in shards that have a
place with its first two words. Training text is never shuffled. The benchmark's words, its suffix order and the windows' items
are arrays built on the driver, some 40 bytes for each word, and broadcast; a benchmark over CHUNK_BYTES of text goes in several
chunks, one after another: a chunk's matches are written and its broadcast is destroyed before the next is fetched, so neither the
driver nor a worker ever holds two. Equal items with fewer words than a window are searched once.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; told apart by 64-bit hashes. NULL and empty texts and items have no
words: such an item has no window, such a document is clean. An item without id marks words, but is neither counted nor named.
Several items of one id are one item; equal items of several ids each count. Repeated rows give a row each. A document
longer than a slice is a shard of its own, searched whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.common import alnum_words, id_type, narrowed, slices, trim, word_hashes, written

#: Consecutive words that make a hit.
WINDOW = 10
#: Benchmark text in a broadcast at most.
CHUNK_BYTES = 16 << 20
#: Words compared at once.
_STEP = 8


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))


def _runs(flat: np.ndarray) -> np.ndarray:
    """Words from each place on up to the next 0; flat ends with a 0."""
    zero = np.flatnonzero(flat == 0)
    return zero[np.searchsorted(zero, np.arange(len(flat)))] - np.arange(len(flat))


def suffix_order(flat: np.ndarray, run: np.ndarray, places: np.ndarray) -> np.ndarray:
    """`places` in the order of the words from there on up to the next 0, by doubling the length that is ranked."""
    rank, k, longest = flat.astype(np.int64), 1, int(run.max(initial=0))
    while k < longest:
        far = np.flatnonzero(run > k)
        key = rank << 32
        key[far] |= rank[far + k]
        kinds, rank = np.unique(key, return_inverse=True)
        if len(kinds) > np.count_nonzero(flat):
            break
        k *= 2
    return places[np.argsort(rank[places], kind="stable")]


def common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that a from i on and b from j on have in common, up to a 0; both end with _STEP zeros."""
    n, live, step = np.zeros(len(i), np.int64), np.arange(len(i)), np.arange(_STEP)
    while len(live):
        x, y = a[(i[live] + n[live])[:, None] + step], b[(j[live] + n[live])[:, None] + step]
        same = (x == y) & (x > 0)
        k = np.where(same.all(1), _STEP, same.argmin(1))
        n[live] += k
        live = live[k == _STEP]
    return n


def _heads(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first two words at each place as one number."""
    return (flat[places].astype(np.int64) << 32) | flat[places + 1]


class TestSuffixes:
    """The items' words, their suffixes with a whole window in suffix order, and the items of each window."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window = window
        each = [(None if i is None else str(i), alnum_words(t or b"")) for i, t in items]
        each = [(i, w) for i, w in each if w]
        sizes = np.array([len(w) for _, w in each], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        words = np.concatenate([np.zeros(0, np.uint64), *(_hashes(w) for _, w in each)])
        #: hashes of the benchmark's words in order; a word's number is its place from 1
        self.vocab, number = np.unique(words, return_inverse=True)
        self.flat = np.zeros(int(sizes.sum()) + len(each) + _STEP, np.int32)
        spot = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(each)), sizes)
        self.flat[spot] = number + 1
        self.names = [i for i, _ in each]
        self.first = first
        run = _runs(self.flat)
        least = np.minimum(window, np.repeat(sizes, sizes))
        #: the shortest window that starts with a word
        self.need = np.full(len(self.vocab) + 1, np.iinfo(np.int32).max, np.int64)
        own = run[spot] >= least
        np.minimum.at(self.need, self.flat[spot[own]], least[own])
        long = spot[own & (least == window)]
        #: places of suffixes with a window of full length, in suffix order; then whole items with fewer words
        self.order = suffix_order(self.flat, run, long)
        equal: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(sizes < window).tolist():
            equal.setdefault(self.flat[first[k] : first[k] + sizes[k]].tobytes(), []).append(k)
        #: equal items with fewer words are one group, so that a place meets each length once; the groups' items, and the place of one
        self.short_items = list(equal.values())
        self.short = first[[own[0] for own in self.short_items]] if self.short_items else first[:0]
        self.head, self.short_head = _heads(self.flat, self.order), _heads(self.flat, self.short)
        #: suffixes in a row that begin with one window are one group
        new = np.ones(len(self.order), bool)
        if len(self.order) > 1:
            new[1:] = common(self.flat, self.order[:-1], self.flat, self.order[1:]) < window
        self.group = np.cumsum(new) - 1
        self.group_start = np.concatenate((np.flatnonzero(new), [len(self.order)]))

    def item(self, place: int) -> int:
        return int(np.searchsorted(self.first, place, "right")) - 1

    def of_group(self, g: int) -> set[int]:
        """Items that hold a window."""
        return set((np.searchsorted(self.first, self.order[self.group_start[g] : self.group_start[g + 1]], "right") - 1).tolist())


class Shard:
    """Suffix array of a slice of documents: places in the order of the words from there on."""

    def __init__(self, docs: list[list[bytes]], tests: TestSuffixes):
        self.tests = tests
        sizes = np.array([len(d) for d in docs], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        flat = np.zeros(int(sizes.sum()) + len(docs) + _STEP, np.int32)
        if len(tests.vocab):
            h = _hashes([w for d in docs for w in d])
            at = np.minimum(np.searchsorted(tests.vocab, h), len(tests.vocab) - 1)
            flat[np.arange(len(h)) + np.repeat(np.arange(len(docs)), sizes)] = np.where(tests.vocab[at] == h, at + 1, 0)
        run = _runs(flat)
        places = np.flatnonzero((flat > 0) & (run >= tests.need[flat]))
        self.flat, self.places = flat, places
        if len(places):
            # only runs of benchmark words that hold a place are ranked
            end = np.arange(len(flat)) + run
            held = np.zeros(len(flat) + 1, bool)
            held[end[places]] = True
            some = np.flatnonzero(held[end])
            small, back = flat[some], np.cumsum(held[end]) - 1
            self.places = some[suffix_order(small, _runs(small), back[places])]

    def insertion(self, suffixes: np.ndarray, heads: np.ndarray, depth: np.ndarray | None = None, after: bool = False) -> np.ndarray:
        """Where test suffixes stand in the order of this shard, by binary search over the places with their first two words.

        With `depth`, suffixes are whole items of so many words; they stand before (or `after`) all places that begin with them.
        """
        own = _heads(self.flat, self.places)
        if depth is not None:  # an item of one word meets any second word
            one = heads & 0xFFFFFFFF == 0
            lo, hi = np.searchsorted(own, heads, "left"), np.searchsorted(own, np.where(one, heads | 0xFFFFFFFF, heads), "right")
        else:
            lo, hi = np.searchsorted(own, heads, "left"), np.searchsorted(own, heads, "right")
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            i, j = self.places[mid], suffixes[live]
            n = common(self.flat, i, self.tests.flat, j)
            less = self.flat[i + n] < self.tests.flat[j + n]
            if depth is not None:
                less = np.where(n >= depth[live], after, less)
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Longest matches: place, words, place in the tests, and group of the window (-1 - group for items with fewer words)."""
        t, none = self.tests, np.zeros(0, np.int64)
        out = [(none, none, none, none)]
        if not len(self.places):
            return out[0]
        heads = np.unique(_heads(self.flat, self.places))
        pick = np.flatnonzero(np.isin(t.head, heads))
        if len(pick):
            at = self.insertion(t.order[pick], t.head[pick])
            # the test suffixes before and after each place
            k = np.searchsorted(at, np.arange(len(self.places)), "right")
            before, behind = pick[np.maximum(k - 1, 0)], pick[np.minimum(k, len(pick) - 1)]
            n, m = (common(self.flat, self.places, t.flat, t.order[x]) for x in (before, behind))
            best, words = np.where(n >= m, before, behind), np.maximum(n, m)
            hit = words >= t.window
            out.append((self.places[hit], words[hit], t.order[best[hit]], t.group[best[hit]]))
        pick = np.flatnonzero(np.isin(t.short_head >> 32, heads >> 32))
        if len(pick):
            depth = _runs(t.flat)[t.short[pick]]
            lo, hi = (self.insertion(t.short[pick], t.short_head[pick], depth, x) for x in (False, True))
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append((self.places[at], np.repeat(depth, n), np.repeat(t.short[pick], n), -1 - np.repeat(pick, n)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def documents(self) -> dict[int, tuple[list[str], list[dict]]]:
        """For each document with a match: its items' names, and its longest matches that lie in no other one."""
        t = self.tests
        place, words, test, group = self.search()
        doc = np.searchsorted(self.first, place, "right") - 1
        items: dict[int, set[int]] = {}
        held: dict[int, set[int]] = {}
        for d, g in np.unique(np.stack((doc, group), 1), axis=0).tolist():
            if g >= 0 and g not in held:
                held[g] = t.of_group(g)
            items.setdefault(d, set()).update(held[g] if g >= 0 else t.short_items[-1 - g])
        order = np.lexsort((-words, place))
        place, words, test, doc = place[order], words[order], test[order], doc[order]
        end = place + words
        far = np.maximum.accumulate(end) if len(end) else end
        new = np.concatenate(([True], end[1:] > far[:-1])) if len(end) else np.zeros(0, bool)
        found: dict[int, list[dict]] = {}
        for p, n, q, d in zip(*(x[new].tolist() for x in (place, words, test, doc)), strict=True):
            k = t.item(q)
            found.setdefault(d, []).append({"item": t.names[k], "doc_word": p - int(self.first[d]), "item_word": q - int(t.first[k]), "words": n})
        return {d: (sorted({t.names[k] for k in own} - {None}), found[d]) for d, own in items.items()}


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list]:
    """The benchmark in lists whose texts have `most` bytes in total at most, or of one item."""
    items = narrowed(benchmark, item_col, text_col)
    held, size = [], 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        text = bytes(r["text"])
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append((r["doc_id"], text))
        size += len(text)
    if held:
        yield held


def matches(
    docs: DataFrame, items: list, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, row_col: str | None = None,
) -> tuple[DataFrame, Broadcast]:
    """For one chunk of items a row per document: doc_id, n_words, items (names), found, and row_col as `row` if given; and what was broadcast.

    `found` is an array of (item, doc_word, item_word, words): the longest matches from left to right, each with one item that
    has it; items are named as text. Rows are those of docs, none is left out.
    """
    cols = narrowed(docs, id_col, text_col) if row_col is None else docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary")).alias("text"), F.col(row_col).alias("row")
    )
    found_type = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))
    schema = T.StructType([
        T.StructField("doc_id", docs.select(id_col).schema[0].dataType), T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("found", T.ArrayType(T.StructType([T.StructField("item", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("doc_word", "item_word", "words"))]))),
        *([T.StructField("row", T.LongType())] if row_col else []),
    ])
    held = docs.sparkSession.sparkContext.broadcast(TestSuffixes(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = [alnum_words(t) for t in part.column("text").to_pylist()]
            own = Shard(words, held.value).documents()
            none = ([], [])
            items, found = zip(*(own.get(k, none) for k in range(len(words))), strict=True)
            arrays = [part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(found, found_type)]
            yield pa.RecordBatch.from_arrays(arrays + ([part.column("row")] if row_col else []), names=schema.fieldNames())
        trim()

    return cols.mapInArrow(run, schema), held


def _digest(found: list[dict], items: list[str], n_words: int) -> tuple[int, int, str]:
    cover = np.zeros(n_words + 1, np.int64)
    for f in found:
        cover[f["doc_word"]] += 1
        cover[f["doc_word"] + f["words"]] -= 1
    names = sorted(set(items))
    return int(np.count_nonzero(np.cumsum(cover[:-1]))), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def decontamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and found (its longest matches)."""
    size = benchmark.agg(F.sum(F.octet_length(item_text_col))).first()[0] or 0
    if size > chunk_bytes:
        # several passes: rows get a number that stays with them
        docs = written(docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "decontamination")
        parts = []
        for items in _chunks(benchmark, item_col, item_text_col, chunk_bytes):  # one at a time: its matches are written before the next is fetched
            part, held = matches(docs, items, "__id", "__text", window, "__row")
            parts.append(written(part, "matches"))
            held.destroy()
        one = reduce(DataFrame.unionByName, parts)
        one = one.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("found")).alias("found")
        ).drop("row")
    else:
        items = [x for chunk in _chunks(benchmark, item_col, item_text_col, chunk_bytes) for x in chunk]  # one chunk, or none: then every document is clean
        one, _ = matches(docs, items, id_col, text_col, window)
    kind = one.schema["doc_id"].dataType.simpleString()
    found_kind = one.schema["found"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            rows = [_digest(*x) for x in zip(*(part.column(c).to_pylist() for c in ("found", "items", "n_words")), strict=True)]
            hit, items, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("n_words"), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit]), part.column("found")],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "found"],
            )

    return one.mapInArrow(
        run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, found {found_kind}"
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark stands."""
    spark = docs.sparkSession
    out, held = docs, None
    for items in _chunks(benchmark, item_col, item_text_col, chunk_bytes):
        if held:  # what the last chunk left is written, so that one stage never holds two
            out = written(out, "clean")
            held.destroy()
        held = spark.sparkContext.broadcast(TestSuffixes(items, window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                texts = part.column(text_col).cast(pa.binary()).to_pylist()
                shard = Shard([alnum_words(t or b"") for t in texts], held.value)
                bad = set((np.searchsorted(shard.first, shard.search()[0], "right") - 1).tolist())
                yield part.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_()))
            trim()

        out = out.mapInArrow(run, docs.schema)
    return out
