"""Language-model scores by a weighted backoff automaton.

The model is a trigram model with absolute discounting. With c counts in the training documents, C(h) the tokens that follow
a history h there, T(h) the distinct ones among them, N all tokens and V the distinct ones,

    p(w)       = (c(w) + 0.1) / (N + 0.1 * (V + 1))
    p(w | v)   = max(c(v w) - D2, 0) / C(v) + D2 T(v) / C(v) * p(w)               if C(v) > 0, else p(w)
    p(w | u v) = max(c(u v w) - D3, 0) / C(u v) + D3 T(u v) / C(u v) * p(w | v)   if C(u v) > 0, else p(w | v)

and the discounts come from the counts of counts of all n-grams of their order: D = n1 / (n1 + 2 n2), where n1 and n2 n-grams
stand once and twice in training (0.5 where none stands once).

As an automaton: a state for each history of one or two tokens that training continues, and the root. A state has an arc for
each of its n-grams in training, weighted log10 p(w | h), and a failure arc to the state of the shorter history, weighted
log10 (D T(h) / C(h)); the root has an arc for every token, unseen ones included, weighted log10 p(w). The arc of w leads to
the longest kept history that ends with w. A text starts in the state of its beginning and is read once from left to right:
failure arcs are taken until the state has an arc for the token, and the weights along the way add up to the score.

Counts are those of all training documents. No table of n-grams is gathered anywhere: a block asks for the n-grams it holds
(each once, grouped by history), a shard adds up all blocks' counts of its histories and answers, and each block builds the
part of the automaton that its own texts can reach. A shard is a range of history hashes, so C and T are whole there. Tokens
are told apart by 63-bit hashes; within a shard a history of two tokens has 30 bits (of about 2 to the 21 histories, at any
size of the corpus) and a continuation 24, so that two n-grams share their counts once in some hundred or thousand cases.

Tokens: A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`, then one end token. NULL and empty texts are the end token alone. Documents
whose crc32 of the id (as text) modulo `folds` is 0 are held out of training; without training documents every token is as
likely as any other. A text beyond the size of a block is a block of its own, scored whole; repeated rows count and are scored
each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.blocks import answered, asked, blocked, deflated, inflated, pack, pack_keys, shard_slices, shards, texts, told, unpack, unpack_keys, volume
from barflow.llm.common import crc_mod, id_type, space_words, word_hashes, written

#: Added to every token's count in the unigram.
ADDED = 0.1
#: One document in so many is held out.
FOLDS = 10
#: Text bytes that one shard of the counts stands for.
PER_SHARD = 12 << 20
#: Tokens that the traversal reads in one stretch; stretches are read side by side.
STRETCH = 256
_BEGIN, _END = np.uint64(0x5BD1E9955BD1E994), np.uint64(0xC2B2AE3D27D4EB4E)
_A, _B = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a continuation; of a history of two within its shard; of such a history below the number of its shard.
_CONT, _LOCAL, _ABOVE = np.uint64(24), np.uint64(30), np.uint64(40)
_ONE = np.uint64(1)
_CONT_MASK = (_ONE << _CONT) - _ONE


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * _A + second * _B
    x ^= x >> np.uint64(29)
    x *= _A
    return x ^ (x >> np.uint64(32))


class Grams:
    """Distinct n-grams of one order in a block, sorted by history, then by continuation."""

    def __init__(self, history: np.ndarray, cont: np.ndarray, training: np.ndarray):
        self.history, at = np.unique(history, return_inverse=True)
        key = (at.astype(np.uint64) << _CONT) | cont
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        #: the n-gram of each place in the text
        self.gram = np.empty(len(key), np.int32)
        self.gram[order] = np.cumsum(new) - 1
        #: (place of the history, continuation) of each n-gram, and its count in this block's training documents
        self.key = key[first]
        self.count = np.add.reduceat(training[order].astype(np.int64), first) if len(key) else np.zeros(0, np.int64)
        #: n-grams before each history's own
        self.start = np.searchsorted(self.key >> _CONT, np.arange(len(self.history) + 1, dtype=np.uint64))
        #: the history of each place in the text
        self.at = at

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """C and T of each history in this block's training documents."""
        run = [np.concatenate(([0], np.cumsum(x))) for x in (self.count, self.count > 0)]
        return tuple(x[self.start[1:]] - x[self.start[:-1]] for x in run)


class Tokens:
    """Tokens of a block as hashes (the lowest bit is clear), and its n-grams of order two and three."""

    def __init__(self, docs: pa.Table, folds: int, shards_: int):
        each = [space_words(t.lower()) for t in texts(docs)]
        self.sizes = np.array([len(w) + 1 for w in each], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        tok = np.empty(int(self.sizes.sum()), np.uint64)
        for w, a in zip(each, self.starts.tolist(), strict=True):
            tok[a : a + len(w)] = np.fromiter(map(word_hashes.__getitem__, w), np.uint64, len(w))
        del each
        tok &= ~_ONE
        tok[self.ends - 1] = _END
        before = np.empty_like(tok)
        before[1:] = tok[:-1]
        before[self.starts] = _BEGIN
        self.held_out = np.array([crc_mod(i, folds) == 0 for i in docs.column("doc_id").to_pylist()], bool)
        training = np.repeat(~self.held_out, self.sizes)
        self.cont = (tok >> np.uint64(8)) & _CONT_MASK
        self.two = Grams(before, self.cont, training)
        #: place of a token among the histories of one token; the end has the place after the last
        self.word = np.searchsorted(self.two.history, tok)
        self.word[self.ends - 1] = len(self.two.history)
        pair = _pairs(before, tok)
        shard = ((pair >> np.uint64(32)) * np.uint64(shards_)) >> np.uint64(32)
        pair = (shard << _ABOVE) | (pair & ((_ONE << _ABOVE) - _ONE))
        #: places in the text that have a history of two
        inner = np.ones(len(tok), bool)
        inner[self.starts] = False
        self.inner = np.flatnonzero(inner)
        self.three = Grams(pair[self.inner - 1], self.cont[self.inner], training[self.inner])


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts, of which most are small, in a few bits each."""
    more = np.flatnonzero(counts > 254)
    return _bytes(deflated(pack(np.minimum(counts, 255).astype(np.uint8), more.astype("<u4"), counts[more].astype("<u8"))))


def _counts(data: np.ndarray) -> np.ndarray:
    low, more, high = unpack(inflated(data.tobytes()), "<u1", "<u4", "<u8")
    out = low.astype(np.int64)
    out[more] = high
    return out


def _bytes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8)


def _planes(cont: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(cont.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).ravel()


def _from_planes(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = data.reshape(3, -1).T
    return out.view("<u4").ravel().astype(np.uint64)


def _level_slices(k: int, grams: Grams, n: int) -> Iterator[tuple[int, slice]]:
    """Shards of the histories of order k."""
    if k == 0:
        yield from shard_slices(grams.history, n)
        return
    of = (grams.history >> _ABOVE).astype(np.int64)
    if len(of):
        edge = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)])).tolist()
        for a, b in zip(edge[:-1], edge[1:]):
            yield int(of[a]), slice(a, b)


_EMPTY = np.zeros(0, np.uint8)
#: Arrays of one order in a question: histories, n-grams of each, continuations, counts.
_ASKED = 4


def _ask(folds: int, n: int):
    def ask(docs: pa.Table) -> Iterator[tuple[int, bytes]]:
        t = Tokens(docs, folds, n)
        parts: dict[int, list[np.ndarray]] = {}
        for k, g in enumerate((t.two, t.three)):
            sizes = np.diff(g.start)
            local = g.history if k == 0 else (g.history & ((_ONE << _ABOVE) - _ONE)) >> (_ABOVE - _LOCAL)
            for shard, at in _level_slices(k, g, n):
                own = slice(g.start[at.start], g.start[at.stop])
                parts.setdefault(shard, [_EMPTY] * (2 * _ASKED))[_ASKED * k : _ASKED * (k + 1)] = [
                    _bytes(deflated(pack_keys(local[at]))), _small(sizes[at]), _planes(g.key[own] & _CONT_MASK), _small(g.count[own])
                ]
        for shard, p in parts.items():
            yield shard, pack(*p)

    return ask


def _total(got: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], tuple[int, int, int, int]]:
    """What each block lacks of the whole corpus's C, T (by history) and c (by n-gram), and sums: tokens, histories in training, n1, n2."""
    hist = [unpack_keys(_bytes(inflated(h.tobytes()))) if len(h) else np.zeros(0, np.uint64) for h, *_ in got]
    sizes = [_counts(m) if len(m) else np.zeros(0, np.int64) for _, m, *_ in got]
    count = [_counts(c) if len(c) else np.zeros(0, np.int64) for *_, c in got]
    every, rank = np.unique(np.concatenate(hist), return_inverse=True)
    if not len(every):
        return [[np.zeros(0, np.int64)] * 3 for _ in got], (0, 0, 0, 0)
    m, c = np.concatenate(sizes), np.concatenate(count)
    key = (np.repeat(rank.astype(np.uint64), m) << _CONT) | np.concatenate([_from_planes(w) for _, _, w, _ in got])
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    cluster = np.cumsum(new) - 1
    whole = np.bincount(cluster, weights=c[order]).astype(np.int64)
    of = (key[new] >> _CONT).astype(np.int64)
    big_c = np.bincount(of, weights=whole, minlength=len(every)).astype(np.int64)
    big_t = np.bincount(of, weights=whole > 0, minlength=len(every)).astype(np.int64)
    back = np.empty(len(key), np.int64)
    back[order] = whole[cluster]
    own = np.concatenate(([0], np.cumsum(m)))
    lack_c = big_c[rank] - _between(c, own)
    lack_t = big_t[rank] - _between(c > 0, own)
    lack = back - c
    cuts = np.cumsum([len(h) for h in hist])[:-1]
    grams = np.cumsum([len(x) for x in count])[:-1]
    sums = int(big_c.sum()), int(np.count_nonzero(big_c)), int(np.count_nonzero(whole == 1)), int(np.count_nonzero(whole == 2))
    return list(map(list, zip(np.split(lack_c, cuts), np.split(lack_t, cuts), np.split(lack, grams), strict=True))), sums


def _between(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(x)))
    return run[edges[1:]] - run[edges[:-1]]


def _answer(got: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    parts = [unpack(p, *["<u1"] * (2 * _ASKED)) for _, p in got]
    two, (tokens, words, *twice) = _total([p[:_ASKED] for p in parts])
    three, (_, _, *thrice) = _total([p[_ASKED:] for p in parts])
    yield -1, pack(np.array([tokens, words, *twice, *thrice], "<i8"))
    for (block, _), x, y in zip(got, two, three, strict=True):
        yield block, pack(*(_small(a) for a in (*x, *y)))


def _sums(answers: DataFrame) -> list[int]:
    """Tokens and distinct tokens of the training documents, n1 and n2 of both orders: one row from sums over the shards."""
    names = ["n", "v", "n1", "n2", "m1", "m2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = np.array([unpack(p, "<i8")[0] for p in part.column("payload").to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T], names=names)

    found = answers.where("block = -1").select("payload").mapInArrow(run, ", ".join(f"{x} long" for x in names))
    return [x or 0 for x in found.agg(*(F.sum(x) for x in names)).first()]


def discount(n1: int, n2: int) -> float:
    """Absolute discount from the numbers of n-grams that stand once and twice."""
    return n1 / (n1 + 2 * n2) if n1 else 0.5


class Automaton:
    """The part of the automaton that a block's texts can reach.

    State -1 is the root, 0 to H-1 are histories of one token, H and on are histories of two. `counts` are (C, T) of each
    order's histories and c of its n-grams over all training documents.
    """

    def __init__(self, t: Tokens, counts: tuple[np.ndarray, ...], n: int, v: int, discounts: tuple[float, float]):
        c2, t2, self.count2, c3, t3, self.count3 = counts
        d2, d3 = discounts
        self.t, self.n_one = t, len(t.two.history)
        begin = int(np.searchsorted(t.two.history, _BEGIN))
        # a word is continued as often as it stands; the end stands as often as the beginning
        seen = np.concatenate((c2, c2[begin : begin + 1]))
        self.known = seen > 0
        self.root = (seen + ADDED) / (n + ADDED * (v + 1))
        self.begin, self.kept = begin, np.concatenate((c2 > 0, c3 > 0))
        two, three = t.two, t.three
        gram = two.gram
        #: the n-grams of each place, of order two and three (-1 where none of three ends)
        self.gram3 = np.full(len(t.cont), -1, np.int32)
        self.gram3[t.inner] = three.gram
        #: the last token of each history of two; the history of two that an n-gram of order two becomes, if a text goes on after it
        self.last, self.becomes = np.zeros(len(three.history), np.int64), np.full(len(two.key), -1, np.int64)
        self.last[three.at] = t.word[t.inner - 1]
        self.becomes[gram[t.inner - 1]] = three.at
        word = np.zeros(len(two.key), np.int64)
        word[gram] = t.word
        h2, h3 = (np.repeat(np.arange(len(g.history)), np.diff(g.start)) for g in (two, three))
        with np.errstate(divide="ignore", invalid="ignore"):
            fail2, fail3 = np.where(c2 > 0, d2 * t2 / c2, 1.0), np.where(c3 > 0, d3 * t3 / c3, 1.0)
            self.failure = np.log10(np.concatenate((fail2, fail3)))
            p2 = np.where(c2[h2] > 0, np.maximum(self.count2 - d2, 0) / np.maximum(c2[h2], 1), 0) + fail2[h2] * self.root[word]
            shorter, _ = self._find(two, self.last[h3], three.key & _CONT_MASK)
            p3 = np.where(c3[h3] > 0, np.maximum(self.count3 - d3, 0) / np.maximum(c3[h3], 1), 0) + fail3[h3] * p2[shorter]
            self.arc2, self.arc3, self.log_root = np.log10(p2), np.log10(p3), np.log10(self.root)

    @staticmethod
    def _find(grams: Grams, history: np.ndarray, cont: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of n-grams, and whether they are there (only a clash of hashes misses one)."""
        key = (history.astype(np.uint64) << _CONT) | cont
        at = np.minimum(np.searchsorted(grams.key, key), max(len(grams.key) - 1, 0))
        return at, grams.key[at] == key if len(grams.key) else np.zeros(len(key), bool)

    def step(self, state: np.ndarray, word: np.ndarray, cont: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Reads one token in each of several stretches: the weight of the way taken, and the state reached.

        at: the tokens' places in the text, whose n-grams are known; without them (for any token after any state) they are looked up.
        """
        h, weight = self.n_one, np.zeros(len(state))
        left = np.ones(len(state), bool)  # those that still fail
        shorter = state.copy()
        deep = np.flatnonzero(state >= h)
        if len(deep):
            g, there = self._find(self.t.three, state[deep] - h, cont[deep]) if at is None else (self.gram3[at[deep]], True)
            hit = there & (self.count3[g] > 0)
            weight[deep] = np.where(hit, self.arc3[g], self.failure[state[deep]])
            left[deep[hit]] = False
            shorter[deep] = self.last[state[deep] - h]
        # the longest kept history that ends with the token
        after = np.where(word < h, word, -1)
        after = np.where(self.kept[after] & (after >= 0), after, -1)
        some = np.flatnonzero(shorter >= 0)
        if len(some):
            g, there = self._find(self.t.two, shorter[some], cont[some]) if at is None else (self.t.two.gram[at[some]], True)
            hit = there & (self.count2[g] > 0)
            weight[some] += np.where(left[some], np.where(hit, self.arc2[g], self.failure[shorter[some]]), 0)
            left[some[hit]] = False
            longer = np.where(there, self.becomes[g], -1)
            good = longer >= 0
            good[good] = self.kept[h + longer[good]]
            after[some[good]] = h + longer[good]
        return weight + np.where(left, self.log_root[word], 0), after

    def walk(self, stretch: int = STRETCH) -> np.ndarray:
        """The weight of each token of the block's texts.

        Texts are read from left to right in stretches side by side. The state after a token hangs on the last two tokens
        alone, so a stretch inside a text starts at the root two tokens earlier, and these do not count.
        """
        t = self.t
        out = np.zeros(len(t.word))
        pieces = -(-t.sizes // stretch)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(t.starts, pieces) + nth * stretch
        stop = np.minimum(first + stretch, np.repeat(t.ends, pieces))
        at = np.where(nth > 0, first - min(2, stretch), first)
        state = np.where(nth > 0, -1, self.begin if self.kept[self.begin] else -1)
        order = np.argsort(at - stop, kind="stable")  # the longest first: those that go on are always a prefix
        first, stop, at, state = first[order], stop[order], at[order], state[order]
        length = stop - at
        for _ in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, 0))
            at, state, length, first = at[:live], state[:live], length[:live], first[:live]
            weight, state = self.step(state, t.word[at], t.cont[at], at)
            counted = at >= first
            out[at[counted]] = weight[counted]
            at, length = at + 1, length - 1
        return out


def lm_scoring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram), score (automaton)."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    blocks = blocked(own)
    size = volume(blocks)
    n_shards = shards(size, PER_SHARD)
    answers = written(answered(asked(blocks, _ask(folds, n_shards)), _answer, n_shards), "counts")
    n, v, n1, n2, m1, m2 = _sums(answers)

    def use(block: int, rows: pa.Table, got: list[tuple[int, bytes]]) -> pa.Table:
        t = Tokens(rows, folds, n_shards)
        parts = [unpack(p, *["<u1"] * 6) for _, p in got]
        lacks = [np.concatenate([_counts(p[k]) for p in parts]) for k in range(6)]
        whole = [x + y for x, y in zip((*t.two.sums(), t.two.count, *t.three.sums(), t.three.count), lacks, strict=True)]
        a = Automaton(t, tuple(whole), n, v, (discount(n1, n2), discount(m1, m2)))
        weight = a.walk()
        known = a.known[t.word].astype(np.int64)
        return pa.table({
            "doc_id": rows.column("doc_id"), "held_out": pa.array(t.held_out), "n_tokens": pa.array(t.sizes),
            "n_known": pa.array(np.add.reduceat(known, t.starts)), "train_tokens": pa.array(np.full(len(t.sizes), n, np.int64)),
            "base_score": pa.array(np.add.reduceat(a.log_root[t.word], t.starts)), "score": pa.array(np.add.reduceat(weight, t.starts)),
        })

    kind = id_type(docs, id_col)
    return told(blocks, size, answers.where("block >= 0"), use, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
