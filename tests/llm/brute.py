"""Plain versions of the operators, one document or one corpus at a time."""

import hashlib
import math
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def low(text):
    return (text or "").translate(UPPER)


def quality(text):
    text = text or ""
    words = SPACE.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def licences(text):
    words = ALNUM.findall(low(text))
    at, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def subsequence(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, best[j] = best[j], old + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def edits(a, b):
    """Words put in, left out, changed or swapped with their neighbour."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def licence_labels(texts, templates, stretch, top, votes, band, edit, share):
    """Labels and score of each text, with every template tried at every word."""
    each = [ALNUM.findall(low(t)) for t in texts]
    df = Counter(w for words in each for w in set(words))
    owns = [ALNUM.findall(low(t.text)) for t in templates]
    vocab = {w for own in owns for w in own}
    out = []
    for words in each:
        labels, score, seen = set(), 0.0, []
        for s in range(0, len(words), stretch):
            some = words[s : s + stretch]
            best = sorted(vocab & set(some), key=lambda w: (df[w], w.encode()))[:top]
            seen += [w if w in best else None for w in some]
        for t, own in zip(templates, owns, strict=True):
            n, half = len(own), (len(own) + 1) // 2
            if t.base:
                if any(words[s : s + n] == own for s in range(len(words))):
                    labels.add(t.label)
                    score = 1.0
                continue
            rare = sorted(range(n), key=lambda j: (df[own[j]], j))[:half]
            wide, d = max(band, n // 8), -n
            at = lambda d: {j for j in range(n) if 0 <= d + j < len(seen) and seen[d + j] == own[j]}  # noqa: B023, E731
            while d < len(words):
                agree = set().union(*(at(x) for x in range(d, d + wide + 1))) if at(d) else set()
                fit = None
                if len(agree) >= min(votes, half) and agree & set(rare):
                    region = lambda p, more: [(own.index(p[0], k), k) for k in range(n) if own[k : k + len(p)] == p][0][1] + d - wide  # noqa: B023, E731
                    fit = subsequence(own, words[max(0, d - wide) : max(0, d + n + 2 * wide)]) / n
                    for name in t.names:
                        p = ALNUM.findall(name)
                        lo = region(p, 0)
                        if not any(words[x : x + len(p)] == p for x in range(max(0, lo), max(0, lo + 3 * wide + 1))):
                            fit = None
                    for sentence in t.key:
                        p = ALNUM.findall(sentence)
                        lo, most = region(p, 0), len(p) // edit
                        part = words[max(0, lo) : max(0, lo + 3 * wide + len(p) + most)]
                        if not any(edits(part[x:y], p) <= most for x in range(len(part)) for y in range(x, min(len(part), x + len(p) + most) + 1)):
                            fit = None
                    if fit is not None and fit >= share:
                        labels.add(t.label)
                        score = max(score, fit)
                        d += wide + 1
                        continue
                d += 1
        out.append((",".join(sorted(labels)), score))
    return out


def decontaminate(texts, items, window=10):
    windows = {}
    for item, text in items:
        words = ALNUM.findall(low(text))
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            windows.setdefault(tuple(words[i : i + m]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for text in texts:
        words = ALNUM.findall(low(text))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(words) - m + 1):
                own = windows.get(tuple(words[i : i + m]))
                if own:
                    hit.update(range(i, i + m))
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        out.append((len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def repeats(texts, least=200):
    raw = [(t or "").encode() if not isinstance(t, bytes) else t for t in texts]
    count = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, n=3):
    words = SPACE.findall(low(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components(ids, texts, n=3, num=90, den=100):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * min(len(a), len(b)) >= num * max(len(a), len(b)):
                x = len(a & b)
                if den * x >= num * (len(a) + len(b) - x):
                    parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return [(len(sets[i]), least[root(i)]) for i in range(len(ids))]


class Trigrams:
    """Interpolated trigrams with absolute discounts from counts of counts, by dictionaries."""

    def __init__(self, docs):
        self.c = Counter(w for d in docs for w in d)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.two = Counter((a, b) for d in docs for a, b in zip(["<s>", *d], d, strict=False))
        self.three = Counter((a, b, c) for d in docs for a, b, c in zip(["<s>", *d], d, d[1:], strict=False))
        self.d = []
        for grams in (self.two, self.three):
            n1, n2 = (sum(x == k for x in grams.values()) for k in (1, 2))
            self.d.append(n1 / (n1 + 2 * n2) if n1 else 0.5)
        self.followed = {}
        for grams in (self.two, self.three):
            for g, x in grams.items():
                big, kinds = self.followed.get(g[:-1], (0, 0))
                self.followed[g[:-1]] = big + x, kinds + 1

    def p1(self, w):
        return (self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, history, w):
        if not history:
            return self.p1(w)
        lower = self.p(history[1:], w)
        if history not in self.followed:
            return lower
        big, kinds = self.followed[history]
        d, grams = (self.d[0], self.two) if len(history) == 1 else (self.d[1], self.three)
        return max(grams[*history, w] - d, 0) / big + d * kinds / big * lower

    def score(self, tokens):
        seen = ["<s>", *tokens]
        return sum(math.log10(self.p(tuple(seen[max(0, i - 1) : i + 1]), w)) for i, w in enumerate(tokens))
