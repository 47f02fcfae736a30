"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams (words; pairs of words; one to three word shapes, where a shape keeps a word's letter case, digits and
signs and says whether the word repeats the one before) are scaled by the classes' log-count ratios and brought to length 1.
A linear hinge-loss model is fitted to them by dual coordinate descent. Its margin becomes a score between 0 and 1 through a
logistic curve fitted to margins of two halves, each from the model of the other half.

Labels are used from rows whose crc32 of the id (as text) modulo `folds` is not 0. The model is fitted on at most SAMPLE of
them, those of the least hash of the id, and on no more of these, in that order, than have SAMPLE_BYTES of indicators together (a
single one beyond it is left to itself); every document is scored on its whole text. Language, source, id and labels are never
inputs. NULL and empty texts have no n-gram; their score is that of the bias alone. Without labels of both classes the score is
the share of label 1, or 0.5 without labels. Labels other than 0 and 1, and labels without id, are left out. An id with labels 0
and 1 counts as 0; an id with several texts is one training row, that of the least indicators. Repeated rows are scored each on
its own, with equal scores; a long text is scored whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import batch, crc_mod, crc_mod_col, id_type, mapped, narrowed, space_words, written

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 6000
#: Bytes of their indicators (4 for each) that go to the driver, at most.
SAMPLE_BYTES = 64 << 20
#: One labelled row in so many is held out.
FOLDS = 5
#: Score from which a document is predicted good.
CUT = 0.3
#: Indicator space: 2 ** BITS.
BITS = 18
#: Smoothing of the counts, bound of the dual variables, passes of the descent.
ALPHA, COST, PASSES = 1.0, 1.0, 12
_MEMO = 300_000
_MASK = np.uint64((1 << BITS) - 1)
_MUL = np.array([pow(0xA0761D6478BD642F, j + 1, 1 << 64) for j in range(8)], dtype=np.uint64)
_CAPS, _SMALL, _DIGIT = re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[a-zß-öø-ÿ]+"), re.compile("[0-9]+")


class _Words(dict):
    """Word -> hash of the word (upper half) and of its shape (lower half)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        shape = _DIGIT.sub("0", _SMALL.sub("a", _CAPS.sub("A", word.decode("utf-8", "replace"))))
        value = self[word] = (xxhash.xxh32_intdigest(word) << 32) | xxhash.xxh32_intdigest(shape)
        return value


_words = _Words()


def indicators(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, indicator) pairs, sorted."""
    each = [space_words(t) for t in docs]
    sizes = np.array([len(w) for w in each], np.int64)
    flat = np.empty(int(sizes.sum()), np.uint64)
    at = 0
    for w in each:
        flat[at : at + len(w)] = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
        at += len(w)
    doc = np.repeat(np.arange(len(docs), dtype=np.uint64), sizes)
    word, shape = flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)
    same = np.zeros(len(flat), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shape = shape + same.astype(np.uint64) * _MUL[7]
    keys = []
    for salt, (x, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.full(m, salt, np.uint64) * _MUL[6]
        for j in range(n):
            h += x[j : j + m] * _MUL[j]
        h ^= h >> np.uint64(31)
        h *= _MUL[5]
        h >>= np.uint64(64 - BITS)
        inside = doc[:m] == doc[n - 1 :]
        keys.append(((doc[:m] << np.uint64(BITS)) | h)[inside])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.sort(np.concatenate(keys))
    k = k[np.concatenate(([True], k[1:] != k[:-1]))] if len(k) else k
    return (k >> np.uint64(BITS)).astype(np.int64), (k & _MASK).astype(np.int64)


class Model:
    """Weights of scaled indicators, bias, and the logistic curve."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, a: float, b: float):
        self.square = (ratio * ratio).astype(np.float32)
        self.weight = (ratio * weight).astype(np.float32)
        self.bias, self.a, self.b = bias, a, b

    def margins(self, docs: list[bytes]) -> np.ndarray:
        doc, x = indicators(docs)
        n = len(docs)
        norm = np.sqrt(np.bincount(doc, weights=self.square[x], minlength=n))
        return np.bincount(doc, weights=self.weight[x], minlength=n) / np.maximum(norm, 1e-12) + self.bias

    def scores(self, docs: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(docs) + self.b, -30, 30)))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Hinge loss by dual coordinate descent: for one row at a time the best step of its dual variable within [0, cost]."""
    x = [ratio[r] for r in rows]
    x = [v / max(np.sqrt(v @ v), 1e-12) for v in x]
    square = np.array([v @ v + 1 for v in x])  # the bias is an indicator that always stands
    w, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), cost)
            step = (new - dual[i]) * y[i]
            if step:
                dual[i] = new
                w[rows[i]] += step * x[i]
                bias += step
    return w, bias


def _ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    size = 1 << BITS
    p, q = (ALPHA + np.bincount(np.concatenate([r for r, s in zip(rows, y, strict=True) if s == c] or [np.zeros(0, np.int64)]), minlength=size) for c in (1, -1))
    return np.log((p / p.sum()) / (q / q.sum()))


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the class on the margin, by Newton steps, with targets drawn in by the class sizes."""
    pos, neg = np.count_nonzero(y > 0), np.count_nonzero(y < 0)
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model for rows of distinct indicators and labels 0 or 1."""
    y = np.where(labels > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-6), 1 - 1e-6)
        zero = np.zeros(1 << BITS)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    margin = np.zeros(len(y))
    half = np.arange(len(y)) % 2
    for k in (0, 1):
        own, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
        if len(set(y[own].tolist())) < 2:
            own = np.arange(len(y))
        some = [rows[i] for i in own]
        ratio = _ratio(some, y[own])
        w, bias = descend(some, y[own], ratio)
        for i in other:
            v = ratio[rows[i]]
            margin[i] = w[rows[i]] @ v / max(np.sqrt(v @ v), 1e-12) + bias
    a, b = _curve(margin, y)
    ratio = _ratio(rows, y)
    w, bias = descend(rows, y, ratio)
    return Model(ratio, w, bias, a, b)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, sample: int, most: int = SAMPLE_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicators and labels of at most `sample` labelled rows outside the held-out fold, in the order of the id's hash."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    own = own.where(crc_mod_col("doc_id", folds) != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = narrowed(docs, id_col, text_col).join(F.broadcast(own), "doc_id")  # at most `sample` ids

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        doc, x = indicators(texts)
        cut = np.split(x.astype("<i4"), np.searchsorted(doc, np.arange(1, len(texts))))
        return batch(schema, [part.column("label").to_pylist(), [c.tobytes() for c in cut]], part.column("doc_id"))

    schema = f"doc_id {id_type(docs, id_col)},label int,x binary"
    found = mapped(text.select("doc_id", "label", "text"), kernel, schema).groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x"))
    found = written(found, "training")
    sizes = found.select("doc_id", F.octet_length("x").alias("n")).collect()  # at most `sample` rows
    ids, total = [], 0
    for r in sorted(sizes, key=_rank):
        total += r["n"]
        if ids and total > most:
            break
        ids.append((r["doc_id"],))
    if not ids:
        return [], np.zeros(0, np.int64)
    own = docs.sparkSession.createDataFrame(ids, found.select("doc_id").schema)
    got = sorted(found.join(F.broadcast(own), "doc_id").collect(), key=_rank)  # `most` bytes at most, or one row
    return [np.frombuffer(r["x"], "<i4") for r in got], np.array([r["label"] for r in got], np.int64)


def _rank(row) -> tuple[int, str]:
    return xxhash.xxh64_intdigest(str(row["doc_id"])), str(row["doc_id"])


def quality_classifier(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = FOLDS, sample: int = SAMPLE, cut: float = CUT,
) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    model = fit(*training_rows(docs, labels, id_col, text_col, label_col, folds, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 2 ** BITS numbers
    schema = f"doc_id {id_type(docs, id_col)},held_out boolean,score double,predicted int"

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.scores(part.column("text").to_pylist())
        held = [crc_mod(i, folds) == 0 for i in part.column("doc_id").to_pylist()]
        return batch(schema, [held, score, (score >= cut).astype(np.int32)], part.column("doc_id"))

    return mapped(narrowed(docs, id_col, text_col), kernel, schema)
