"""Hard-negative mining: a full sort of every anchor's integer scores, read between two limits for each positive.

Vectors are made whole numbers, so a score is exact and ties are real ties. Rows are written once as blocks of bounded size, anchors
as smaller blocks; each pair of an anchor block and a row block is a cell that one task works on alone. In a cell the scores are one
matrix product. The first pass takes each anchor's best rows of its own label, the second sorts all scores of an anchor (by score,
then by id), finds each positive's upper limit by binary search and reads the next `k` rows of another label above the lower limit.
Of a sorted run no more than its first `k` rows between the limits can be among the first `k` of all, so cells hand on that many and
the runs of an anchor are merged by rank. Nothing is broadcast and no task sees more than one cell at a time.

Rows without label or vector, and rows with a component that is NULL, NaN or infinite, take no part. A NULL id is no anchor, is
nobody's equal and comes last among ties. Rows that share the anchor's id are neither its positives nor its negatives; rows repeated
otherwise count each. Every repeated anchor row gives its own result. Components missing at the end of a shorter vector are 0. Scores
are exact whole numbers at any magnitude while sorted in a block, and beyond BIG count as BIG. Anchors without positives or without
rows between the limits give no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import ship, slices, trim, written

#: Rows of a block at most, and bytes of its vectors.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 16 << 20
#: Anchors of a block at most.
ANCHORS = 1024
#: Blocks for each core, so that small tables use all of them.
SPREAD = 2
#: Scores of a cell worked on at once.
CELLS = 1 << 21
#: Magnitude at which scores end.
BIG = 1 << 56

_BLOCK = "b long, n int, ids binary, nulls binary, labels array<string>, kind string, matrix binary"


def _matrix(vectors: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) as the narrowest whole numbers that hold all; as doubles beyond 32 bits."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    most = float(np.abs(out).max(initial=0.0))
    return out.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def _blocks(rows: DataFrame, count: int, scale: float) -> DataFrame:
    """Deals rows evenly to `count` blocks; a block's number is that of its partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts).combine_chunks()
            ids = t.column("id").combine_chunks()
            matrix = _matrix(t.column("v").combine_chunks(), scale)
            columns = [
                [TaskContext.get().partitionId()], [t.num_rows], [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
                [ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], [t.column("label").to_pylist()], [matrix.dtype.str], [matrix.tobytes()],
            ]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["b", "n", "ids", "nulls", "labels", "kind", "matrix"])
        trim()

    return rows.repartition(count).mapInArrow(pack, _BLOCK)


class _Block:
    """A block opened: ids, which of them are NULL, labels as codes, vectors."""

    def __init__(self, row: dict, side: str) -> None:
        n = row[f"{side}n"]
        self.ids = np.frombuffer(row[f"{side}ids"], np.int64)
        self.nulls = np.frombuffer(row[f"{side}nulls"], np.uint8).astype(bool)
        names, self.labels = np.unique(np.array(row[f"{side}labels"], dtype=object), return_inverse=True)
        self.names, self.codes = names, {x: i for i, x in enumerate(names)}
        self.matrix = np.frombuffer(row[f"{side}matrix"], row[f"{side}kind"]).reshape(n, -1)
        self.most = float(np.abs(self.matrix.astype(np.float64)).max(initial=0.0))


def _scores(a: _Block, r: _Block, some: slice) -> np.ndarray:
    """Exact inner products of some anchors with all rows of a block: doubles while they hold every whole number, else wider."""
    width = min(a.matrix.shape[1], r.matrix.shape[1])
    x, y = a.matrix[some, :width], r.matrix[:, :width].T
    bound = a.most * r.most * max(width, 1)
    if bound < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    if bound < 1 << 62:
        return np.clip(x.astype(np.int64) @ y.astype(np.int64), -BIG, BIG)
    whole = lambda m: np.array([[int(c) for c in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(x) @ whole(y), -BIG, BIG).astype(np.int64)


_TOP = "a long, at int, anchor_id long, id long, score long"
_READ = "a long, at int, anchor_id long, p int, positive_id long, positive_score long, id long, score long"


def _out(columns: list[list], names: str) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64() if k == "long" else pa.int32()) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, _Block, _Block]]:
    """The cells of a task, one after another; a row block that comes again is not opened again."""
    last, block = None, None
    for part in slices(batches, column="r_matrix", most=1):
        for row in part.to_pylist():
            if row["r_b"] != last:
                last, block = row["r_b"], _Block(row, "r_")
            yield row, _Block(row, "a_"), block
    trim()


def _runs(a: _Block, r: _Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor of a cell: its place, its scores, and the block's rows whose id is not the anchor's."""
    step = max(1, CELLS // max(len(r.ids), 1))
    for start in range(0, len(a.ids), step):
        found = _scores(a, r, slice(start, start + step))
        for i, scores in enumerate(found, start):
            yield i, scores, (r.ids != a.ids[i]) | r.nulls


def _sorted(rows: np.ndarray, scores: np.ndarray, r: _Block) -> np.ndarray:
    """Rows by falling score, ties by id, NULL ids last."""
    return rows[np.lexsort((r.ids[rows], r.nulls[rows], -scores[rows]))]


def _positives(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, a, r in _cells(batches):
            out: list[list] = [[] for _ in range(5)]
            for i, scores, other in _runs(a, r):
                same = np.flatnonzero(other & (r.labels == r.codes.get(a.names[a.labels[i]], -1)))
                if len(same) > 4 * most:  # all that reach the score of the last place, then in order
                    same = same[scores[same] >= np.partition(scores[same], -most)[-most]]
                first = _sorted(same, scores, r)[:most]
                ids = [None if r.nulls[j] else int(r.ids[j]) for j in first]
                for column, values in zip(out, ([row["a_b"]] * len(first), [i] * len(first), [int(a.ids[i])] * len(first), ids, scores[first].tolist()), strict=True):
                    column += values
            yield _out(out, _TOP)

    return run


def _negatives(k: int, lower: int, upper: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, a, r in _cells(batches):
            wanted: dict[int, list] = {x["at"]: x["found"] for x in row["positives"]}
            out: list[list] = [[] for _ in range(8)]
            for i, scores, other in _runs(a, r):
                if i not in wanted:
                    continue
                order = _sorted(np.flatnonzero(other & (r.labels != r.codes.get(a.names[a.labels[i]], -1))), scores, r)
                falling = -scores[order]
                for x in wanted[i]:
                    high, low = upper * x["score"] // 100, -(-lower * x["score"] // 100)
                    start = int(np.searchsorted(falling, -high, "left"))
                    stop = min(start + k, int(np.searchsorted(falling, -low, "right")))
                    for j in order[start:stop]:
                        values = (row["a_b"], i, int(a.ids[i]), x["p"], x["id"], x["score"], None if r.nulls[j] else int(r.ids[j]), int(scores[j]))
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
            yield _out(out, _READ)

    return run


def _first(rows: DataFrame, most: int, rank: str, *keys: str) -> DataFrame:
    """The first `most` rows of each key, by falling score and then by id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = 5, k: int = 10, lower: int = 30, upper: int = 90, scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: which rows are anchors. A positive's negatives are the first `k` rows of another label whose score is from `lower` to
    `upper` hundredths of the positive's.
    """
    spark = rows.sparkSession
    ship(spark)
    number = F.col("v").cast("array<double>")
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor")).where(
        F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall(number, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    )
    usable = written(usable, "negatives-rows")
    n, anchors, width = usable.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("v"))).first()
    held = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(width or 0, 1))))
    cores = spark.sparkContext.defaultParallelism * SPREAD
    parts = max(-(-n // held), min(cores, -(-n // 256)), 1)
    side = lambda df, s: df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns))
    blocks = side(written(_blocks(usable.drop("is_anchor"), parts, scale), "negatives-blocks"), "r").repartition(parts, "r_b")
    marked = side(written(_blocks(usable.where("is_anchor").drop("is_anchor"), max(-(-anchors // ANCHORS), 1), scale), "negatives-anchors"), "a")

    def cells(of: DataFrame) -> DataFrame:
        return of.withColumn("r_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).repartition(parts, "r_b").join(blocks.hint("merge"), "r_b")

    best = _first(cells(marked).mapInArrow(_positives(positives), _TOP), positives, "p", "a", "at")
    found = best.groupBy("a", "at").agg(F.sort_array(F.collect_list(F.struct("p", "id", "score"))).alias("found"))
    found = written(found.groupBy(F.col("a").alias("a_b")).agg(F.collect_list(F.struct("at", "found")).alias("positives")), "negatives-positives")  # at most ANCHORS of `positives` each
    read = cells(marked.join(found, "a_b")).mapInArrow(_negatives(k, lower, upper), _READ)
    return _first(read, k, "rank", "a", "at", "p").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
