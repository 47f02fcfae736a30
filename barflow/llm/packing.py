"""Packing into sequences: shortest-pack-first over the length histogram.

1. Every text is encoded (a long one by overlapping chunks, see token_counts), closed with the end id, and cut at multiples of
   `size`; a piece is a row with its length.
2. The histogram of piece lengths (at most `size` numbers, whatever the corpus) goes to the driver. Lengths are placed from
   the longest to the shortest, each into the shortest packs with room; packs of equal content are one pattern with a count,
   and a placement that takes only some of a pattern's packs splits it. A length adds at most one pattern, so there are at
   most `size` patterns, and a pattern holds at most sqrt(2 * size) distinct lengths: the table of placements is bounded.
3. Pieces are ranked within their length: dealt to salts by a row number, counted by (salt, length), offset by a running sum
   over the salts, and numbered within each (salt, length), so that one length, or one id, with a third of all pieces spreads
   over many tasks.
4. A piece finds its placement by (length, rank), and with it its sequence and its offset there.

A NULL or empty text is the end id alone. Repeated rows are packed each on its own. A sequence is padded to `size` unless its
length is a power of two.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import batch, id_type, mapped, narrowed, written
from barflow.llm.token_counts import library

#: Tokens of a sequence.
SIZE = 4096
#: The id that closes every document.
END = 2
#: Pieces of one length that are numbered together, about.
PER_SALT = 200


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(packs, [(length, copies in a pack)]) for each pattern, by shortest-pack-first with lengths from longest to shortest."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    sums: list[int] = []

    def put(total: int, packs: int, runs: list[tuple[int, int]]) -> None:
        at = open_.setdefault(total, [])
        if not at:
            heapq.heappush(sums, total)
        at.append((packs, runs))

    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left > 0:
            if not sums or sums[0] > size - n:
                put(n, left, [(n, 1)])
                break
            total = sums[0]
            packs, runs = open_[total].pop()
            if not open_[total]:
                heapq.heappop(sums)
            if packs > left:
                put(total, packs - left, runs)
                packs = left
            room = (size - total) // n
            ahead = (sums[0] - total) // n if sums else room  # copies until another pack is shorter
            copies = max(1, min(room, ahead, left // packs))
            last = runs[-1]
            runs = [*runs[:-1], (n, last[1] + copies)] if last[0] == n else [*runs, (n, copies)]
            put(total + n * copies, packs, runs)
            left -= packs * copies
    return [p for total in sorted(open_, reverse=True) for p in open_[total]]


def placements(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Arrays sorted by (length, first rank): for pieces of this length from this rank on, sequence, offset and copies in a pack."""
    rows, rank, base = [], {}, 0
    for packs, runs in found:
        offset = 0
        for n, copies in runs:
            first = rank.get(n, 0)
            rows.append((n, first, base, offset, copies))
            rank[n] = first + packs * copies
            offset += n * copies
        base += packs
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "offset", "copies"), cols, strict=True))


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens for every piece of every text, and its ids (packed 32-bit) if asked for."""
    schema = f"doc_id {id_type(docs, id_col)},start long,length long,ids_crc32 long,doc_tokens long" + ",ids binary" * with_ids
    tail = np.array([end], "<u4").tobytes()

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        lib = library(tokenizer)
        rows, at = [], []
        for k, text in enumerate(part.column("text").to_pylist()):
            ids = lib.packed(text) + tail
            total = len(ids) // 4
            for a in range(0, total, size):
                own = ids[4 * a : 4 * (a + size)]
                rows.append((a, len(own) // 4, zlib.crc32(own), total, *([own] if with_ids else [])))
                at.append(k)
        return batch(schema, list(zip(*rows, strict=True)), part.column("doc_id").take(pa.array(at)))

    return mapped(narrowed(docs, id_col, text_col), kernel, schema)


def ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds rank: 0, 1, 2 … within each length, over all rows, which have a number `row`. A length has as many salts as its number of pieces asks for."""
    spread = rows.sparkSession.createDataFrame([(n, -(-c // PER_SALT)) for n, c in histogram.items()], "length long, salts long")  # at most `size` rows
    rows = rows.join(F.broadcast(spread), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).drop("salts")
    sizes = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("row")
    return rows.withColumn("at", F.row_number().over(within) - 1).join(first, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at")).drop("salt", "before", "at")


def packing(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False
) -> DataFrame:
    """Every piece with its sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    # numbered before they are written, so that a number stays with its row and repeated rows are dealt apart
    rows = written(pieces(docs, tokenizer, id_col, text_col, size, end, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `size` rows
    place = placements(patterns(histogram, size))
    shared = docs.sparkSession.sparkContext.broadcast(place)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = f"doc_id {id_type(docs, id_col)}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", sequence_id long, offset long"

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        key = (p["length"] << 44) | p["first"]
        for part in batches:
            if not part.num_rows:
                continue
            n, rank = part.column("length").to_numpy(), part.column("rank").to_numpy()
            k = np.searchsorted(key, (n << 44) | rank, "right") - 1
            i = rank - p["first"][k]
            sequence, offset = p["sequence"][k] + i // p["copies"][k], p["offset"][k] + (i % p["copies"][k]) * n
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked(rows, histogram).select(*names, "rank").mapInArrow(place_all, schema)


def sequences(packed: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """Token rows from packing(with_ids=True): sequence_id, ids (array, padded unless a power of two), and the documents' starts in it.

    A group has at most `size` tokens, so it always fits a task.
    """
    cells = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for parts in part.column("parts").to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                n = len(ids)
                if n & (n - 1):
                    ids = np.concatenate((ids, np.full(size - n, pad, np.int32)))
                rows.append((ids.tolist(), [p["offset"] for p in parts]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [part.column("sequence_id"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                    names=["sequence_id", "ids", "starts"],
                )

    return cells.mapInArrow(run, "sequence_id long, ids array<int>, starts array<long>")
