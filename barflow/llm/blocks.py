"""Blocks of documents, and questions that blocks ask of the whole corpus.

A block is a row that holds some megabytes of documents (all their columns, as compressed Arrow). Its id is fixed once the
blocks are written, so a block is the same thing in every later job, whatever tasks are retried. Operators that need counts
over all documents let each block ask once for each distinct key it holds: the questions go to a shard by key, the shard sees
every block's question for its keys and answers, and the answers go back to the block. A key that is everywhere costs one
entry for each block, never one for each occurrence, so no task holds a hot group; and no table of keys is ever broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import shared_dir, ship, trim

#: Bytes of text, other columns and ROW_BYTES a row in a block, about (a longer row is a block of its own).
BLOCK_BYTES = 4 << 20
#: What a row costs beside its columns.
ROW_BYTES = 64
#: Compression of a block, which is written once and sent to its answers.
LEVEL = 5
#: Block bytes that one task works on.
TASK_BYTES = 16 << 20


def _packed(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(parts).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def opened(rows: bytes) -> pa.Table:
    """The documents of a block."""
    return pa.ipc.open_stream(rows).read_all().combine_chunks()


def texts(docs: pa.Table, column: str = "text") -> list[bytes]:
    return [t or b"" for t in docs.column(column).cast(pa.binary()).to_pylist()]


def blocked(df: DataFrame, text_col: str = "text", target: int = BLOCK_BYTES) -> DataFrame:
    """Writes df as blocks: block (long), size (text bytes), n (rows), rows (binary). No shuffle."""
    import uuid

    spark = df.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        size = count = weight = 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, count, weight
            n = sum(b.num_rows for b in held)
            row = pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + count]), pa.array([size], pa.int64()), pa.array([n], pa.int64()), pa.array([_packed(held)], pa.binary())],
                names=["block", "size", "n", "rows"],
            )
            held, size, weight, count = [], 0, 0, count + 1
            return row

        for part in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(part.column(text_col)), 0), np.int64)
            # the other columns count with their mean; their rows come in batches of bounded size
            other = ROW_BYTES + max(0, part.nbytes - int(sizes.sum())) // max(1, part.num_rows)
            start = 0
            for i, n in enumerate(sizes.tolist()):
                if weight and weight + n + other > target:
                    if i > start:
                        held.append(part.slice(start, i - start))
                    start = i
                    yield out()
                size += n
                weight += n + other
            if start < part.num_rows:
                held.append(part.slice(start))
        if held:
            yield out()
        trim()

    path = f"{shared_dir(spark)}/barflow/blocks-{uuid.uuid4().hex}"
    df.mapInArrow(run, "block long, size long, n long, rows binary").write.option("compression", "none").parquet(path)
    from barflow.llm import common

    common._paths.append(path)
    return spark.read.schema("block long, size long, n long, rows binary").parquet(path)


def volume(blocks: DataFrame) -> int:
    """Text bytes in these blocks, and what their rows cost."""
    return blocks.agg(F.sum(F.col("size") + F.col("n") * ROW_BYTES)).first()[0] or 0


def shards(size: int, per_shard: int) -> int:
    """Number of shards or tasks for so many text bytes: one for `per_shard` of them, and as many as there are cores while blocks are as many."""
    session = SparkSession.getActiveSession()
    cores = session.sparkContext.defaultParallelism if session else 1
    return max(1, -(-size // per_shard), min(cores, -(-size // BLOCK_BYTES)))


def shard_slices(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Shards of sorted unsigned 64-bit keys: contiguous ranges of the key space, empty ones left out."""
    of = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    if len(of):
        at = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield int(of[a]), slice(a, b)


ASKED = "block long, shard int, payload binary"


def asked(blocks: DataFrame, ask: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Questions of every block: ask(documents) gives (shard, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for block, rows in zip(part.column("block").to_pylist(), part.column("rows"), strict=True):
                yield rows_of(block, ask(opened(rows.as_py())))
        trim()

    return blocks.select("block", "rows").mapInArrow(run, ASKED)


def rows_of(block: int, found: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    shard, payload = [], []
    for s, p in found:
        shard.append(s)
        payload.append(p)
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(shard), pa.int64()), pa.array(shard, pa.int32()), pa.array(payload, pa.binary())], names=["block", "shard", "payload"]
    )


def answered(questions: DataFrame, answer: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]], n: int) -> DataFrame:
    """Answers of all `n` shards: answer([(block, payload)]) gives (block, payload). A shard is a bounded range of keys.

    There are as many tasks as shards, whatever the session's number of shuffle partitions.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        got = sorted(zip(rows.column("block").to_pylist(), rows.column("payload").to_pylist(), strict=True))
        block, payload = [], []
        for b, p in answer(got):
            block.append(b)
            payload.append(p)
        trim()
        return pa.table({"block": pa.array(block, pa.int64()), "shard": pa.array([shard] * len(block), pa.int32()), "payload": pa.array(payload, pa.binary())})

    return questions.repartition(n, "shard").groupBy("shard").applyInArrow(run, ASKED)


def told(blocks: DataFrame, size: int, answers: DataFrame, use: Callable[[int, pa.Table, list[tuple[int, bytes]]], pa.Table], schema: object) -> DataFrame:
    """use(block, documents, [(shard, payload)] in the order of shards) for every block, with the answers it got.

    `size` is the volume of the blocks; it sets the number of tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    empty = to_arrow_schema(schema).empty_table()

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        got = sorted(zip(right.column("shard").to_pylist(), right.column("payload").to_pylist(), strict=True)) if right.num_rows else []
        out = use(key[0].as_py(), opened(left.column("rows")[0].as_py()), got)
        trim()
        return out

    n = shards(size, TASK_BYTES)
    left, right = (x.repartition(n, "block").groupBy("block") for x in (blocks.select("block", "rows"), answers))
    return left.cogroup(right).applyInArrow(run, schema)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one payload."""
    raw = []
    for a in arrays:
        data = np.ascontiguousarray(a).tobytes()
        raw.append(len(data).to_bytes(8, "little") + data)
    return b"".join(raw)


def unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(payload[at : at + 8], "little")
        out.append(np.frombuffer(payload, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def deflated(payload: bytes) -> bytes:
    return len(payload).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(payload, asbytes=True)


def inflated(payload: bytes) -> bytes:
    return pa.Codec("zstd").decompress(payload[8:], int.from_bytes(payload[:8], "little"), asbytes=True)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as byte planes of their differences; the empty planes vanish when the shuffle compresses."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(data: np.ndarray) -> np.ndarray:
    planes = np.ascontiguousarray(data.reshape(8, -1).T)
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64)


def chosen(blocks: DataFrame, size: int, rows: DataFrame, schema: object) -> DataFrame:
    """The documents of blocks at given rows: `rows` has block and at (place in the block)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return opened(left.column("rows")[0].as_py()).take(pa.array(sorted(right.column("at").to_pylist())))

    n = shards(size, TASK_BYTES)
    left, right = (x.repartition(n, "block").groupBy("block") for x in (blocks.select("block", "rows"), rows.select("block", "at")))
    return left.cogroup(right).applyInArrow(run, schema)
