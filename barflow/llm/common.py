"""What the operators of this subpackage share: reading tables, shared scratch space, Arrow kernels and byte-level words.

Conventions that hold for every operator unless its docstring says otherwise:

* a NULL text counts as the empty text, every input row gives its own output row (repeated rows included);
* a NULL id is carried through; where an id decides a fold it counts as the empty string;
* only the named columns are read, so further columns may have any name;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.session import ship as ship_code

#: Text bytes that a kernel works on at once, at most (a longer text is taken alone).
SLICE_BYTES = 2 << 20

#: Bytes that end a word of kind "space": blank, tab, line feed, vertical tab, form feed, carriage return.
#: bytes.split() without arguments cuts at exactly these six.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_ALNUM = bytearray(b" " * 256)
for _b in _KEPT:
    _ALNUM[_b] = _b
for _b in range(0x41, 0x5B):
    _ALNUM[_b] = _b + 32
_ALNUM = bytes(_ALNUM)


def space_words(text: bytes) -> list[bytes]:
    """Maximal runs without ASCII white space."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and takes maximal runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_ALNUM).split()


class _WordHashes(dict):
    """64-bit hash of a word, computed when first asked for; emptied when full, so a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


#: Words whose hashes a worker keeps; one memory for all operators, since workers are reused.
_MEMO = 300_000
word_hashes = _WordHashes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; the path may be in any store that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between Spark and Python, unless the session says otherwise than Spark's default.
ARROW_BYTES = "8m"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, so that workers anywhere can import it.

    Arrow batches are kept small where the session has Spark's default, since several operators run in one executor.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64MB", "64m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    ship_code(spark)


def trim() -> None:
    """Gives freed memory of a Python worker back to the host: workers are reused by later operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on one host."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "barflow-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors, is computed once.

    The folder stays as long as results may read it; drop_written() removes all of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barflow/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


_paths: list[str] = []


def drop_written(spark: SparkSession) -> None:
    """Removes every table of written(); results that still read them fail afterwards."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _paths:
        path = jvm.org.apache.hadoop.fs.Path(_paths.pop())
        path.getFileSystem(conf).delete(path, True)


def crc_mod(id_: object, m: int) -> int:
    """crc32 of an id's text, modulo m; a NULL id counts as the empty text."""
    return zlib.crc32(b"" if id_ is None else str(id_).encode()) % m


def crc_mod_col(id_col: str, m: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns with fixed names: doc_id as it is, text as UTF-8 bytes without NULL."""
    ship(docs.sparkSession)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary")).alias("text")
    )


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the bytes in `column` stay under `most`, or a row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column)
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def mapped(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """Applies a function of one bounded Arrow batch to all rows, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=most):
            out = kernel(part)
            if out is not None and out.num_rows:
                yield out
        trim()

    return df.mapInArrow(run, schema)


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.select(id_col).schema[0].dataType.simpleString()


def batch(schema: str, columns: list, ids: pa.Array | None = None) -> pa.RecordBatch:
    """An Arrow batch for a DDL schema of simple types; `ids`, if given, is the first column as it is."""
    names, arrays = [], []
    if ids is not None:
        names.append("doc_id")
        arrays.append(ids)
        schema = schema.split(",", 1)[1]
    for field, values in zip(schema.split(","), columns, strict=True):
        name, kind = field.split()
        names.append(name)
        arrays.append(pa.array(values, type=_TYPES[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=names)


_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
}
