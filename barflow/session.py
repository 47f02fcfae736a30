"""A session with the settings that the operators rely on, and this package on its workers."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_stored: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, so that workers anywhere can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # an installed archive is on the workers' path already
        path = Path(tempfile.mkdtemp(prefix="ship")) / f"{root.name}_src.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """UTC days, adaptive execution with skew handling, Arrow transfer."""
    builder = SparkSession.builder.master(master).appName("barflow")
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where all runs on one host and the setting is absent, a folder of this host."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/barflow-stored"
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; drop_stored() removes it."""
    path = f"{shared_folder(spark)}/stages/{label}-{uuid.uuid4().hex}"
    _stored.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df below spark.checkpoint.dir and reads it again: computed once, lineage cut, lost executors cost nothing of it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _code() -> str:
    """Digest of this package's sources: a stage of other code is another stage."""
    root = Path(__file__).resolve().parent
    digest = hashlib.sha256()
    for p in sorted(root.rglob("*.py")):
        digest.update(p.read_bytes())
    return digest.hexdigest()


def fingerprint(df: DataFrame, params: object = ()) -> str | None:
    """Digest of what a frame is computed from: its plan, its input files with their times and sizes, `params` and this package's code.

    The plan does not show what Python functions close over; that is what `params` are for. None for a frame with rows from memory,
    whose plan does not show them.
    """
    spark = df.sparkSession
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    digest = hashlib.sha256(f"{_code()}|{params!r}|{df.schema.json()}".encode())
    fields = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(fields, None)
    spark.conf.set(fields, "100000")  # a plan that is cut short could be taken for another
    try:
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        spark.conf.unset(fields) if before is None else spark.conf.set(fields, before)
    if any(leaf in plan for leaf in ("LocalRelation", "LogicalRDD", "ExternalRDD", "InMemoryRelation", "StreamingRelation")):
        return None
    digest.update(plan.encode())
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        digest.update(f"|{name}|{status.getModificationTime()}|{status.getLen()}".encode())
    return digest.hexdigest()[:32]


def kept(df: DataFrame, label: str, params: object = ()) -> DataFrame:
    """Like stored(), below a path by fingerprint: a later run over the same files, parameters and code reads it instead of computing it.

    A stage is written aside and renamed when it is whole, so that a broken run leaves none. prune() removes old ones. A frame with
    rows from memory is stored for this run alone.
    """
    spark, found = df.sparkSession, fingerprint(df, params)
    if found is None:
        return stored(df, label)
    path = f"{shared_folder(spark)}/kept/{label}/{found}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(conf)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        aside = f"{shared_folder(spark)}/kept/{label}/.{uuid.uuid4().hex}"
        df.write.parquet(aside)
        source = jvm.org.apache.hadoop.fs.Path(aside)
        if not fs.rename(source, final) or fs.exists(jvm.org.apache.hadoop.fs.Path(final, source.getName())):
            fs.delete(jvm.org.apache.hadoop.fs.Path(final, source.getName()), True)  # another run was first: its stage is the same
            fs.delete(source, True)
    return spark.read.schema(df.schema).parquet(path)


def prune(spark: SparkSession, newest: int = 0) -> int:
    """Removes kept stages but for the `newest` of each label; how many went."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/kept")
    fs, gone = root.getFileSystem(conf), 0
    if not fs.exists(root):
        return 0
    for label in fs.listStatus(root):
        for old in sorted(fs.listStatus(label.getPath()), key=lambda x: -x.getModificationTime())[newest:]:
            gone += fs.delete(old.getPath(), True)
    return gone


def drop_stored(spark: SparkSession) -> None:
    """Removes the tables that stored() wrote, once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    while _stored:
        path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
