"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read and write.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, local mode) is a local temporary folder
    made, once per session.
    """
    known = spark.conf.get(CHECKPOINT_KEY, None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
        known = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set(CHECKPOINT_KEY, known)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(known)
    return known


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a compressed columnar table in the shared folder and read it back.

    Cuts lineage and survives the loss of executors. The folder is this query's own; the session removes nothing, the
    cluster's owner clears the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexmill/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``materialise`` with aggregates of the rows observed as they are written, at no further job."""
    seen = Observation()
    return materialise(df.observe(seen, *(c.alias(k) for k, c in counts.items()))), seen.get


def local_table(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A small table from rows on the driver, by way of Arrow: unlike plain lists, no Python worker reads it."""
    values = list(zip(*rows)) if rows else [()] * len(columns)
    return spark.createDataFrame(pa.table([pa.array(v, t) for v, t in zip(values, columns.values())], names=list(columns)))


#: Bytes a core under which an input counts as small.
SMALL_INPUT = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session has cores, where it is small and comes from fewer files.

    For work that is heavy a row. It is decided from the plan's statistics and files, nothing is run; large tables pass unchanged, so
    the shuffle this costs is bounded.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_INPUT and len(df.inputFiles()) < cores else df


class Files:
    """Small files of the shared file system, by way of Hadoop's client."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def publish(self, name: str, content: bytes) -> None:
        """A file that appears whole; fails if it is there already."""
        if self.fs.exists(self._path(name)):
            raise FileExistsError(name)
        folder, _, last = name.rpartition("/")
        temporary = self._path(f"{folder}/.{last}.{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, False)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        if not self.fs.rename(temporary, self._path(name)):
            self.fs.delete(temporary, False)
            raise FileExistsError(name)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def files_of(spark: SparkSession, root: str) -> Files:
    return Files(spark, root)


#: Part of the names of maintained tables; it is raised when what builds them changes.
FORMAT = 1


def maintained(source: DataFrame, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """``build(source)`` as a table kept in the shared folder, made when it is first read; None if ``source`` is anything but a plain read of files.

    The table belongs to the files it was made from, by name, length and time of change: when these change, another is made. It is written aside and renamed
    when whole, so sessions that build it at once leave one of them.
    """
    spark = source.sparkSession
    if source._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return None
    inputs = sorted(source.inputFiles())
    if not inputs:
        return None
    state = hashlib.sha256()
    for f in inputs:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        state.update(f"{f} {status.getLen()} {status.getModificationTime()}\n".encode())
    folder = f"{shared_dir(spark).rstrip('/')}/lexmill/maintained"
    whole = f"{folder}/{name}-{FORMAT}-{state.hexdigest()[:32]}"
    files = files_of(spark, folder)
    if not files.fs.exists(files._path(f"{whole}/_SUCCESS")):
        aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
        build(source).write.option("compression", "zstd").parquet(aside)
        if not files.fs.rename(files._path(aside), files._path(whole)):
            files.remove(aside)
    return spark.read.parquet(whole)
