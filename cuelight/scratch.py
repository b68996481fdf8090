"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}
_within: ContextVar[list[str] | None] = ContextVar("tables of a step", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of our own only where none is set and all tasks run in this process, as in
    tests. On a cluster a folder of one machine would not be seen by the others, so there it must be set."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cuelight-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, *by: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: a cut in the lineage that outlives executors. ``by``: columns of few values,
    each of which gets files of its own.

    It stays until it is discarded, or the program ends: a result may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cuelight-{uuid.uuid4().hex}"
    _left[path] = spark
    if (made := _within.get()) is not None:
        made.append(path)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cuelight_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _left.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and that nothing will read again; others are left alone."""
    for df in tables:
        if hasattr(df, "_cuelight_path"):
            _delete(df.sparkSession, df._cuelight_path)


def committed(step: Callable[[], DataFrame], *spent: DataFrame) -> DataFrame:
    """Writes what a step returns, and then removes all tables that were written on the way, and ``spent`` ones."""
    made: list[str] = []
    outer = _within.set(made)
    try:
        df = step()
    finally:
        _within.reset(outer)
    out = written(df)
    for path in made:
        if path in _left:
            _delete(df.sparkSession, path)
    discard(*spent)
    return out


@atexit.register
def _tidy() -> None:
    """Removes what is left, if the session still runs."""
    for path, spark in list(_left.items()):
        if SparkContext._active_spark_context is not spark.sparkContext:
            return
        _delete(spark, path)


class Folder:
    """A folder of whatever file system its path names, by the driver's Hadoop client."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, str(path).rstrip("/")

    def _at(self, name: str) -> tuple:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, name: str) -> bool:
        files, target = self._at(name)
        return files.exists(target)

    def delete(self, name: str) -> None:
        files, target = self._at(name)
        files.delete(target, True)

    def write_text(self, name: str, text: str) -> None:
        """A small file; one of that name is replaced."""
        files, target = self._at(name)
        out = files.create(target, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def claim(self, name: str) -> bool:
        """Makes an empty file unless there is one: of several callers exactly one succeeds."""
        files, target = self._at(name)
        if files.getScheme() == "file":  # where Hadoop's client looks first and creates then
            local = files.makeQualified(target).toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                return False
            return True
        return files.createNewFile(target)

    def names(self, name: str) -> list[str]:
        """What a folder holds, in order; nothing if there is none."""
        files, target = self._at(name)
        return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []

    def join(self, parts: str, name: str) -> None:
        """The bytes of the parts of a folder, in order, as one file; the folder goes."""
        io = self.spark._jvm.org.apache.hadoop.io.IOUtils
        files, target = self._at(name)
        if files.exists(target):
            files.delete(target, True)
        out = files.create(target, True)
        try:
            for part in self.names(parts):
                if part.startswith("part-"):
                    source = files.open(self._at(f"{parts}/{part}")[1])
                    io.copyBytes(source, out, self.spark._jsc.hadoopConfiguration(), False)
                    source.close()
        finally:
            out.close()
        self.delete(parts)

    def put(self, local: str, name: str) -> None:
        """A copy of a file or folder of this machine; what is there under the name is replaced."""
        files, target = self._at(name)
        files.copyFromLocalFile(False, True, self.spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)

    def read_text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]
