"""Files wherever Spark's file systems find them, and the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def listed(spark: SparkSession, folder: str, ending: str = "") -> list[str]:
    """Paths of the folder's entries with the ending, by name; none where there is no such folder."""
    fs, where = _at(spark, folder)
    if not fs.exists(where):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(where))
    return sorted(f"{folder.rstrip('/')}/{n}" for n in names if n.endswith(ending))


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Puts the path `new` in the place of `old`, which stands aside until that is done: a break in between loses neither."""
    fs, fresh = _at(spark, new)
    _, place = _at(spark, old)
    _, aside = _at(spark, f"{old}.before")
    if fs.exists(place):
        fs.delete(aside, True)
        if not fs.rename(place, aside):
            raise OSError(f"{old} cannot be moved aside")
    if not fs.rename(fresh, place):
        raise OSError(f"{new} cannot be moved to {old}")
    fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> None:
    """Brings back what a broken-off replacement has left aside."""
    fs, place = _at(spark, path)
    _, aside = _at(spark, f"{path}.before")
    if not fs.exists(place) and fs.exists(aside):
        fs.rename(aside, place)


class Folder:
    """Small text files of one folder, local or in any file system that Spark reaches. A new file is there whole or not at all, and of two writers of
    one name only one succeeds."""

    def __init__(self, path: str) -> None:
        scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", path)
        self.local = Path(unquote(urlparse(path).path) if scheme else path) if scheme is None or scheme[1] == "file" else None
        self.path = path.rstrip("/")

    def _fs(self, name: str = ""):
        return _at(SparkSession.active(), f"{self.path}/{name}" if name else self.path)

    def names(self, ending: str = "") -> list[str]:
        if self.local is not None:
            found = [p.name for p in self.local.iterdir()] if self.local.is_dir() else []
        else:
            fs, where = self._fs()
            found = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n for n in found if n.endswith(ending) and not n.startswith("."))

    def read(self, name: str) -> str | None:
        """The text; none where there is no such file."""
        if self.local is not None:
            try:
                return (self.local / name).read_text(encoding="utf-8")
            except FileNotFoundError:
                return None
        fs, where = self._fs(name)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def _aside(self, text: str) -> str:
        name = f".{uuid.uuid4().hex}.new"
        if self.local is not None:
            self.local.mkdir(parents=True, exist_ok=True)
            (self.local / name).write_text(text, encoding="utf-8")
        else:
            fs, where = self._fs(name)
            stream = fs.create(where, True)
            stream.write(bytearray(text.encode("utf-8")))
            stream.close()
        return name

    def create(self, name: str, text: str) -> bool:
        """Whether the file has been made; false where there is one already."""
        aside = self._aside(text)
        if self.local is not None:
            try:
                os.link(self.local / aside, self.local / name)
                return True
            except FileExistsError:
                return False
            finally:
                (self.local / aside).unlink()
        fs, where = self._fs(aside)
        target = self._fs(name)[1]
        made = not fs.exists(target) and fs.rename(where, target)  # a rename to a name that is taken is refused
        if not made:
            fs.delete(where, False)
        return made

    def write(self, name: str, text: str) -> None:
        """The file with this text, in the place of one that is there."""
        aside = self._aside(text)
        if self.local is not None:
            os.replace(self.local / aside, self.local / name)
            return
        fs, where = self._fs(aside)
        target = self._fs(name)[1]
        fs.delete(target, False)
        fs.rename(where, target)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the checkpoint folder that is set; a folder of our own only where all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


class Scratch:
    """The tables that one piece of work has written, and no other's: they go when its block ends, but for those that it keeps. Work in another
    thread has a scratch of its own."""

    def __init__(self, outer: Scratch | None = None) -> None:
        self.outer, self.tables = outer, []

    def add(self, df: DataFrame, path: str) -> DataFrame:
        fs, where = _at(df.sparkSession, path)
        fs.deleteOnExit(where)
        self.tables.append((df, path))
        return df

    def keep(self, df: DataFrame) -> DataFrame:
        """Leaves a table to the work around this one."""
        mine = [x for x in self.tables if x[0] is df]
        self.tables = [x for x in self.tables if x[0] is not df]
        (self.outer or _LASTING).tables.extend(mine)
        return df

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that is not read any more; one that this work has not written is left alone."""
        for _, path in [x for x in self.tables if x[0] is df]:
            fs, where = _at(df.sparkSession, path)
            fs.delete(where, True)
        self.tables = [x for x in self.tables if x[0] is not df]

    def close(self) -> None:
        for df, _ in list(self.tables):
            self.drop(df)


#: What is written outside of any block goes with the driver.
_LASTING = Scratch()
_SCRATCH: contextvars.ContextVar[Scratch] = contextvars.ContextVar("scratch", default=_LASTING)


@contextlib.contextmanager
def scratch() -> Iterator[Scratch]:
    """Tables that are stored or checkpointed in the block go at its end, so nothing that is left to be computed may read them."""
    own = Scratch(_SCRATCH.get())
    token = _SCRATCH.set(own)
    try:
        yield own
    finally:
        _SCRATCH.reset(token)
        own.close()


def forget(df: DataFrame) -> None:
    """Deletes a stored table of this work before its end."""
    _SCRATCH.get().drop(df)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: later steps read only the columns that they need, and know its true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return _SCRATCH.get().add(spark.read.schema(df.schema).parquet(path), path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df as it is, partitions and their order included, written to the shared folder: no later loss of an executor recomputes it."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return _SCRATCH.get().add(out, file.get()) if file.isDefined() else out
