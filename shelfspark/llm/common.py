"""Shared helpers: inputs, tables written once, bounded broadcasts, files of the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import stage, work_path

#: Fixed: the white space of every contract, as code points.
SPACES = " \t\n\x0b\x0c\r"

#: Tables of ids up to this many rows (8 bytes each) may be broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 1_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query, with the DuckDB text that must give the same rows."""
    def add(fn):
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check
        return fn
    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` (null read as empty); other columns are left behind."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"), *more)


def bounded(side: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """``side`` with a broadcast hint if it is counted to be within ``bound`` rows."""
    return F.broadcast(side) if side.count() <= bound else side


def total(df: DataFrame, column: Column) -> int:
    """One number over all rows; 0 for an empty table."""
    return int(df.agg(F.sum(column)).first()[0] or 0)


def arrow_texts(batch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes."""
    import pyarrow as pa

    return batch.column(name).cast(pa.binary()).to_pylist()


def shared_files(uri: str):
    """(file system, path) of a folder named by a Hadoop path, for use inside tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class Scratch:
    """Tables of one operator in the shared folder, each removed once its last reader has been written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = work_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def per_worker(name: str, make: Callable):
    """An object that lives as long as the Python worker, for bounded caches that tasks share."""
    import sys
    import types

    box = sys.modules.setdefault("_shelfspark_worker", types.ModuleType("_shelfspark_worker"))
    if name not in vars(box):
        setattr(box, name, make())
    return getattr(box, name)


def free_worker() -> None:
    """Drop what other operators keep in this worker; for operators that need the room and keep nothing."""
    import sys

    box = sys.modules.get("_shelfspark_worker")
    for name in [n for n in vars(box) if not n.startswith("__")] if box else ():
        delattr(box, name)


__all__ = ["BROADCAST_IDS", "ORACLES", "QUERIES", "SPACES", "Scratch", "arrow_texts", "bounded", "documents",
           "free_worker", "id_text", "labels", "per_worker",
           "query", "shared_files", "stage", "total", "work_path"]
