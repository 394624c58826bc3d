"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master
    without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="shelfspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end within it leave no shuffle files; else these stay until the driver's garbage collection."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scope(list):
    """Folders of the tables staged within a ``short_lived`` part."""

    def kept(self, table: DataFrame) -> DataFrame:
        """The table staged last outlives this part and belongs to the one around it."""
        path = self.pop()
        for outer in _scopes[:-1][-1:]:
            outer.append(path)
        return table


_scopes: list[Scope] = []


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[Scope]:
    """Tables staged within it go at its end, but for those it has ``kept``."""
    _scopes.append(Scope())
    try:
        yield _scopes[-1]
    finally:
        for folder in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For operators that pass over their input several times: later passes read
    only the columns they need, the plan stays small, and a lost executor
    costs a re-read instead of a recomputation. Its shuffle files go with the write.
    """
    path = work_path(df.sparkSession, name)
    for scope in _scopes[-1:]:
        scope.append(path)
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_bytes(*tables: DataFrame) -> int:
    """Bytes of the files of staged tables."""
    spark, whole = tables[0].sparkSession, 0
    for name in {f.rpartition("/")[0] for table in tables for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        whole += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return whole


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the scan has fewer splits than there are cores.

    Large tables have many splits and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
