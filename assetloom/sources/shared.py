"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows of a table that go to a task before they become texts, paths or lists.
DEALT = 20_000

#: Whether a query's shuffle files go when it has ended; else they stay until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The paths of the tables written under each ``passing`` of this thread, innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the cluster names in ``spark.checkpoint.dir``.

    On one machine (tests), where that is unset, the warehouse directory is taken; on a cluster that is an error, since
    the warehouse need not be shared. The path is deleted when the JVM's file system client closes.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, label: str, kept: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the table cuts the lineage and survives lost executors.

    The shuffles that made it are of no use after that and are freed at once. ``kept``: the table outlives the ``passing`` that it is written under.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    under = _passing.get()[:-1] if kept else _passing.get()
    if under:
        under[-1].append(path)
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` while it lasts are deleted at its end, but for those to be kept: what is read later must not depend on them."""
    paths: list[str] = []
    outer = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(outer)
        for path in paths:
            hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def dealt(rows: DataFrame, *keys: str, most: int = DEALT) -> DataFrame:
    """The rows of a stored table dealt by keys over so many tasks that each has about ``most``, however the table's files are cut.

    What is made of the rows later (texts that are read, paths that are collected) may be many times larger than the rows. Counting a stored table reads its footers.
    """
    return rows.repartition(max(1, -(-rows.count() // most)), *keys)


def join_large(left: DataFrame, right: DataFrame, on: str | Sequence[str] | Column, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input, shuffled on both sides.

    Spark guesses the size of derived rows (exploded paths, concatenated texts) by that of the files below, which is far too small:
    without the hint it sends tables of hundreds of MB through the driver to all executors.
    """
    return left.join(right.hint("merge"), on, how)
