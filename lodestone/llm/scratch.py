"""Shared scratch tables: the cluster-wide way to cut lineage without local checkpoints."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, an own one is set if all tasks run in this
    process, as in tests; executors elsewhere could not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Has Spark remove an execution's shuffle files when it ends; a stage that is needed again is run again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Executions that start inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """A folder for one run of an operator. ``save`` writes a table and reads it back, so that a lost
    executor costs at most the stage at hand, and removes the shuffle files of what it wrote; ``drop`` removes tables that
    no later step reads. What is left, which
    results may still read, is removed when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with tidy(self.spark):
            df.write.mode("overwrite").parquet(self.at(name))
        self.fade()
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def _fs(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def fade(self) -> None:
        """Has the folder removed at the session's end."""
        fs, path = self._fs(self.path)
        fs.deleteOnExit(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._fs(self.at(name))
            fs.delete(path, True)
