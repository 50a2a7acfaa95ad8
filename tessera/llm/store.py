"""Where the operators of this subpackage keep tables between steps.

Everything that is read twice is written as Parquet below the folder that the
cluster names in ``spark.checkpoint.dir``: all executors share it, so a lost
executor costs no recomputation of earlier steps and no lineage grows long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def free(name: str, columns: list[str]) -> str:
    """``name``, or with as many underscores before it as no column's name begins with (capitals don't tell names apart)."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


class Workspace:
    """Tables of one run of an operator, each in a folder of its own name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._fs_path().deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs_path(self):
        conf = self.spark._jsc.hadoopConfiguration()
        return self._path(self.root).getFileSystem(conf)

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df`` once, in a folder per value of ``by`` if given, and return a frame that reads it."""
        path, writer = self.folder(name), df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            self._fs_path().delete(self._path(self.folder(name)), True)
