"""Sessions and what executors need to run this library."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Bytes of an Arrow batch. Two workers' batches, and the copies on both sides, are small beside an executor's memory.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application, and bound Arrow batches
    if the application has not: operators themselves leave the session's settings as they are."""
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{ROOT.name}", "zip", ROOT.parent, ROOT.name))
        _shipped.add(app)
    return spark


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a temporary one serves, once per application and in local mode only: on a cluster it would lie on each
    machine's own disk, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        found = _local[context.applicationId]
    return found.rstrip("/")


def pin(df: DataFrame) -> DataFrame:
    """``df`` written once into the shared folder and read from there: the same rows each time, lost executors or not.
    The files go with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pinned-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
