"""Session helpers shared by every operator: shared storage and code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR = None
_PATHS: list[str] = []
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    A cluster names it in ``spark.checkpoint.dir``; only in local mode may that be unset, and
    then a temporary folder of this process is used. On a cluster such a folder would not
    be shared, so that is an error.
    """
    global _OWN_DIR
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _OWN_DIR is None:
        folder = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN_DIR = "file://" + folder
    return _OWN_DIR


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    path = f"{shared_root(spark)}/quillon/{label}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Delete all that this process has written to the shared folder so far; results that read it
    must have been written or collected."""
    while _PATHS:
        remove(spark, _PATHS.pop())


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system that owns it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete what `materialise` wrote for `df`; its readers must have run."""
    remove(df.sparkSession, df._quillon_path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context, and have long texts reach
    Python in batches of 8 MB unless the context names another size."""
    sc = spark.sparkContext
    if not sc.getConf().contains(_BATCH_BYTES):
        spark.conf.set(_BATCH_BYTES, "8m")
    if getattr(sc, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillon-code-")
    target = os.path.join(folder, "quillon_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(target)
    sc._quillon_shipped = True


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
