"""Where intermediate tables live.

Long plans are cut by writing a Parquet table into the folder the cluster shares
(``spark.checkpoint.dir``) and reading it back, so a lost executor costs a re-read and
not a recomputation.  Only a session of a single machine without that setting (tests,
notebooks) gets a temporary folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_made: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session: its setting, or the context's own checkpoint folder.

    A session of a single machine that names none gets a temporary one; on a cluster that is an
    error, since each executor would write to a disk of its own.
    """
    root = spark.conf.get(_KEY, None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = "file://" + tempfile.mkdtemp(prefix="vaakya-")
        else:
            raise RuntimeError(f"{_KEY} must name a folder that the driver and all executors share")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """The application's own folder; the file system deletes it when the driver ends."""
    folder = f"{shared_root(spark)}/vaakya-{spark.sparkContext.applicationId}"
    if folder not in _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _made.add(folder)
    return folder


def table_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage."""
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialise` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    marker = f"/vaakya-{spark.sparkContext.applicationId}/"
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if marker in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(hadoop).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application, once results were written."""
    folder = _folder(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _made.discard(folder)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which a driver with little to do
    may put off until executors' disks hold every shuffle of the job.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
