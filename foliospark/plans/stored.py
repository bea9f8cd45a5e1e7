"""Tables that are made once and read many times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .binding import documents

_MADE: dict[tuple[str, str, str], tuple[int, DataFrame]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``, which all machines share; local mode may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="frames-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


_FOLDERS: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Deletes the tables that this application has written; how many there were. Frames that read them are of no use afterwards."""
    application, jvm = spark.sparkContext.applicationId, spark._jvm
    folders = _FOLDERS.pop(application, [])
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _MADE if k[0] == application]:
        del _MADE[key]
    return len(folders)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table: what is built on it prunes its columns and never computes it again."""
    spark = df.sparkSession
    path = shared_folder(spark)
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a checkpoint in the session's ``spark.checkpoint.dir``: unlike a table it keeps its partitions and the order in them."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _stamp(spark: SparkSession, folder: str) -> int:
    """A number that changes when a file of ``folder`` does, whatever store it is in."""
    jvm, found = spark._jvm, []
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written at its first use in a Spark application, and again once the files of ``sf_dir`` have changed."""
    key, stamp = (spark.sparkContext.applicationId, sf_dir, name), _stamp(spark, sf_dir)
    if key not in _MADE or _MADE[key][0] != stamp:
        _MADE[key] = (stamp, stored(make()))
    return _MADE[key][1]


def document_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard frame of the driver's tables, written once."""
    return once(spark, sf_dir, "documents", lambda: documents(spark, sf_dir))
