"""Files that several stages of one job share.

Intermediate tables are written below the folder named by ``spark.checkpoint.dir``, which every
executor can reach, so that a lost executor costs a re-read and never a recomputation of the whole
lineage.  A folder of our own is used only where the setting is missing and the session runs on one
machine (tests); a cluster without the setting is refused, as its executors would write to different disks.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session, as a URI or path without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="palimpsest-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
            spark.sparkContext.setCheckpointDir(_OWN["dir"])
        named = _OWN["dir"]
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    _MADE.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as parquet in the shared folder and read back: a durable lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _MADE:
        _MADE.remove(path)


def clear(spark: SparkSession) -> None:
    """Deletes everything written so far; results that were not saved elsewhere go too."""
    for path in list(_MADE):
        drop_path(spark, path)
