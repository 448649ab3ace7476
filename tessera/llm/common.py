"""Shared folders, materialization and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent in local mode, as in tests, a temporary folder is made and set; on a cluster, where
    machines don't share such folders, its absence is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


_SCRATCH: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder, or in the innermost ``scratch`` folder."""
    return f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark) + '/tessera'}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside go to a folder of their own, which is removed at the end: no lazy result may still need them."""
    at = f"{shared_dir(spark)}/tessera/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(at)
    try:
        yield
    finally:
        _SCRATCH.remove(at)
        delete(spark, at)


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs the tasks in flight, not the work before this table.
    """
    return written_at(df, new_path(df.sparkSession, name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str = "doc_id", parts: int = 5, part: int = 0):
    """True for the rows that no label may be learned from, one in ``parts``; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))
