"""What a session needs before this package's functions run on its Python workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it lies on a path that they share, as in
    local mode from any working directory; on a cluster it is shipped with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 16 MB for texts, unless the session says otherwise:
    the usual 10,000 rows of long texts are more than a Python worker should hold."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where none is set, a local one
    does only if all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return (at or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A copy in the checkpoint folder (`spark.checkpoint.dir`; a local one only where none is
    set and all runs on one machine), so that an iteration's plan stays small and a lost executor costs no replay."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


_stored: list[str] = []


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """A copy as Parquet in the shared folder, read back: like a checkpoint, but what is read has the size
    of its files. A checkpoint keeps its plan's estimate, and estimates of joins multiply over rounds until
    planning alone takes seconds and nothing small is broadcast. The copies go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(_leave, spark)
    _stored.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _leave(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        for path in _stored:
            to = spark._jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
