"""What the operators share: the cluster's shared folder, stored tables and batch helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where neither that setting nor a checkpoint folder exists, a local folder is set if all runs on
    one machine; on a cluster that is an error, as no executor would see another's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        at = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it goes with `sweep`, or when the driver
    ends."""
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_leave, spark)
    _made.append(path)
    return path


def _leave(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        sweep(spark)


def stored(df: DataFrame, name: str, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(compression=codec, **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_made: list[str] = []


def sweep(spark: SparkSession, keep: tuple[str, ...] = ()) -> int:
    """Deletes the stored tables of this session but for those in `keep`, and returns their number:
    to be called when results are written, as lazy ones still read them."""
    gone = [p for p in _made if p not in keep]
    _made[:] = [p for p in _made if p in keep]
    for path in gone:
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
    return len(gone)


def made() -> tuple[str, ...]:
    """The stored tables that there are now."""
    return tuple(_made)


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A Python worker's memory under a name. Workers outlive tasks, so whoever asks under another
    name ("" for none) first frees what earlier operators kept."""
    others = [n for n in _caches if n != name]
    for n in others:
        _caches.pop(n).clear()
    if others:
        give_back()
    return _caches.setdefault(name, {})


def give_back() -> None:
    """Returns memory that this process has freed to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 16 MB for texts, unless the session says otherwise:
    the usual 10,000 rows of long texts are more than a Python worker should hold."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, so that further columns cannot clash."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_key(id_col: str = "doc_id", text_col: str = "text"):
    """With doc_id, the identity of a row: rows alike in both share every result."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each part holds about most_bytes, but at least a row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def gathered(batches: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about most_bytes, put together from smaller ones or cut from larger ones."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, most_bytes):
        if held and size + part.nbytes > most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += part.nbytes
    if held:
        yield pa.concat_batches(held)


def to_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Keys that may be sent to every task: 8 bytes each, so some MB.
MOST_BROADCAST = 300_000


def sized(keys: DataFrame) -> DataFrame:
    """Keys for a join with a larger table: few of them, by a count, go to all tasks, so that the
    table is not shuffled; many are joined by shuffle. The rows are the same either way."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys.hint("merge")


def split_by_keys(rows: DataFrame, keys: DataFrame, on: str = "row_key") -> tuple[DataFrame, DataFrame]:
    """(rows whose `on` is among keys, the others)."""
    side = sized(keys)
    return rows.join(side, on, "left_semi"), rows.join(side, on, "left_anti")
