"""An incremental scan: each run takes the files of documents that came since the last, tells which
are copies of what came before, and appends the health of all seen so far.

    python -m jobs.scan_history --documents DIR-OR-PATTERN --out PATH --checkpoint PATH [--config FILE]

The stream's checkpoint holds which input files are done; what is new is read in micro-batches until
none is left. A batch writes partitions of its own number, so one that is repeated after a crash
replaces what it had left; it reads nothing of later batches. Earlier documents are met only by the
hashes of first occurrences, and totals grow from the entry before.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import scoring

from .common import default_config, log, main

SCHEMA = """doc_id long, source string, lines int, chars int, hash string, first_id long, copy boolean,
    total_files long, total_lines long, total_copies long, total_large long, score double, delta double, kind string, batch long"""


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """Everything written so far; before the first batch nothing."""
    try:
        return spark.read.schema(SCHEMA).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def files_of(batch: DataFrame, earlier: DataFrame) -> DataFrame:
    """(doc_id, source, lines, chars, hash, first_id, copy): the first with a body is the one of the
    least id in the earliest batch that has it. Without a text there is no hash, and no copy."""
    rows = batch.select(F.col("doc_id").cast("long").alias("doc_id"), "source", X.n_lines_scan(F.col("text")).alias("lines"), F.char_length("text").alias("chars"), X.body_hash(F.col("text")).alias("hash"))
    rows = rows.withColumn("lines", F.when(F.col("chars").isNotNull(), F.col("lines")))
    known = earlier.filter("kind = 'file' and not copy and hash is not null").groupBy("hash").agg(F.min("doc_id").alias("old_id"))
    new = rows.filter("hash is not null").groupBy("hash").agg(F.min("doc_id").alias("new_id"))
    firsts = new.join(known, "hash", "left").select("hash", F.coalesce("old_id", "new_id").alias("first_id"))
    return rows.join(firsts, "hash", "left").select("doc_id", "source", "lines", "chars", "hash", "first_id", F.coalesce(F.col("first_id") != F.col("doc_id"), F.lit(False)).alias("copy"))


def entry_of(files: DataFrame, before: DataFrame, batch_id: int, large_lines: int, large_chars: int) -> DataFrame:
    """One row: totals with this batch, the score they give, and its change since the entry before."""
    large = (F.col("lines") > large_lines) | (F.col("chars") > large_chars)
    now = files.agg(F.count("*").alias("f"), F.coalesce(F.sum("lines"), F.lit(0)).alias("l"), F.count_if("copy").alias("c"), F.count_if(large).alias("g"))
    last = before.filter("kind = 'health'").agg(F.max_by(F.struct("total_files", "total_lines", "total_copies", "total_large", "score"), "batch").alias("e"))
    both = now.crossJoin(last)  # a row each
    totals = {f"total_{n}": F.col(c) + F.coalesce(F.col(f"e.total_{n}"), F.lit(0)) for n, c in (("files", "f"), ("lines", "l"), ("copies", "c"), ("large", "g"))}
    out = both.select(*[v.cast("long").alias(k) for k, v in totals.items()], F.col("e.score").alias("previous"))
    score = scoring.clamp_score(F.col("total_copies") / F.greatest("total_files", F.lit(1)), F.lit(0.0), F.col("total_large"), F.lit(0)).cast("double")
    return out.withColumn("score", score).withColumn("delta", F.round(F.col("score") - F.col("previous"), 1)).withColumn("kind", F.lit("health")).withColumn("batch", F.lit(batch_id).cast("long"))


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Takes the documents that are new since the last run with this checkpoint, writes a row for each
    and an entry of health for each batch, partitioned by kind and batch, and returns how many rows were
    read and written."""
    c = default_config("scan_history") | (config or {})
    told = {"batches": 0, "read": 0, "written": 0}
    columns = [f.name for f in spark.createDataFrame([], SCHEMA).schema]

    def write(rows: DataFrame, kind: str, batch_id: int) -> int:
        seen = Observation()
        rows = rows.withColumns({"kind": F.lit(kind), "batch": F.lit(batch_id).cast("long")})
        rows = rows.unionByName(rows.sparkSession.createDataFrame([], SCHEMA), allowMissingColumns=True).select(*columns)
        rows = rows.observe(seen, F.count("*").alias("n"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(out)
        return seen.get["n"]

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        earlier = read_back(session, out).filter(F.col("batch") < batch_id)
        n = write(files_of(batch, earlier), "file", batch_id)
        own = read_back(session, out).filter((F.col("kind") == "file") & (F.col("batch") == batch_id))
        m = write(entry_of(own, earlier, batch_id, c["large_lines"], c["large_chars"]).drop("previous"), "health", batch_id)
        told["batches"] += 1
        told["read"] += n
        told["written"] += n + m
        log.info("scan_history: batch %d of %s: read %d documents, wrote %d rows to %s", batch_id, documents, n, n + m, out)

    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(documents)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("scan_history: %d batches, %d documents read, %d rows written", told["batches"], told["read"], told["written"])
    return told


if __name__ == "__main__":
    main("scan_history", run, "documents", "out", "checkpoint")
