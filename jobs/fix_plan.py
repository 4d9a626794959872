"""A plan of fixes: what to mend in each source, in which order and session, and each source's health.

    python -m jobs.fix_plan --documents PATH --labels PATH --out PATH [--config FILE]

Documents are the files of a source. Findings are copies of an earlier document (by normal body),
large documents and such without a body. Each is scored by the risk of changing it: how many others
hold the same body, whether it was reviewed (has a label), how long it is. Within a source the safe
ones come first; `step` numbers them, and they are dealt to sessions by the budget and checkpoints of
the policy on attempts. The whole output is written anew by each run, so a rerun gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import history, scoring, symbols
from sparkloom.operators.ranking import ranked
from sparkloom.session import cut_lineage

from .common import default_config, log, main

SCHEMA = """doc_id long, finding string, first_id long, inbound_refs int, has_tests int, lines_changed int, score int, recommendation string,
    step long, session long, decision string, files long, lines long, copies long, large long, dead long, health double, record string, source string"""
KEPT = "doc_id", "source", "lines", "chars", "hash", "empty"


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lines, chars, hash, empty) of documents that have a text."""
    body = X.normal_body(F.col("text"))
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.nullif("source", F.lit("")), F.lit("(none)")).alias("source"), X.n_lines_scan(F.col("text")).alias("lines"), F.char_length("text").alias("chars"), body.alias("body"))
    return rows.select("doc_id", "source", "lines", "chars", F.sha2("body", 256).alias("hash"), (F.col("body") == "").alias("empty"))


def findings(rows: DataFrame, large_lines: int, large_chars: int) -> DataFrame:
    """(doc_id, source, lines, finding, first_id, others): `others` hold the same body."""
    groups = symbols.duplicate_groups(rows.filter("not empty"), "hash", F.col("doc_id"), F.col("doc_id")).select("hash", "n", "first")
    known = rows.join(groups, "hash", "left").withColumn("others", F.coalesce(F.col("n") - 1, F.lit(0)))
    kinds = {
        "dead_code": F.col("empty"),
        "duplicate": F.col("first").isNotNull() & (F.col("doc_id") != F.col("first")),
        "god_file": (F.col("lines") > large_lines) | (F.col("chars") > large_chars),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())
    return known.select("doc_id", "source", "lines", F.explode(found).alias("finding"), F.when(F.col("others") > 0, F.col("first")).alias("first_id"), "others")


def plan(found: DataFrame, reviewed: DataFrame, session_budget: int, confirm_every: int) -> DataFrame:
    """Findings with their risk, step within the source, session and what the policy says of it."""
    seen = reviewed.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("reviewed", F.lit(True))
    scored = scoring.risk(found.join(seen, "doc_id", "left"), F.col("others"), F.coalesce("reviewed", F.lit(False)), F.col("lines"), F.lit(False))
    out = ranked(scored, ["source"], ["score", "finding", "doc_id"], "step")
    nth = (F.col("step") - 1) % session_budget
    out = out.withColumns({"session": F.floor((F.col("step") - 1) / session_budget), "decision": history.gate(nth, F.lit(False), session_budget, confirm_every)})
    return out.select("doc_id", "finding", "first_id", "inbound_refs", "has_tests", "lines_changed", "score", "recommendation", "step", "session", "decision", F.lit("finding").alias("record"), "source")


def health(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Files, lines, findings by kind and the health score of each source."""
    sizes = rows.groupBy("source").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    kinds = {"copies": "duplicate", "large": "god_file", "dead": "dead_code"}
    counts = found.groupBy("source").agg(*[F.count_if(F.col("finding") == k).alias(c) for c, k in kinds.items()])
    out = sizes.join(counts, "source", "left").fillna(0, list(kinds))
    score = scoring.clamp_score(F.col("copies") / F.col("files"), F.col("dead") / F.col("files"), F.col("large"), F.lit(0))
    return out.select(F.lit("source").alias("record"), "source", "files", "lines", *kinds, score.cast("double").alias("health"))


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict | None = None) -> dict:
    """Reads documents and labels, writes the plan and the health of all sources, partitioned by kind of
    record and source, and returns how many rows were read and written."""
    c = default_config("fix_plan") | (config or {})
    read, written = Observation("read"), Observation("written")
    docs = spark.read.parquet(documents).observe(read, F.count("*").alias("n"))
    rows = cut_lineage(measured(docs))  # texts are read once
    found = cut_lineage(findings(rows, c["large_lines"], c["large_chars"]))
    result = plan(found, spark.read.parquet(labels), c["session_budget"], c["confirm_every"]).unionByName(health(rows, found), allowMissingColumns=True)
    result = result.select(*[f.name for f in spark.createDataFrame([], SCHEMA).schema]).observe(written, F.count("*").alias("n"))
    result.write.mode("overwrite").partitionBy("record", "source").parquet(out)
    told = {"read": read.get["n"], "written": written.get["n"]}
    log.info("fix_plan: read %d documents of %s, wrote %d rows to %s", told["read"], documents, told["written"], out)
    return told


def read_back(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)


if __name__ == "__main__":
    main("fix_plan", run, "documents", "labels", "out")
