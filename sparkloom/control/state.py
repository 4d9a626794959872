"""State as a log that only grows: (repo, key, value JSON, ttl_seconds, version, at) in Parquet.

A write appends one version; what a key holds is its highest version. Nothing is overwritten, so
a crash leaves the log as it was, and readers never see half a write.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import STATE_KEYS
from ..operators.history import latest, retain

SCHEMA = "repo string, key string, value string, ttl_seconds long, version long, at timestamp"
EMPTY: dict[str, Any] = dict.fromkeys(STATE_KEYS) | {"health_history": [], "fix_log": [], "embeddings_cache": {}, "pending_fixes": []}
#: Names that a tree's ignore file gets for what this package leaves in it.
IGNORE_ENTRIES = ("*.sparkloom-part", "*.sparkloom-before", "sparkloom-state/", "CHANGES.sparkloom.md")


class StateLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def current(self, repo: str | None = None) -> DataFrame:
        rows = self.rows() if repo is None else self.rows().filter(F.col("repo") == repo)
        return latest(rows, ["repo", "key"], F.col("version"))

    def values(self, repo: str) -> DataFrame:
        """Values as VARIANT."""
        return self.current(repo).select("key", F.try_parse_json("value").alias("value"), "version")

    def read(self, repo: str, key: str) -> dict[str, Any]:
        """{key, value, found}; an empty state's keys are found with their defaults."""
        got = self.current(repo).filter(F.col("key") == key).first()
        if got is not None:
            return {"key": key, "value": json.loads(got["value"]), "found": True}
        return {"key": key, "value": EMPTY.get(key), "found": key in EMPTY}

    def write(self, repo: str, key: str, value: Any, ttl_seconds: int | None = None) -> Any:
        """Appends a version and returns the value before it. One writer for each repo."""
        before = self.read(repo, key)["value"]
        last = self.rows().filter(F.col("repo") == repo).agg(F.max("version")).first()[0]
        row = (repo, key, json.dumps(value, default=str), ttl_seconds, (last or 0) + 1, datetime.now(timezone.utc))
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return before

    def append(self, repo: str, key: str, item: Any) -> None:
        self.write(repo, key, [*(self.read(repo, key)["value"] or []), item])

    def backups(self, repo: str, most: int = 5) -> DataFrame:
        """The newest versions of each key."""
        return retain(self.rows().filter(F.col("repo") == repo), ["repo", "key"], [F.desc("version")], most)


def tidy(root: str | Path) -> dict[str, Any]:
    """Deletes parts of files that a crash left (this package's own names only), and adds what is
    missing to the tree's ignore file."""
    gone = [str(p) for p in sorted(Path(root).glob("*.sparkloom-part"))]
    for p in gone:
        Path(p).unlink(missing_ok=True)
    ignore = Path(root) / ".gitignore"
    have = ignore.read_text(encoding="utf-8") if ignore.exists() else ""
    missing = [e for e in IGNORE_ENTRIES if e not in have.split("\n")]
    if missing:
        ignore.write_text(have + ("\n" if have and not have.endswith("\n") else "") + "\n".join(missing) + "\n", encoding="utf-8")
    return {"cleaned": gone, "ignore_updated": bool(missing)}
