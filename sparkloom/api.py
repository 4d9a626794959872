"""The ten operations, on a session and a state log."""

from __future__ import annotations

import contextlib
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .control import fix, state
from .functions.tables import CHUNK_LANGUAGES
from .operators import scoring
from .operators.files import slice_lines
from .operators.history import changelog
from .plans.scan import Scan, scan
from .sources.srctree import OutsideRoot, inside, is_skipped, suffix_of


class Workspace:
    """Operations on source trees; `log` keeps what outlives a session. With a root, what a crash
    left in that tree is tidied up at the start."""

    def __init__(self, spark: SparkSession, state_path: str, mode: str = "intended", root: str | None = None):
        self.spark, self.log, self.mode = spark, state.StateLog(spark, state_path), mode
        self.started = self.start(root) if root else None

    def start(self, root: str) -> dict[str, Any]:
        got = state.tidy(root)
        return {"cleaned_tmp_files": got["cleaned"], "gitignore_updated": got["ignore_updated"]}

    def scan_tables(self, root: str, languages: list[str] | None = None, include_tests: bool = True, max_depth: int = 0) -> Scan:
        return scan(self.spark, root, languages, include_tests, max_depth, self.mode)

    def scan_repo(self, root: str, languages: list[str] | None = None, include_tests: bool = True, max_depth: int = 10) -> dict[str, Any]:
        """The report as a dict, of files in at most `max_depth` directories below each other (0: no bound);
        a root that is no directory gives the same shape and an error."""
        if not Path(root).is_dir():
            empty = {"total_files": 0, "total_lines": 0, "languages_detected": [], "total_functions": 0, "total_classes": 0, "total_imports": 0}
            return {"summary": empty, "dead_code": [], "duplicates": [], "god_files": [], "dep_graph": {"nodes": [], "edges": [], "circular": []}, "subprojects": [], "error": f"not a directory: {root}"}
        got = self.scan_tables(root, languages, include_tests, max_depth)
        try:
            return got.to_dict()
        finally:
            got.release()

    def get_chunk(self, file_path: str, root: str, start_line: int = 1, end_line: int | None = None) -> dict[str, Any]:
        try:
            path = inside(file_path, root)
        except OutsideRoot as e:
            return {"error": str(e)}
        if is_skipped(path):
            return {"error": f"skipped: {path.name} is a binary, lock or oversized file"}
        try:
            text = path.read_bytes().decode("utf-8")
        except UnicodeDecodeError:
            return {"error": f"{path.name} is not UTF-8 text"}
        except OSError as e:
            return {"error": str(e)}
        row = self.spark.createDataFrame([(text, start_line, end_line)], "text string, s int, e int")
        got = row.select(slice_lines(F.col("text"), F.col("s"), F.col("e")).alias("x")).select("x.*").first().asDict()
        return got | {"language": CHUNK_LANGUAGES.get(suffix_of(path.name), "text")}

    def write_fix(self, file_path: str, diff: str, root: str, test_command: str | None = None, allowed_test_commands: list[str] | None = None) -> dict[str, Any]:
        got = fix.write_fix(file_path, diff, root, test_command, *([] if allowed_test_commands is None else [tuple(allowed_test_commands)]))
        if got["success"]:
            self.log.append(root, "fix_log", {"file": file_path})
        return got

    def rollback(self, file_path: str, root: str) -> bool:
        return fix.rollback(file_path, root)

    def git_commit(self, root: str, files: list[str] | None = None, message: str | None = None, branch: str | None = None, create_branch: bool = False, confirmed: bool = False) -> dict[str, Any]:
        n = self.log.read(root, "fix_count")["value"] or 0
        got = fix.commit(root, files, message, n, branch, create_branch, confirmed, **fix.fix_policy(root))
        if got["success"]:
            self.log.write(root, "fix_count", n + 1)
        return got

    def read_memory(self, key: str, root: str) -> dict[str, Any]:
        return self.log.read(root, key)

    def write_memory(self, key: str, value: Any, root: str, ttl_seconds: int | None = None) -> dict[str, Any]:
        before = self.log.write(root, key, value, ttl_seconds)
        return {"key": key, "previous": before, "previous_value": before, "success": True}

    def infer_architecture(self, root: str) -> dict[str, Any]:
        got = self.scan_tables(root)
        out = got.architecture().first().asDict()
        got.release()
        self.log.write(root, "architecture_hypothesis", out)
        return out

    def score_risk(self, symbol: str, file: str, dep_graph: dict[str, Any], scan_result: dict[str, Any]) -> dict[str, Any]:
        """Risk of changing one symbol, from reports of `scan_repo`: score, breakdown, recommendation.
        Reports hold no calls, so any test file of another name counts as a test."""
        make = self.spark.createDataFrame
        edges = make([(e["from"], e["to"], i) for i, e in enumerate(dep_graph.get("edges", []))], "from string, to string, import_id long")
        nodes = make([(f, i) for i, f in enumerate(dep_graph.get("nodes", []))], "file string, ordinal long")
        cycles = make([(f,) for f in {f for c in dep_graph.get("circular", []) for f in c}], "file string")
        dead = make([(d["symbol"],) for d in scan_result.get("dead_code", [])], "symbol string")
        gods = make([(g["file"], g["lines"]) for g in scan_result.get("god_files", [])], "file string, lines long")
        total = scan_result.get("summary", {})
        summary = make([(total.get("total_files", 0), total.get("total_lines", 0))], "total_files long, total_lines long")
        target = make([(symbol, file)], "symbol string, file string")
        row = scoring.risk_of(target, edges, nodes, cycles, dead, gods, summary, mode=self.mode).first().asDict()
        parts = ("inbound_refs", "has_tests", "lines_changed", "is_circular")
        return {"score": row["score"], "breakdown": {k: row[k] for k in parts}, "recommendation": row["recommendation"]}

    def risk_table(self, targets: DataFrame, tables: Scan) -> DataFrame:
        """Risk of many (symbol, file) changes at once."""
        return tables.risk(targets)

    def get_health_score(self, root: str, persist: bool = True) -> dict[str, Any]:
        """The score; it enters the health history unless `persist` is off."""
        got = self.scan_tables(root)
        score, summary = got.health().first().asDict(), got.summary.first().asDict()
        got.release()
        entry = {"timestamp": datetime.now(timezone.utc).isoformat(), **score, "total_files": summary["total_files"], "total_functions": summary["total_functions"]}
        if persist:
            self.log.append(root, "health_history", entry)
        return {"score": score.pop("score"), "breakdown": score, "scan_summary": summary}

    def generate_changelog(self, root: str) -> str:
        """Markdown of the scores, fixes and pending items in the log, also written into the tree."""
        kept = {k: self.log.read(root, k)["value"] or [] for k in ("health_history", "fix_log", "pending_fixes")}
        make = self.spark.createDataFrame
        scores = make([(i, float(h["score"])) for i, h in enumerate(kept["health_history"])], "at long, score double")
        fixes = make([(i, f.get("message"), f.get("file")) for i, f in enumerate(kept["fix_log"])], "at long, message string, file string")
        pending = make([(i, str(p)) for i, p in enumerate(kept["pending_fixes"])], "at long, item string")
        text = changelog(scores, fixes, pending, generated=datetime.now(timezone.utc).isoformat()).first()["text"]
        with contextlib.suppress(OSError):  # a tree that cannot be written still gets its text
            Path(root, "CHANGES.sparkloom.md").write_text(text, encoding="utf-8")
        return text
