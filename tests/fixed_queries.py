"""Operations on trees, logs and repositories that read no given table: each with the rows it has to give."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.api import Workspace
from sparkloom.control import fix, state
from sparkloom.operators import scoring
from sparkloom.sources import srctree
from sparkloom.tree_queries import _write, new_tree

FIXED: dict[str, tuple[Callable, str]] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        FIXED[f.__name__] = (f, sql)
        return f

    return add


_DIFF = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a = 1\n-b = 2\n+b = 3\n+c = 4\n"


_TREES = {
    "command": (["bin/tool_main.py", "cmds/cli.py", "cmds/run.py", "lib/parse.py", "tests/test_run.py"], ["python"]),
    "service": (["api/router.js", "api/handler.js", "server.js", "db/store.js"], ["javascript"]),
    "site": (["pages/layout.tsx", "pages/page.tsx", "ui/render.ts", "index.ts"], ["typescript"]),
    "nothing": ([], []),
}


@query(
    """SELECT * FROM (VALUES
    ('command', 'CLI tool', 'cmds/cli.py,cmds/run.py', 'tool_main,cli,run,parse', 1.0, 'This appears to be a CLI tool written in python. Entry points: cmds/cli.py, cmds/run.py. Logical modules include: tool_main, cli, run, parse.'),
    ('service', 'REST API', 'server.js', 'router,handler,server,store', 1.0, 'This appears to be a REST API written in javascript. Entry point: server.js. Logical modules include: router, handler, server, store.'),
    ('site', 'web frontend', 'index.ts', 'layout,page,render,index', 1.0, 'This appears to be a web frontend written in typescript. Entry point: index.ts. Logical modules include: layout, page, render, index.'),
    ('nothing', 'CLI tool', '', '', 0.2, 'This appears to be a CLI tool written in unknown language. No clear entry point detected.'))
    AS t(tree, pattern, entry_points, modules, confidence, hypothesis)""".replace("1.0,", "1.0::DOUBLE,").replace("0.2,", "0.2::DOUBLE,")
)
def likely_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, (paths, languages) in _TREES.items():
        rows = spark.createDataFrame([(p, i) for i, p in enumerate(paths, 1)], "file string, ordinal int")
        got = scoring.architecture(rows, languages).select(F.lit(name).alias("tree"), "pattern", F.array_join("entry_points", ",").alias("entry_points"), F.array_join("inferred_modules", ",").alias("modules"), "confidence", "hypothesis")
        out = got if out is None else out.union(got)
    return out


@query("SELECT d || '/x.py' AS file FROM (VALUES ('src'), ('out'), ('target'), ('.tox'), ('htmlcov')) AS t(d)")
def tree_files_by_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that is read without a scan leaves out fewer directories."""
    root = new_tree(spark, "default")
    for d in ("src", "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".egg-info", ".pytest_cache", ".mypy_cache", "out", "target", ".tox", "htmlcov"):
        _write(root, f"{d}/x.py", b"x = 1\n")
    return srctree.read_tree(spark, str(root)).select("file")


@query("SELECT * FROM (VALUES ('a/x.py', true), ('a/../a/x.py', true), ('.', true), ('new.py', true), ('../outside.py', false), ('/etc/hostname', false), ('a/../../outside.py', false), ('link/hostname', false)) AS t(path, allowed)")
def paths_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_tree(spark, "paths")
    _write(root, "a/x.py", b"")
    (root / "link").symlink_to("/etc")

    def allowed(path: str) -> bool:
        try:
            return bool(srctree.inside(path, root))
        except srctree.OutsideRoot:
            return False

    paths = ["a/x.py", "a/../a/x.py", ".", "new.py", "../outside.py", "/etc/hostname", "a/../../outside.py", "link/hostname"]
    return spark.createDataFrame([(p, allowed(p)) for p in paths], "path string, allowed boolean")


@query(
    """SELECT * FROM (VALUES (1, 'read unset', 'null True'), (2, 'write', 'null'), (3, 'write again', '{"a": [1]}'), (4, 'read', '2 True'), (5, 'read unknown', 'null False'), (6, 'append', '[1, 2]'), (7, 'versions kept', '5'), (8, 'newest version', '9'), (9, 'another tree', 'null False'))
    AS t(step, operation, result)"""
)
def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes, reads, versions and bounded retention of the state log, in order."""
    import json

    log = state.StateLog(spark, f"{new_tree(spark, 'state')}/log")
    show = lambda got: f"{json.dumps(got['value'])} {got['found']}"
    out = [("read unset", show(log.read("r", "last_scan"))), ("write", json.dumps(log.write("r", "k", {"a": [1]}))), ("write again", json.dumps(log.write("r", "k", 2))), ("read", show(log.read("r", "k"))), ("read unknown", show(log.read("r", "nope")))]
    log.append("r", "fix_log", 1)
    log.append("r", "fix_log", 2)
    out.append(("append", json.dumps(log.read("r", "fix_log")["value"])))
    for i in range(5):
        log.write("r", "k", i, 60)
    kept = log.backups("r").filter("key = 'k'").agg(F.count("*").alias("n"), F.max("version").alias("v")).first()
    out += [("versions kept", str(kept["n"])), ("newest version", str(kept["v"])), ("another tree", show(log.read("q", "k")))]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(out, 1)], "step int, operation string, result string")


@query(
    """SELECT * FROM (VALUES ('no diff', false, false, 'a = 1|b = 2|', ''), ('outside', false, false, 'a = 1|b = 2|', ''), ('chained command', false, false, 'a = 1|b = 2|', ''), ('unknown command', false, false, 'a = 1|b = 2|', ''),
    ('failing test', false, true, 'a = 1|b = 2|', 'y = 5|'), ('other context', false, false, 'a = 9|', ''), ('passing test', true, false, 'a = 1|b = 3|c = 4|', 'y = 5|'), ('no test', true, false, 'a = 1|b = 3|c = 4|', ''), ('crash', false, true, 'a = 1|b = 2|', ''))
    AS t(step, success, rolled_back, text, other)"""
)
def fix_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes that stand and fixes that are taken back; a change of another file is put aside while a
    test runs and is there again after it."""
    out = []

    def run(step: str, text: str = "a = 1\nb = 2\n", patch: str = _DIFF, path: str = "x.py", command: str | None = None, allowed: tuple[str, ...] = ("grep", "test"), git: bool = False) -> None:
        root = new_tree(spark, "fix")
        _write(root, "x.py", text.encode())
        if git:
            _write(root, "y.py", b"y = 4\n")
            for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "first"], ["config", "user.name", "t"], ["config", "user.email", "t@t"]):
                subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True)
            _write(root, "y.py", b"y = 5\n")
        got = fix.write_fix(path, patch, str(root), command, allowed)
        other = (root / "y.py").read_text() if git else ""
        assert not list(root.glob("*" + fix.COPY))
        out.append((step, got["success"], got["rolled_back"], (root / "x.py").read_text().replace("\n", "|"), other.replace("\n", "|")))

    run("no diff", patch="nothing")
    run("outside", path="../x.py")
    run("chained command", command="grep a x.py; true")
    run("unknown command", command="make")
    run("failing test", command="grep -q absent x.py", git=True)
    run("other context", text="a = 9\n")
    run("passing test", command="grep -q 'y = 4' y.py", git=True)
    run("no test")
    root = new_tree(spark, "crash")
    _write(root, "x.py", b"half of it")
    _write(root, "x.py" + fix.COPY, b"a = 1\nb = 2\n")
    out.append(("crash", False, fix.rollback("x.py", str(root)), (root / "x.py").read_text().replace("\n", "|"), ""))
    return spark.createDataFrame(out, "step string, success boolean, rolled_back boolean, text string, other string")


@query(
    """SELECT * FROM (VALUES (1, 'named files', true, 'a.py', 'first', ''), (2, 'all that changed', true, 'b.py,c.py', 'Automated fix 2', ''), (3, 'checkpoint', false, '', '', ''), (4, 'confirmed', true, 'd.py', 'fourth', 'work'), (5, 'spent', false, '', '', 'session budget of 3 is used up'), (6, 'outside', false, '', '', 'outside'), (7, 'usual policy', false, '20', '5', ''))
    AS t(step, operation, success, committed, message, note)"""
)
def commit_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits under a policy from the tree's config: budget 3, a checkpoint every second one."""
    root = new_tree(spark, "commits")

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q")
    git("config", "user.name", "t")
    git("config", "user.email", "t@t")
    (root / ".git/info/exclude").write_text("scan.toml\n")
    _write(root, "scan.toml", b"[fix]\nsession_budget = 3\nconfirm_every = 2\n")
    policy = fix.fix_policy(root)
    out = []

    def run(operation: str, files: list[str] | None, message: str | None, done: int, **more) -> None:
        got = fix.commit(str(root), files, message, done, **more, **policy)
        said = git("log", "-1", "--format=%s") if got["success"] else ""
        note = (got["branch"] if more.get("branch") else "") if got["success"] else ("outside" if "not inside" in (got["error"] or "") else got["error"] or "")
        out.append((len(out) + 1, operation, got["success"], ",".join(sorted(got["files_committed"])), said, note))

    for name in ("a.py", "b.py", "c.py"):
        _write(root, name, b"x = 1\n")
    run("named files", ["a.py"], "first", 0)
    run("all that changed", None, None, 1)
    _write(root, "d.py", b"x = 1\n")
    run("checkpoint", ["d.py"], "x", 2)
    run("confirmed", ["d.py"], "fourth", 2, confirmed=True, branch="work", create_branch=True)
    run("spent", ["d.py"], "x", 3, confirmed=True)
    run("outside", ["../d.py"], "x", 0)
    usual = fix.fix_policy(root / ".git")
    out.append((7, "usual policy", False, str(usual["budget"]), str(usual["confirm_every"]), ""))
    return spark.createDataFrame(out, "step int, operation string, success boolean, committed string, message string, note string")


@query(
    """SELECT * FROM (VALUES ('scan_repo', '2 files, 3 functions, 2 unused, 1 edges'), ('get_chunk', 'y = 2 [2..2 of 2 python]'), ('get_chunk outside', 'refused'), ('infer_architecture', 'CLI tool: main.py'), ('read_memory', 'CLI tool'), ('score_risk', '25 safe to fix 0/20/5/0'), ('get_health_score', '70.0, 0 kept'), ('get_health_score kept', '70.0, 1 kept'),
    ('write_memory', 'before: one'), ('write_fix', 'True'), ('git_commit', 'True Automated fix 1'), ('generate_changelog', '70.0, 1 fixes'), ('start', '1 cleaned, True'), ('rollback', 'False'))
    AS t(operation, result)"""
)
def workspace_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each operation of a workspace once, on a small tree."""
    root = new_tree(spark, "workspace")
    at = str(root)
    _write(root, "main.py", b"import part\n\ndef main():\n    return used()\n\ndef idle_one():\n    return 1\n\ndef idle_two():\n    return 2\n")
    _write(root, "part.py", b"x = used(1)\ny = 2\n")
    _write(root, "left.sparkloom-part", b"")
    w = Workspace(spark, f"{new_tree(spark, 'workspace-state')}/log", root=at)
    out = [("start", f"{len(w.started['cleaned_tmp_files'])} cleaned, {w.started['gitignore_updated']}")]
    report = w.scan_repo(at)
    out.append(("scan_repo", f"{report['summary']['total_files']} files, {report['summary']['total_functions']} functions, {len(report['dead_code'])} unused, {len(report['dep_graph']['edges'])} edges"))
    chunk = w.get_chunk("part.py", at, 2, 9)
    out.append(("get_chunk", f"{chunk['source']} [{chunk['start_line']}..{chunk['end_line']} of {chunk['total_lines']} {chunk['language']}]"))
    out.append(("get_chunk outside", "refused" if "error" in w.get_chunk("../x", at) else "read"))
    shape = w.infer_architecture(at)
    out += [("infer_architecture", f"{shape['pattern']}: {','.join(shape['entry_points'])}"), ("read_memory", w.read_memory("architecture_hypothesis", at)["value"]["pattern"])]
    risk = w.score_risk("idle_one", "main.py", report["dep_graph"], report)
    out.append(("score_risk", f"{risk['score']} {risk['recommendation']} {'/'.join(str(x) for x in risk['breakdown'].values())}"))
    for name, persist in (("get_health_score", False), ("get_health_score kept", True)):
        score = w.get_health_score(at, persist)["score"]
        out.append((name, f"{score}, {len(w.read_memory('health_history', at)['value'])} kept"))
    w.write_memory("k", "one", at)
    out.append(("write_memory", f"before: {w.write_memory('k', 'two', at)['previous_value']}"))
    out.append(("write_fix", str(w.write_fix("part.py", "@@ -2 +2 @@\n-y = 2\n+y = 3\n", at, "grep -q 'y = 3' part.py", ["grep"])["success"])))
    out.append(("rollback", str(w.rollback("part.py", at))))
    for args in (["init", "-q"], ["config", "user.name", "t"], ["config", "user.email", "t@t"]):
        subprocess.run(["git", "-C", at, *args], check=True, capture_output=True)
    done = w.git_commit(at)
    said = subprocess.run(["git", "-C", at, "log", "-1", "--format=%s"], capture_output=True, text=True).stdout.strip()
    out.append(("git_commit", f"{done['success']} {said}"))
    text = w.generate_changelog(at)
    out.append(("generate_changelog", f"{'70.0' if '70.0' in text else '?'}, {text.count('- part.py')} fixes"))
    return spark.createDataFrame(out, "operation string, result string")
