import subprocess

import pytest

from sparkloom.api import Workspace
from sparkloom.control import diff, fix, state
from sparkloom.control.fix import fix_policy, write_fix
from sparkloom.operators import history
from sparkloom.sources.srctree import OutsideRoot, inside

DIFF = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a = 1\n-b = 2\n+b = 3\n+c = 4\n"


def test_diff_applies_and_checks_context(spark):
    assert diff.applied("a = 1\nb = 2\n", DIFF) == "a = 1\nb = 3\nc = 4\n"
    for bad in ("no diff", DIFF.replace("b = 2", "b = 9"), DIFF + "--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n-x\n+y\n"):
        with pytest.raises(diff.BadDiff):
            diff.applied("a = 1\nb = 2\n", bad)
    assert diff.applied("a\n", "@@ -0,0 +1 @@\n+z\n") == "z\na\n"
    df = spark.createDataFrame([("a = 1\nb = 2\n", DIFF), ("x", DIFF), (None, DIFF)], "t string, d string")
    assert [r[0] for r in df.select(diff.applied_column(df.t, df.d)).collect()] == ["a = 1\nb = 3\nc = 4\n", None, None]


def test_fix_rolls_back(tree):
    root = tree({"x.py": "a = 1\nb = 2\n"})
    assert "error" in write_fix("../y.py", DIFF, root) and not write_fix("x.py", "nothing", root)["success"]
    assert not write_fix("x.py", DIFF, root, "false && true", ("false",))["success"]
    got = write_fix("x.py", DIFF, root, "false", ("false",))
    assert got["rolled_back"] and open(f"{root}/x.py").read() == "a = 1\nb = 2\n"
    assert write_fix("x.py", DIFF, root, "true", ("true",))["success"] and "c = 4" in open(f"{root}/x.py").read()


def test_paths_stay_inside(tree):
    root = tree({"a/x.py": "", "../outside.py": ""})
    assert inside("a/x.py", root).name == "x.py"
    for bad in ("../outside.py", "/etc/passwd", "a/../../outside.py"):
        with pytest.raises(OutsideRoot):
            inside(bad, root)
    (inside("a", root) / "link").symlink_to("/etc")
    with pytest.raises(OutsideRoot):
        inside("a/link/passwd", root)


def test_workspace(spark, tree, tmp_path_factory):
    root = tree({"app.py": "def hello(): pass\n", "b.dat": bytes(range(256))})
    w = Workspace(spark, str(tmp_path_factory.mktemp("state") / "log"))
    assert w.read_memory("created_at", root) == {"key": "created_at", "value": None, "found": True}
    assert not w.read_memory("nope", root)["found"]
    assert w.write_memory("k", {"a": [1]}, root, 60)["previous"] is None
    assert w.write_memory("k", 2, root)["previous"] == {"a": [1]} and w.read_memory("k", root)["value"] == 2
    for i in range(6):
        w.write_memory("k", i, root)
    assert w.log.backups(root).filter("key = 'k'").count() == 5
    assert w.get_health_score(root)["score"] == 70.0 and len(w.read_memory("health_history", root)["value"]) == 1
    w.get_health_score(root)
    assert w.infer_architecture(root)["entry_points"] == ["app.py"]
    assert "+0.0 from previous scan" in w.generate_changelog(root)
    assert w.get_chunk("app.py", root)["language"] == "python" and "UTF-8" in w.get_chunk("b.dat", root)["error"]
    assert "error" in w.get_chunk("../x", root)
    assert w.scan_repo(root + "/none")["error"] and w.scan_repo(root)["summary"]["total_functions"] == 1
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("config", "user.name", "t")
    git("config", "user.email", "t@t")
    assert w.git_commit(root, ["app.py"], "first")["success"]
    w.write_memory("fix_count", 5, root)
    assert w.git_commit(root, ["b.dat"], "x")["needs_confirmation"] and w.git_commit(root, ["b.dat"], "x", confirmed=True)["success"]
    w.write_memory("fix_count", 20, root)
    assert "budget" in w.git_commit(root, ["b.dat"], "x", confirmed=True)["error"]


def test_changelog_and_tidy(spark, tree):
    scores = spark.createDataFrame([(0, 50.0), (1, 62.5)], "at int, score double")
    fixes = spark.createDataFrame([(0, "m", None), (1, None, "f"), (2, None, None)], "at int, message string, file string")
    text = history.changelog(scores, fixes, spark.createDataFrame([], "at int, item string"), generated="now").first()["text"]
    assert text == "# Changes\n\n*Generated: now*\n\n**Health score:** 62.5 (+12.5 from previous scan)\n\n## Fixes Applied\n\n- m\n- f\n- unknown\n\n## Pending Fixes\n\n_None_\n"
    assert history.changelog(scores.limit(0), fixes.limit(0), fixes.limit(0).withColumn("item", fixes.file)).first()["text"] == "# Changes\n\n## Pending Fixes\n\n_None_\n"
    root = tree({"x.sparkloom-part": "", "y.tmp": "", ".gitignore": "a"})
    assert state.tidy(root)["cleaned"] and not state.tidy(root)["ignore_updated"]
    assert open(f"{root}/y.tmp").read() == "" and open(f"{root}/.gitignore").read().startswith("a\n")


def test_policy_of_a_config(tree):
    assert fix_policy(tree({"scan.toml": "[fix]\nsession_budget = 3\nconfirm_every = 'x'\n"})) == {"budget": 3, "confirm_every": 5}
    assert fix_policy("/nowhere") == {"budget": 20, "confirm_every": 5}


def test_a_crash_leaves_a_copy_that_rollback_puts_back(tree, monkeypatch):
    root = tree({"x.py": "a = 1\nb = 2\n"})
    monkeypatch.setattr(fix.subprocess, "run", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        write_fix("x.py", DIFF, root, "true", ("true",))
    assert "c = 4" in open(f"{root}/x.py").read()
    assert fix.rollback("x.py", root) and open(f"{root}/x.py").read() == "a = 1\nb = 2\n" and not fix.rollback("x.py", root)


def test_whatever_a_test_command_does_the_file_is_as_it_was(tree):
    root = tree({"x.py": "a = 1\nb = 2\n"})
    got = write_fix("x.py", DIFF, root, "pytest 'x", ("pytest",))
    assert not got["success"] and "not understood" in got["error"]
    got = write_fix("x.py", DIFF, root, "printf '\\377\\376'", ("printf",))  # output that is not UTF-8
    assert got["success"] and "\ufffd" in got["test_output"]
    root = tree({"x.py": "a = 1\nb = 2\n"})
    assert write_fix("x.py", DIFF, root, "no-such-program", ("no-such-program",))["rolled_back"]
    assert open(f"{root}/x.py").read() == "a = 1\nb = 2\n" and not list(inside(".", root).glob("*" + fix.COPY))


def test_a_stash_that_cannot_be_put_back_is_told(tree):
    root = tree({"x.py": "a = 1\nb = 2\n", "y.py": "y = 1\n"})
    git = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True, text=True).stdout
    for args in (["init", "-q"], ["config", "user.name", "t"], ["config", "user.email", "t@t"], ["add", "-A"], ["commit", "-qm", "first"]):
        git(*args)
    (inside("y.py", root)).write_text("y = 2\n")
    got = write_fix("x.py", DIFF, root, "cp x.py y.py", ("cp",))  # the test writes over what was put aside
    assert not got["success"] and "stash@{0}" in got["error"] and "y = 2" in git("stash", "show", "-p")
    assert open(f"{root}/x.py").read() == "a = 1\nb = 2\n"
