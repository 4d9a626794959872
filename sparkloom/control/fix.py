"""A fix as a transaction: guard, keep a copy on disk, apply, test, and take back on failure."""

from __future__ import annotations

import contextlib
import os
import shlex
import subprocess
import tomllib
from collections.abc import Iterator
from pathlib import Path

from ..functions.tables import CHAINING
from ..sources.srctree import OutsideRoot, inside, is_skipped
from .diff import BadDiff, applied, write_atomically

TEST_SECONDS, GIT_SECONDS = 120, 30
#: What a session may do, unless the tree's config says otherwise.
BUDGET, CONFIRM_EVERY = 20, 5
#: Of a file that is being changed; a crash leaves it, and `rollback` puts it back.
COPY = ".sparkloom-before"


def fix_policy(root: str | Path, config: str = "scan.toml") -> dict[str, int]:
    """budget and confirm_every from `session_budget` and `confirm_every` under [fix] of a tree's
    config; what is missing, no whole number or cannot be read is as usual."""
    try:
        own = tomllib.loads(Path(root, config).read_text(encoding="utf-8")).get("fix", {})
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        own = {}

    def number(key: str, usual: int) -> int:
        got = own.get(key) if isinstance(own, dict) else None
        return got if isinstance(got, int) and not isinstance(got, bool) and got > 0 else usual

    return {"budget": number("session_budget", BUDGET), "confirm_every": number("confirm_every", CONFIRM_EVERY)}


def allowed_command(command: str, allowed: tuple[str, ...]) -> bool:
    """Begins with an allowed command and chains nothing, as operators.files.may_run has it."""
    bare = command.strip()
    return bool(bare) and not any(c in bare for c in CHAINING) and any(bare.startswith(a) for a in allowed)


def _copy_of(path: Path) -> Path:
    return path.with_name(path.name + COPY)


def _keep(path: Path) -> None:
    """A copy that is on disk before the file changes."""
    with open(_copy_of(path), "wb") as f:
        f.write(path.read_bytes())
        f.flush()
        os.fsync(f.fileno())


def rollback(file_path: str, root: str) -> bool:
    """Puts a file back as it was before a change that has not ended; False if there is no copy."""
    path = inside(file_path, root)
    copy = _copy_of(path)
    if not copy.is_file():
        return False
    os.replace(copy, path)
    return True


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True, timeout=GIT_SECONDS).stdout.strip()


@contextlib.contextmanager
def others_aside(root: str, path: Path) -> Iterator[list[str]]:
    """Stashes uncommitted changes of tracked files other than `path` for a while, so that a test
    sees the fix alone; outside a repository, or where git fails, nothing happens. Yields a list that
    names the stash afterwards, if it could not be put back."""
    aside, left = False, []
    try:
        here = path.relative_to(Path(root).resolve()).as_posix()
        before = _git(root, "rev-parse", "--verify", "--quiet", "HEAD") and _git(root, "stash", "list")
        _git(root, "stash", "push", "--quiet", "--", ".", f":(exclude){here}")
        aside = _git(root, "stash", "list") != before
    except (subprocess.SubprocessError, OSError):
        pass
    try:
        yield left
    finally:
        if aside:
            try:
                _git(root, "stash", "pop", "--quiet")
            except (subprocess.SubprocessError, OSError):
                left.append(_git(root, "stash", "list", "-1", "--format=%gd %H"))


def write_fix(file_path: str, diff: str, root: str, test_command: str | None = None, allowed: tuple[str, ...] = ("pytest", "npm test", "go test")) -> dict:
    """Applies a diff to one file of a tree. With a test command the change stays only if that
    succeeds; commands run without a shell, and other uncommitted changes are put aside. If these cannot
    be put back the fix goes, and the error names the stash that holds them. Whatever is raised
    meanwhile, the file is then as it was."""
    out = {"success": False, "rolled_back": False, "error": None, "test_output": ""}
    try:
        path = inside(file_path, root)
    except OutsideRoot as e:
        return out | {"error": str(e)}
    if test_command is not None and not allowed_command(test_command, allowed):
        return out | {"error": f"command not allowed: {test_command!r}"}
    try:
        words = shlex.split(test_command or "")
    except ValueError as e:  # a quote that does not close
        return out | {"error": f"command not understood: {e}"}
    if not path.is_file() or is_skipped(path):
        return out | {"error": f"not a file to change: {file_path}"}
    try:
        after = applied(path.read_text(encoding="utf-8"), diff)
        _keep(path)
    except (BadDiff, OSError, UnicodeDecodeError) as e:
        return out | {"error": str(e)}
    good, said, left = True, "", []
    try:
        write_atomically(path, after)
        if words:
            with others_aside(root, path) as left:
                ran = subprocess.run(words, cwd=root, capture_output=True, timeout=TEST_SECONDS)
            good, said = ran.returncode == 0, (ran.stdout + ran.stderr).decode("utf-8", "replace")
    except (OSError, subprocess.SubprocessError) as e:
        good, said = False, str(e)
    except Exception:
        rollback(file_path, root)
        raise
    if good and not left:
        _copy_of(path).unlink(missing_ok=True)
        return out | {"success": True, "test_output": said}
    rollback(file_path, root)
    why = f"other changes could not be put back, and are in {left[0]}" if left else "the test command failed"
    return out | {"rolled_back": True, "error": why, "test_output": said}


def commit(root: str, files: list[str] | None, message: str | None, n_done: int, branch: str | None = None, create_branch: bool = False, confirmed: bool = False, budget: int = BUDGET, confirm_every: int = CONFIRM_EVERY) -> dict:
    """Stages files (None: all that changed) and commits them with git, under the policy of
    operators.history.gate. Without a message the commit is numbered."""
    out = {"success": False, "commit_hash": None, "branch": None, "files_committed": [], "error": None}
    try:
        names = None if files is None else [str(inside(f, root).relative_to(Path(root).resolve())) for f in files]
    except OutsideRoot as e:
        return out | {"error": str(e)}
    if n_done >= budget:
        return out | {"error": f"session budget of {budget} is used up"}
    if not confirmed and n_done > 0 and n_done % confirm_every == 0:
        return out | {"needs_confirmation": True}
    try:
        if branch:
            _git(root, "checkout", *(["-b"] if create_branch else []), branch)
        _git(root, "add", *(["--all"] if names is None else ["--", *names]))
        _git(root, "commit", "-m", message or f"Automated fix {n_done + 1}", *([] if names is None else ["--", *names]))
        if names is None:
            names = _git(root, "show", "--name-only", "--format=", "HEAD").split("\n")
        return out | {"success": True, "commit_hash": _git(root, "rev-parse", "HEAD"), "branch": _git(root, "rev-parse", "--abbrev-ref", "HEAD"), "files_committed": names}
    except (subprocess.SubprocessError, OSError) as e:
        return out | {"error": getattr(e, "stderr", "") or str(e)}
