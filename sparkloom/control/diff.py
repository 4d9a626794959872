"""Unified diffs, applied to text."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


class BadDiff(ValueError):
    """A diff that is none, or does not fit its text."""


def hunks(diff: str) -> list[tuple[int, list[str]]]:
    """(first old line, lines with their marks) of each hunk; a second file's part is refused."""
    found: list[tuple[int, list[str]]] = []
    old = new = 0
    for line in diff.splitlines(keepends=True):
        m = HEADER.match(line)
        if m and old <= 0 and new <= 0:
            found.append((int(m[1]), []))
            old, new = int(m[2] or 1) if m[2] != "0" else 0, int(m[4] or 1) if m[4] != "0" else 0
        elif found and (old > 0 or new > 0 or line.startswith("\\")):
            found[-1][1].append(line)
            old -= line[0] in " -\n"
            new -= line[0] in " +\n"
        elif found and line.startswith(("--- ", "+++ ", "diff ")):
            raise BadDiff("the diff is for more than one file")
    if not found:
        raise BadDiff("no hunk in the diff")
    if old > 0 or new > 0:
        raise BadDiff("the last hunk is cut short")
    return found


def applied(text: str, diff: str) -> str:
    """The text after the diff. Context and removed lines must be those of the text."""
    lines = text.splitlines(keepends=True)
    out: list[str] = []
    at = 0
    for first, body in hunks(diff):
        start = first - 1 if any(x[0] in " -\n" for x in body) else first
        if start < at or start > len(lines):
            raise BadDiff(f"hunk at line {first} lies outside the text")
        out += lines[at:start]
        at = start
        for x in body:
            mark, rest = x[0], x[1:] if x[0] != "\n" else "\n"
            if mark == "\\":
                continue
            if mark in " -\n":
                if at >= len(lines) or lines[at].rstrip("\r\n") != rest.rstrip("\r\n"):
                    raise BadDiff(f"line {at + 1} is not as the diff has it")
                if mark != "-":
                    out.append(lines[at])
                at += 1
            elif mark == "+":
                out.append(rest)
            else:
                raise BadDiff(f"unknown mark {mark!r}")
    return "".join([*out, *lines[at:]])


def applied_column(text: Column, diff: Column) -> Column:
    """The same for columns, in Arrow batches; null where the diff does not fit."""

    def one(t: str | None, d: str | None) -> str | None:
        try:
            return None if t is None or d is None else applied(t, d)
        except BadDiff:
            return None

    def run(text: pd.Series, diff: pd.Series) -> pd.Series:
        return pd.Series([one(t, d) for t, d in zip(text, diff)], dtype=object)

    return F.pandas_udf(run, "string")(text, diff)


def write_atomically(path: Path, text: str) -> None:
    part = path.with_name(path.name + ".sparkloom-part")
    try:
        part.write_text(text, encoding="utf-8")
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)
