"""Column expressions over source text and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it, as a class and one by one (fixed values).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Line ends as Python's str.splitlines sees them (fixed value).
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: Identifiers before an opening parenthesis (fixed value): of three characters at least, or any.
CALL_LONG = r"(?U)(?<![\w.])([a-zA-Z_]\w{2,})\s*\("
CALL_ANY = r"(?U)(?<!\w)([a-zA-Z_]\w*)\s*\("
#: Beginnings of lines that are comments in one of the languages (fixed value).
COMMENT_STARTS = ("#", "//", "/*", "*")
DOCSTRING_MARKS = ('"""', "'''")


def strip(c: Column) -> Column:
    """Python's str.strip."""
    return F.btrim(c, F.lit(SPACES))


def normal_body(c: Column, strip_docstring_marks: bool = False) -> Column:
    """A body without indentation, blank lines and comment lines."""
    marks = COMMENT_STARTS + (DOCSTRING_MARKS if strip_docstring_marks else ())

    def keep(x: Column) -> Column:
        out = x != ""
        for m in marks:
            out = out & ~x.startswith(m)
        return out

    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), keep), "\n")


def body_hash(c: Column, strip_docstring_marks: bool = False) -> Column:
    return F.sha2(normal_body(c, strip_docstring_marks), 256)


def n_lines_scan(c: Column) -> Column:
    """Newlines and one: how a scan counts lines."""
    return F.size(F.split(c, "\n"))


def text_lines(c: Column) -> Column:
    """Python's str.splitlines: no empty line after a final line end."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def n_lines_text(c: Column) -> Column:
    return F.size(text_lines(c))


def call_tokens(line: Column, intended: bool = True) -> Column:
    """Names that a line seems to call. Intended: names of any length, methods too; compat: three
    characters at least, and none after a dot."""
    return F.regexp_extract_all(line, F.lit(CALL_ANY if intended else CALL_LONG), 1)


def is_comment_line(line: Column) -> Column:
    """Lines that a call scan leaves out: those that begin with # or //."""
    s = strip(line)
    return s.startswith("#") | s.startswith("//")


def iso_time(at: Column) -> Column:
    """A timestamp as ISO 8601 in UTC with microseconds, as the logs have it."""
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last suffix; a name that only begins with dots stays whole."""
    return F.regexp_replace(basename(path), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    """The last suffix in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^\.*[^.].*?(\.[^.]+)$", 1))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")
