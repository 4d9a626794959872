"""A source tree as a table: the Python data source `srctree` and the listing beside it.

Spark's own file readers drop names that begin with "_" or "."; this reader does not. The driver
opens directories until there are enough for all tasks; these list what is below, prune, guard and
read, so files that are left out are never read and no one lists the whole tree.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from ..functions import tables as T

log = logging.getLogger(__name__)

SCHEMA = "file string, language string, size long, content binary, error string"


class OutsideRoot(ValueError):
    """A path that leads out of its tree."""


def inside(path: str | Path, root: str | Path) -> Path:
    """The path with its links resolved, if it lies in the root; relative ones begin there."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if full != base and base not in full.parents:
        raise OutsideRoot(f"{path} is not inside {root}")
    return full


def suffix_of(name: str) -> str:
    return Path(name).suffix.lower()


def is_skipped(path: Path) -> bool:
    """The file guard of operators.files, for a file at hand."""
    if path.name in T.SKIPPED_NAMES:
        return True
    full = "".join(path.suffixes).lower()
    if any(full.endswith(s) for s in T.SKIPPED_SUFFIXES):
        return True
    try:
        return path.stat().st_size > T.MOST_BYTES
    except OSError:
        return True


def on_the_way(path: str, prefix: str) -> bool:
    """Whether paths that begin with a prefix may lie in a directory."""
    return f"{path}/".startswith(prefix) or prefix.startswith(f"{path}/")


def walk(root: str | Path, ignored: frozenset[str], under: str = "", deep: bool = True, prefix: str = "") -> Iterator[str]:
    """Relative paths, beginning with a prefix, of the files below a directory of a tree (in it alone, if
    not `deep`), ignored directories and such beside the prefix pruned rather than filtered, in order."""
    base = str(root)
    for top, dirs, names in os.walk(os.path.join(base, under)):
        here = os.path.relpath(top, base).replace(os.sep, "/")
        here = "" if here == "." else f"{here}/"
        dirs[:] = sorted(d for d in dirs if d not in ignored and on_the_way(here + d, prefix)) if deep else []
        for n in sorted(names):
            if n not in ignored and (here + n).startswith(prefix):
                yield here + n


def units(root: str | Path, ignored: frozenset[str], most: int, prefix: str = "") -> list[tuple[str, bool]]:
    """(directory, whether with all below it) that make up a tree, each of its files in one: directories
    are opened level by level until there are `most`, so the driver lists no more than that. Directories
    in which no path begins with the prefix are not opened."""
    shallow: list[tuple[str, bool]] = []
    level = [""]
    while level and len(shallow) + len(level) < most:
        below = []
        for d in level:
            with os.scandir(os.path.join(str(root), d)) as entries:
                found = sorted(os.path.join(d, e.name) for e in entries if e.is_dir(follow_symlinks=False) and e.name not in ignored)
            below += [x for x in found if on_the_way(x.replace(os.sep, "/"), prefix)]
        shallow += [(d, False) for d in level]
        level = below
    return shallow + [(d, True) for d in level]


@dataclass
class Part(InputPartition):
    units: list[tuple[str, bool]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.ignored = frozenset(x for x in options.get("ignore", ",".join(T.READ_IGNORED)).split(",") if x)
        self.languages = {x for x in options.get("languages", "").split(",") if x}
        if unknown := self.languages - set(T.PARSED_LANGUAGES.values()):
            log.warning("no parser for %s", ", ".join(sorted(unknown)))
        self.depth = int(options.get("maxdepth", "0"))
        self.tests = options.get("includetests", "true").lower() != "false"
        self.names_only = options.get("namesonly", "false").lower() == "true"
        self.parts = int(options.get("parts", "64"))
        self.prefix, self.least, self.most = "", 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what spares listing or reading: a beginning of the path prunes directories, languages and
        sizes are known before a file is opened. Everything else stays with Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if self.names_only and column != ("file",):
                yield f
            elif column == ("file",) and isinstance(f, StringStartsWith) and (value.startswith(self.prefix) or self.prefix.startswith(value)):
                self.prefix = max(self.prefix, value, key=len)
            elif column == ("language",) and isinstance(f, (EqualTo, In)):
                asked = {value} if isinstance(f, EqualTo) else set(value)
                self.languages = (self.languages & asked if self.languages else asked) or {""}
            elif column == ("size",) and isinstance(f, (LessThan, LessThanOrEqual)):
                bound = value - isinstance(f, LessThan)
                self.most = bound if self.most is None else min(self.most, bound)
            elif column == ("size",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, value + isinstance(f, GreaterThan))
            else:
                yield f

    def wanted(self, under: str, deep: bool) -> Iterator[tuple[str, str, int]]:
        for rel in walk(self.root, self.ignored, under, deep, self.prefix):
            language = T.PARSED_LANGUAGES.get(suffix_of(rel))
            if language is None or self.languages and language not in self.languages:
                continue
            if self.depth and rel.count("/") >= self.depth or not self.tests and "test" in rel.lower():
                continue
            try:
                path = inside(rel, self.root)
            except OutsideRoot:
                continue
            if not is_skipped(path) and (size := path.stat().st_size) >= self.least and (self.most is None or size <= self.most):
                yield rel, language, size

    def partitions(self) -> list[InputPartition]:
        every = units(self.root, self.ignored, 8 * self.parts, self.prefix)
        return [Part(every[i :: self.parts]) for i in range(min(self.parts, len(every)))] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for under, deep in partition.units:
            if self.names_only:
                yield from ((rel, None, None, None, None) for rel in walk(self.root, self.ignored, under, deep, self.prefix))
                continue
            for rel, language, size in self.wanted(under, deep):
                try:
                    yield rel, language, size, Path(self.root, rel).read_bytes(), None
                except OSError as e:
                    yield rel, language, size, None, str(e)


class SourceTree(DataSource):
    """spark.read.format("srctree").load(root); options ignore, languages (comma-separated),
    maxDepth (0: no bound), includeTests, parts, namesOnly (paths of all files, whatever they are).
    Tasks list and read their own directories; the tree must lie where the driver and all
    executors see it."""

    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """A tree as a table. Predicates on language, size and the beginning of the path are the source's own,
    for which the session has to allow filters of Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format("srctree").options(**options).load(str(root))


def listing(spark: SparkSession, root: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path) of every file of a tree, source or not."""
    return read_tree(spark, root, namesOnly="true", ignore=",".join(ignored)).select(F.col("file").alias("path"))


def ignored_directories(root: str | Path, config: str = "scan.toml") -> tuple[str, ...]:
    """The usual names and those that a config file adds: `ignore_dirs` at its top, `ignore` or
    `ignore_dirs` under [scan]. A file that cannot be read or parsed adds none."""
    import tomllib

    try:
        got = tomllib.loads(Path(root, config).read_text())
        scan = got.get("scan", {})
        extra = [*got.get("ignore_dirs", []), *scan.get("ignore", []), *scan.get("ignore_dirs", [])]
    except (OSError, tomllib.TOMLDecodeError, AttributeError, TypeError, UnicodeDecodeError):
        extra = []
    return tuple(dict.fromkeys([*T.IGNORED_DIRECTORIES, *map(str, extra)]))
