"""Parsed files that outlive a scan: a table by path, language and digest of the content.

Rows are only added. A scan takes those of its own files; what has changed has another digest and is
parsed, and what is gone finds no file.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import parsers

SCHEMA = f"{parsers.PARSED}, digest string, scan int"
KEY = ["file", "language", "digest"]


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The table, empty before the first scan."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def parse_changed(files: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(parsed rows of all files, how many were parsed now) of (file, language, content, error), with the
    number of the scan that parsed each. Files that could not be read are tried by each scan, and get an
    error row; they and the parser's own errors are kept too, so text that cannot be parsed is not tried
    again until it changes. Registering another parser for a language takes another folder."""
    spark = files.sparkSession
    keyed = files.withColumn("digest", F.when(F.col("error").isNull(), F.sha2("content", 256)))
    known = cached(spark, path)
    number = (known.agg(F.max("scan")).first()[0] or 0) + 1
    changed = keyed.filter("digest is not null").join(known.select(*KEY), KEY, "left_anti")
    n = changed.count()
    if n:
        digests = changed.select(*KEY)
        fresh = parsers.parse_files(changed).join(digests, ["file", "language"]).withColumn("scan", F.lit(number))
        fresh.select(*[f.name for f in known.schema]).write.mode("append").parquet(path)
    own = keyed.select(*KEY)
    good = cached(spark, path).join(own, KEY, "left_semi").dropDuplicates(KEY)  # two scans at once may add the same
    bad = parsers.parse_files(keyed.filter("digest is null")).withColumn("scan", F.lit(number))
    return good.drop("digest").unionByName(bad), n
