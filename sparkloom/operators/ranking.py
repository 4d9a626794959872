"""Places within groups, also where one group holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds the place (from 1) of each row in its group, as row_number would. Rows are dealt by ranges of
    (group, order), so a large group is spread over many tasks; rows are counted by range and group,
    and only these counts are summed up group by group. Rows alike in `order` get any order."""
    ranged = stored(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n")).withColumn("_before", before)
    counts = counts.select(F.col("_range").alias("_r"), "_before", *[F.col(g).alias(f"_g_{g}") for g in group])
    same = F.col("_range") == F.col("_r")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    nth = F.row_number().over(W.partitionBy("_range", *group).orderBy(*order))
    out = ranged.withColumn("_nth", nth).join(counts, same)
    return out.withColumn(name, F.col("_before") + F.col("_nth")).select(*rows.columns, name)
