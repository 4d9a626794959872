"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, comp) for every end of links (a, b): comp is the least v that it reaches.

    Each round takes the least label among neighbours and then the label of that label, so paths
    halve; rounds end when no label changes. Hubs are summed by partial aggregates, and their
    joins are split by adaptive execution. Null ends are left out.
    """
    pairs = links.select("a", "b").filter("a is not null and b is not null and a != b")
    edges = stored(pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("comp")), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels, edges["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "v").select("v", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        to = step.select(F.col("v").alias("w"), F.col("comp").alias("further"))
        jumped = step.join(to, step["comp"] == to["w"], "left").select("v", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "old")
        labels = stored(jumped, "labels")
        changed = not labels.filter("comp != old").isEmpty()
        labels = labels.select("v", "comp")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
