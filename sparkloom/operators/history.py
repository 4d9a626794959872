"""Logs that only grow: values by key, health history, retention, the policy on attempts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def latest(log: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """The row of highest version for each key; aggregated before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    return log.groupBy(*keys).agg(F.max_by(row, version).alias("_row")).select("_row.*")


def with_previous(log: DataFrame, keys: list[str], order: list[Column], value: str, name: str = "previous") -> DataFrame:
    return log.withColumn(name, F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))


def deltas(log: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Adds delta: the value less the one before it; null for the first."""
    out = with_previous(log, keys, order, value, "_previous")
    return out.withColumn("delta", F.col(value) - F.col("_previous")).drop("_previous")


def retain(log: DataFrame, keys: list[str], newest_first: list[Column], most: int = 5) -> DataFrame:
    """The newest `most` rows of each key."""
    return log.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*newest_first))).filter(F.col("_at") <= most).drop("_at")


def changelog(history: DataFrame, fixes: DataFrame, pending: DataFrame, order: str = "at", generated: str | None = None) -> DataFrame:
    """One row `text`: a change log in Markdown, from logs with a column of their order: history
    (score), fixes (message, file), pending (item). Of the scores the last two are taken; items are joined."""
    two = history.select(F.col(order).alias("o"), F.col("score").alias("s")).orderBy(F.desc(order)).limit(2)
    both = two.agg(F.max_by("s", "o").alias("score"), F.min_by("s", "o").alias("before"), F.count("*").alias("n"))
    score = F.format_string("**Health score:** %.1f", F.col("score"))
    change = F.when(F.col("n") == 2, F.format_string(" (%+.1f from previous scan)", F.col("score") - F.col("before"))).otherwise("")
    stamp = F.lit(f"*Generated: {generated}*" if generated else None).cast("string")
    first = both.select(F.concat_ws("\n\n", stamp, F.when(F.col("n") > 0, F.concat(score, change))).alias("y")).select(F.nullif("y", F.lit("")).alias("x"))

    def items(rows: DataFrame, item: Column, title: str, nothing: str | None) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.lit("- "), item).alias("i"))))
        text = F.array_join(F.transform(listed, lambda x: x["i"]), "\n")
        return rows.agg(F.when(F.count("*") > 0, F.concat(F.lit(f"## {title}\n\n"), text)).otherwise(F.lit(f"## {title}\n\n{nothing}") if nothing else F.lit(None)).alias("x"))

    done = items(fixes, F.coalesce(F.nullif("message", F.lit("")), F.nullif("file", F.lit("")), F.lit("unknown")), "Fixes Applied", None)
    left = items(pending, F.col("item"), "Pending Fixes", "_None_")
    blocks = [F.lit("# Changes"), F.col("x"), done.scalar(), left.scalar()]
    return first.select(F.concat(F.concat_ws("\n\n", *blocks), F.lit("\n")).alias("text"))


def gate(n: Column, confirmed: Column, budget: int = 20, confirm_every: int = 5) -> Column:
    """What an attempt after n successes meets: blocked, checkpoint or allowed."""
    return F.when(n >= budget, "blocked").when(~confirmed & (n > 0) & (n % confirm_every == 0), "checkpoint").otherwise("allowed")


def gate_running(log: DataFrame, keys: list[str], order: list[Column], confirmed: Column, budget: int = 20, confirm_every: int = 5) -> DataFrame:
    """Adds n and decision where every attempt counts: a running count by a window."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return log.withColumn("n", n).withColumn("decision", gate(F.col("n"), confirmed, budget, confirm_every))


def _allowed(n: np.ndarray, confirmed: bool, budget: int, confirm_every: int) -> np.ndarray:
    return (n < budget) & (confirmed | (n % confirm_every != 0) | (n == 0))


def gate_exact(log: DataFrame, key: str, order: str, confirmed: str, budget: int = 20, confirm_every: int = 5) -> DataFrame:
    """(key, order, n, decision) where only allowed attempts count: a fold over each session in order.

    A piece of a session maps the count it begins with to the one it ends with; such maps compose, so a
    session may lie in many tasks. Attempts are dealt by ranges of (key, order). The first pass gives
    one row for each range: what its first session's piece makes of every count, and where its last
    one ends. From these the count that each range begins with follows, and the second pass decides.
    A null `confirmed` is none; attempts alike in key and order come in any order.
    """
    kinds = dict(log.dtypes)
    rows = log.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(confirmed), F.lit(False)).alias("ok"))
    ranged = cut_lineage(rows.repartitionByRange("k", "o").sortWithinPartitions("k", "o").withColumn("part", F.spark_partition_id()))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
        """Attempts of one session on end, and whether they begin it in this range."""
        last = None
        for b in batches:
            ids = b["k"].ne(b["k"].shift()) & ~(b["k"].isna() & b["k"].shift().isna())
            ids.iloc[0:1] = True
            for _, run in b.groupby(ids.cumsum()):
                k = run["k"].iloc[0]
                same = last is not None and (k == last[0] or (pd.isna(k) and pd.isna(last[0])))
                yield run, not same
                last = (k,)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, n, part, sessions, keys = np.arange(budget + 1), 0, None, 0, [None, None]
        for run, new in runs(batches):
            part, sessions = run["part"].iloc[0], sessions + new
            keys = [keys[0] if sessions > 1 or not new else run["k"].iloc[0], run["k"].iloc[0]]
            n = 0 if new else n
            for ok in run["ok"]:
                if sessions == 1:
                    first = first + _allowed(first, ok, budget, confirm_every)
                else:
                    n += int(_allowed(np.array(n), ok, budget, confirm_every))
        if part is not None:
            yield pd.DataFrame([(part, keys[0], keys[1], sessions == 1, first.tolist(), n)], columns=["part", "first", "last", "one", "exits", "n"])

    kind = kinds[key]
    pieces = ranged.mapInPandas(ends, f"part int, first {kind}, last {kind}, one boolean, exits array<long>, n long")
    begins, before = {}, None
    for r in sorted(pieces.collect(), key=lambda r: r["part"]):  # a row for each range
        begins[r["part"]] = before[1] if before and before[0] == r["first"] else 0
        before = (r["last"], r["exits"][begins[r["part"]]] if r["one"] else r["n"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sessions = 0, 0
        for run, new in runs(batches):
            sessions += new
            if new:
                n = begins[int(run["part"].iloc[0])] if sessions == 1 else 0
            out = []
            for k, o, ok in zip(run["k"], run["o"], run["ok"]):
                what = "blocked" if n >= budget else "allowed" if ok or n == 0 or n % confirm_every else "checkpoint"
                out.append((k, o, n, what))
                n += what == "allowed"
            yield pd.DataFrame(out, columns=[key, order, "n", "decision"])

    return ranged.mapInPandas(decide, f"`{key}` {kind}, `{order}` {kinds[order]}, n long, decision string")
