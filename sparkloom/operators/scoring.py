"""Scores: health of a tree, risk of a change, likely architecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.text import basename, stem


def clamp_score(dup_ratio: Column, dead_ratio: Column, gods: Column, cycles: Column) -> Column:
    """100 less what duplicates, dead code (30 each), large files and cycles (20 each) cost."""
    lost = F.least(F.lit(30.0), dup_ratio * 100) + F.least(F.lit(30.0), dead_ratio * 100) + F.least(F.lit(20.0), gods * 5.0) + F.least(F.lit(20.0), cycles * 10.0)
    return F.greatest(F.lit(0.0), F.round(F.lit(100.0) - lost, 1))


def health(total_functions: DataFrame, dead: DataFrame, duplicates: DataFrame, gods: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row from one-row tables, each with a column n: score, ratios and counts."""
    parts = {"dead": dead, "dup": duplicates, "gods": gods, "cycles": cycles}
    row = total_functions.select(F.col("n").alias("fn"), *[df.select("n").scalar().alias(name) for name, df in parts.items()])
    least = F.greatest(F.col("fn"), F.lit(1))
    dead_ratio, dup_ratio = F.col("dead") / least, F.col("dup") / least
    return row.select(
        clamp_score(dup_ratio, dead_ratio, F.col("gods"), F.col("cycles")).alias("score"),
        F.round(dead_ratio, 3).alias("dead_code_ratio"),
        F.round(dup_ratio, 3).alias("duplicate_ratio"),
        F.col("gods").alias("god_file_count"),
        F.col("cycles").alias("circular_count"),
    )


def risk_parts(inbound: Column, tested: Column, lines: Column, circular: Column) -> dict[str, Column]:
    return {
        "inbound_refs": F.least(F.lit(30), F.coalesce(inbound, F.lit(0)) * 6).cast("int"),
        "has_tests": F.when(tested, 0).otherwise(20),
        "lines_changed": F.when(lines <= 50, 5).when(lines <= 150, 10).when(lines <= 300, 17).otherwise(25),
        "is_circular": F.when(circular, 25).otherwise(0),
    }


def recommendation(score: Column) -> Column:
    return F.when(score <= 30, "safe to fix").when(score <= 60, "fix with caution").otherwise("manual review recommended")


def risk(rows: DataFrame, inbound: Column, tested: Column, lines: Column, circular: Column) -> DataFrame:
    """rows with the four parts, score and recommendation: all changes at once, by expressions."""
    out = rows.withColumns(risk_parts(inbound, tested, lines, circular))
    out = out.withColumn("score", F.col("inbound_refs") + F.col("has_tests") + F.col("lines_changed") + F.col("is_circular"))
    return out.withColumn("recommendation", recommendation(F.col("score")))


def risk_of(targets: DataFrame, edges: DataFrame, nodes: DataFrame, cycle_files: DataFrame, dead: DataFrame, gods: DataFrame, summary: DataFrame, calls: DataFrame | None = None, mode: str = "intended") -> DataFrame:
    """Risk of changing (symbol, file) rows of a scan.

    A symbol counts as tested if it is not dead and a test file calls it (intended, given calls),
    or if there is any test file of another stem (compat). Lines are the file's if it is large,
    else the average over the scan.
    """
    from .graph import in_degree

    degree = in_degree(edges, mode).withColumnRenamed("file", "_f")
    out = targets.join(degree, targets["file"] == degree["_f"], "left").drop("_f")
    gone = dead.select(F.lower("symbol").alias("_s")).distinct().withColumn("_dead", F.lit(True))
    out = out.join(gone, F.lower("symbol") == F.col("_s"), "left").drop("_s")
    if mode == "intended" and calls is not None:
        by_test = calls.filter(F.lower("file").contains("test")).select(F.col("name").alias("_s"), F.col("file").alias("_t")).distinct()
        by_test = by_test.withColumn("_ts", stem(F.col("_t"))).groupBy("_s").agg(F.min("_ts").alias("_lo"), F.max("_ts").alias("_hi"))
        out = out.join(by_test, F.col("symbol") == F.col("_s"), "left").drop("_s")
    else:
        tests = nodes.filter(F.lower("file").contains("test")).agg(F.min(stem(F.col("file"))).alias("_lo"), F.max(stem(F.col("file"))).alias("_hi"))
        out = out.withColumns({c: tests.select(c).scalar() for c in ("_lo", "_hi")})
    own = stem(F.col("file"))
    tested = F.coalesce((F.col("_lo") != own) | (F.col("_hi") != own), F.lit(False)) & F.col("_dead").isNull()
    cyc = cycle_files.select(F.col("file").alias("_c")).distinct()
    out = out.join(cyc, out["file"] == cyc["_c"], "left")
    god = gods.groupBy(F.col("file").alias("_g")).agg(F.min("lines").alias("_lines"))
    out = out.join(god, out["file"] == god["_g"], "left")
    average = summary.select((F.col("total_lines") / F.greatest(F.col("total_files"), F.lit(1))).alias("_average"))
    out = out.withColumn("_average", average.scalar())
    scored = risk(out, F.col("inbound"), tested, F.coalesce(F.col("_lines").cast("double"), F.col("_average")), F.col("_c").isNotNull())
    return scored.select(*targets.columns, "inbound_refs", "has_tests", "lines_changed", "is_circular", "score", "recommendation")


def marker_shares(names: DataFrame, name: Column, classes: tuple = T.ARCHITECTURES) -> DataFrame:
    """One row: for each class the share of names that hold one of its markers, class_0, …."""

    def hit(markers: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for m in markers:
            out = out | name.contains(m)
        return F.coalesce(F.sum(out.cast("int")), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))

    return names.agg(*[hit(m).alias(f"class_{k}") for k, (_, m) in enumerate(classes)])


def ordered_distinct(rows: DataFrame, value: Column, order: Column) -> DataFrame:
    """(value, first): distinct values with the least order of each."""
    return rows.groupBy(value.alias("value")).agg(F.min(order).alias("first"))


def architecture(files: DataFrame, languages: list[str]) -> DataFrame:
    """One row on (file, ordinal) rows: pattern, entry_points, inferred_modules, confidence,
    hypothesis. Ties between classes go to the earlier one."""
    base = files.select("file", "ordinal", F.lower(basename(F.col("file"))).alias("b")).withColumn("s", stem(F.col("b")))
    script, python = any(x in ("javascript", "typescript") for x in languages), "python" in languages
    bonus = [0.0, 0.0, 0.05 if python and not script else 0.0, 0.2 if script and not python else 0.0]
    scores = [(F.col(f"class_{k}") + F.lit(bonus[k])) for k in range(4)]
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("k"), F.lit(T.ARCHITECTURES[k][0]).alias("name")) for k, s in enumerate(scores)]))
    shares = marker_shares(base, F.col("s")).select(best.alias("best"))

    def gathered(rows: DataFrame, value: str, most: int | None, name: str) -> DataFrame:
        found = ordered_distinct(rows, F.col(value), F.col("ordinal"))
        found = found.orderBy("first").limit(most) if most else found  # entry points are a handful of names
        return found.agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]).alias(name))

    entries = gathered(base.filter(F.col("s").isin(*T.ENTRY_POINT_STEMS)), "file", None, "entry_points")
    modules = base.filter((F.col("s") != "") & ~F.col("s").isin(*T.MODULES_SKIPPED) & ~F.col("s").startswith("test_"))
    row = shares.select("best", entries.scalar().alias("entry_points"), gathered(modules, "s", 20, "inferred_modules").scalar().alias("inferred_modules"))
    spoken = ", ".join(languages) or "unknown language"
    entry_text = F.when(
        F.size("entry_points") > 0,
        F.concat(F.lit("Entry point"), F.when(F.size("entry_points") != 1, "s").otherwise(""), F.lit(": "), F.array_join(F.slice("entry_points", 1, 3), ", "), F.lit(".")),
    ).otherwise("No clear entry point detected.")
    module_text = F.when(F.size("inferred_modules") > 0, F.concat(F.lit("Logical modules include: "), F.array_join(F.slice("inferred_modules", 1, 5), ", "), F.lit("."))).otherwise("")
    return row.select(
        F.col("best.name").alias("pattern"),
        "entry_points",
        "inferred_modules",
        F.least(F.lit(1.0), F.round(F.col("best.score") * 3 + 0.2, 2)).alias("confidence"),
        F.trim(F.concat(F.lit("This appears to be a "), F.col("best.name"), F.lit(f" written in {spoken}. "), entry_text, F.lit(" "), module_text)).alias("hypothesis"),
    )
