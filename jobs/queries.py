"""The jobs as queries: each runs twice into a folder of its own, and the whole output is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.queries import _sql_body

from . import fix_plan, scan_history
from .common import new_folder


def job1_fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to mend in each source of documents, in sessions, and each source's health."""
    out = new_folder(spark, "fix-plan")
    for _ in range(2):
        fix_plan.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{out}/plan")
    return fix_plan.read_back(spark, f"{out}/plan")


def job2_scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental scan of documents; its second run finds nothing new. A stream of one file has to be
    named by a pattern."""
    out = new_folder(spark, "scan-history")
    for _ in range(2):
        scan_history.run(spark, f"{sf_dir}/document[s].parquet", f"{out}/scans", f"{out}/checkpoint")
    return scan_history.read_back(spark, f"{out}/scans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_fix_plan, job2_scan_history)}

_SCORE = "greatest(0.0, round(100.0 - (least(30.0, {dup} * 100) + least(30.0, {dead} * 100) + least(20.0, {large} * 5.0)), 1))::DOUBLE"
_ROWS = f"r AS (SELECT doc_id, coalesce(nullif(source, ''), '(none)') AS source, len(string_split(text, chr(10))) AS lines, length(text) AS chars, {_sql_body()} AS body FROM documents WHERE text IS NOT NULL)"

ORACLES: dict[str, str] = {
    "job1_fix_plan": f"""WITH {_ROWS}, g AS (SELECT body, count(*) AS n, min(doc_id) AS first FROM r WHERE body <> '' GROUP BY body HAVING count(*) >= 2),
    k AS (SELECT r.*, coalesce(n - 1, 0) AS others, first FROM r LEFT JOIN g USING (body)),
    f AS (SELECT *, 'dead_code' AS finding FROM k WHERE body = '' UNION ALL SELECT *, 'duplicate' FROM k WHERE first <> doc_id UNION ALL SELECT *, 'god_file' FROM k WHERE lines > 100 OR chars > 20000),
    p AS (SELECT *, least(30, others * 6)::INTEGER AS inbound_refs, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 0 ELSE 20 END AS has_tests, CASE WHEN lines <= 50 THEN 5 WHEN lines <= 150 THEN 10 WHEN lines <= 300 THEN 17 ELSE 25 END AS lines_changed FROM f),
    s AS (SELECT *, inbound_refs + has_tests + lines_changed AS score FROM p),
    t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score, finding, doc_id) AS step FROM s),
    c AS (SELECT source, count(*) FILTER (finding = 'duplicate') AS copies, count(*) FILTER (finding = 'god_file') AS large, count(*) FILTER (finding = 'dead_code') AS dead FROM f GROUP BY source),
    h AS (SELECT source, count(*) AS files, sum(lines)::BIGINT AS lines, coalesce(any_value(copies), 0) AS copies, coalesce(any_value(large), 0) AS large, coalesce(any_value(dead), 0) AS dead FROM r LEFT JOIN c USING (source) GROUP BY source)
    SELECT doc_id, finding, CASE WHEN others > 0 THEN first END AS first_id, inbound_refs, has_tests, lines_changed, score, CASE WHEN score <= 30 THEN 'safe to fix' WHEN score <= 60 THEN 'fix with caution' ELSE 'manual review recommended' END AS recommendation,
        step, (step - 1) // 20 AS session, CASE WHEN (step - 1) % 20 > 0 AND (step - 1) % 20 % 5 = 0 THEN 'checkpoint' ELSE 'allowed' END AS decision,
        NULL::BIGINT AS files, NULL::BIGINT AS lines, NULL::BIGINT AS copies, NULL::BIGINT AS large, NULL::BIGINT AS dead, NULL::DOUBLE AS health, 'finding' AS record, source FROM t
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, files, lines, copies, large, dead, {_SCORE.format(dup="copies / files", dead="dead / files", large="large")}, 'source', source FROM h""",
    "job2_scan_history": f"""WITH d AS (SELECT doc_id, source, len(string_split(text, chr(10)))::INTEGER AS lines, length(text)::INTEGER AS chars, sha256({_sql_body()}) AS hash FROM documents),
    g AS (SELECT hash, min(doc_id) AS first_id FROM d WHERE hash IS NOT NULL GROUP BY hash),
    f AS (SELECT d.*, first_id, coalesce(first_id <> doc_id, false) AS copy FROM d LEFT JOIN g USING (hash)),
    t AS (SELECT count(*) AS n, coalesce(sum(lines), 0)::BIGINT AS l, count(*) FILTER (copy) AS c, count(*) FILTER (lines > 100 OR chars > 20000) AS g FROM f)
    SELECT doc_id, source, lines, chars, hash, first_id, copy, NULL::BIGINT AS total_files, NULL::BIGINT AS total_lines, NULL::BIGINT AS total_copies, NULL::BIGINT AS total_large, NULL::DOUBLE AS score, NULL::DOUBLE AS delta, 'file' AS kind, 0::BIGINT AS batch FROM f
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, n, l, c, g, {_SCORE.format(dup="c / greatest(n, 1)", dead="0", large="g")}, NULL, 'health', 0 FROM t""",
}
