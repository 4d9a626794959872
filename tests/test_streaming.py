import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import history
from sparkloom.streaming import attempts


def test_gate_over_a_stream_is_the_gate_over_the_table(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 3).alias("s"), F.col("id").alias("i"), (F.col("id") % 11 == 0).alias("ok"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s long, i long, ok boolean").parquet(str(tmp_path / "in"))
    q = attempts.gated(stream, "s", "i", "ok").writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = history.gate_exact(rows, "s", "i", "ok")
    assert sorted(map(tuple, spark.table("gated").collect())) == sorted(map(tuple, want.collect()))


def test_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'b'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = attempts.windowed(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["kind"], r["n"]) for r in spark.table("wins").collect()) == [("a", 2), ("b", 1)]


def run_to_end(stream, out, mark):
    stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()


@pytest.fixture
def data_alone(spark):
    """Batches without data go on for as long as there are sessions to expire, so a run that is to end has none."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("ttl", [None, 3600])
def test_a_gate_over_two_runs_is_the_gate_over_the_table(spark, tmp_path, data_alone, ttl):
    at, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.range(120).selectExpr("id % 4 AS s", "id AS i", "IF(id % 7 = 0, NULL, id % 11 = 0) AS ok")
    for low, high in ((0, 50), (50, 120)):
        rows.filter(f"i >= {low} and i < {high}").coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema("s long, i long, ok boolean").parquet(at)
        run_to_end(attempts.gated(stream, "s", "i", "ok", ttl_seconds=ttl), out, mark)
    want = history.gate_exact(rows, "s", "i", "ok")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_an_idle_session_begins_anew(spark, tmp_path, data_alone):
    at, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for k in (0, 1):
        spark.range(5 * k, 5 * k + 5).selectExpr("1L AS s", "id AS i", "true AS ok").coalesce(1).write.mode("append").parquet(at)
        run_to_end(attempts.gated(spark.readStream.schema("s long, i long, ok boolean").parquet(at), "s", "i", "ok", 3, ttl_seconds=2), out, mark)
        time.sleep(0 if k else 4)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert [r[2:] for r in got] == 2 * [(0, "allowed"), (1, "allowed"), (2, "allowed"), (3, "blocked"), (3, "blocked")]
