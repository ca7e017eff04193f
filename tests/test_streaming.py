import pytest
from pyspark.sql import functions as F

from tarnlight.operators import charts
from tarnlight.streaming.periods import rows_per_period


def test_stream_equals_batch(spark, tmp_path):
    base = spark.range(500).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 90 as int))").alias("t"))
    for i in range(2):
        base.where(f"pmod(hash(t), 2) = {i}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rows_per_period(stream, "t", "week").writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r["period"])[:10], r["n"]) for r in spark.table("weeks").collect()}
    assert got == {(str(r["period"]), r["n"]) for r in charts.rows_per_period(base, "t", "week").collect()}
    with pytest.raises(ValueError):
        rows_per_period(stream, "t", "hour")
