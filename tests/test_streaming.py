from pyspark.sql import functions as F
from wattloom.streaming.ingest import follow_measurements, power_windows


def test_late_runs_replace_their_partition(spark, tmp_path):
    schema = "design string, build string, fub string, be_mw double"
    for i, value in enumerate((1.0, 2.0)):
        spark.createDataFrame([("d", "B1", "f", value), ("d", f"B{i + 2}", "f", 5.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        follow_measurements(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.build: r.be_mw for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"B1": 2.0, "B2": 5.0, "B3": 5.0}


def test_windows_equal_a_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value").withColumn("ts", F.to_timestamp_ltz("ts"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = power_windows(stream).writeStream.format("memory").queryName("power").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted((r.workload, r.t_start, r.n, round(r.mean_mw, 9), r.peak_mw) for r in df.collect())
    assert key(spark.table("power")) == key(power_windows(events))
