from pyspark.sql import functions as F

from plumbline.streaming.monitor import step_monitor, windowed_counts


def test_steps_are_watched_across_batches(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "s string, t double, n int"
    spark.createDataFrame([("a", 0.0, 1), ("a", 0.1, 2), ("b", 5.0, 1)], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    q = step_monitor(stream, "s", "t", "n").writeStream.format("memory").queryName("steps").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame([("a", 2.0, 3), ("a", 2.0, 4), ("b", 4.0, 2), ("b", None, 3)], schema).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    got = {(r.stream, r.check_name.removeprefix("check_"), round(r.gap_sec, 3)) for r in spark.sql("SELECT * FROM steps").collect()}
    assert got == {("a", "large_timestamp_gaps", 1.9), ("a", "duplicate_timestamps", 0.0), ("b", "monotonic_timestamps", -1.0)}


def test_windowed_counts(spark):
    df = spark.range(10).select(F.timestamp_seconds(F.col("id") * 1000).alias("ts"), F.lit("x").alias("k"))
    assert sum(r.n for r in windowed_counts(df, "ts", "k").collect()) == 10
