from pyspark.sql import functions as F

from tamizal.streaming import latency as W


def test_stream_equals_batch(spark, data, tmp_path):
    path = f"{data}/events.parquet"
    batch = spark.read.parquet(path).select("ts", "event_type", "value")
    src = tmp_path / "in"
    batch.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = W.windowed(stream, late="400 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    a = {(r["begins"], r["event_type"]): r["n"] for r in spark.table("w").collect()}
    b = {(r["begins"], r["event_type"]): r["n"] for r in W.windowed(batch).collect()}
    assert a == b


def test_append_log(spark, data, tmp_path):
    src = tmp_path / "in"
    e = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type", "value")
    e.write.parquet(str(src))
    stream = spark.readStream.schema(e.schema).parquet(str(src))
    for _ in range(2):  # a second run finds nothing new
        W.append_log(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == e.count()


def test_cached_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("1", "hola", "a"), ("2", "otra", "b")], "key string, norm string, answer string").coalesce(1).write.parquet(str(src))
    spark.createDataFrame([("3", "hola", "c")], "key string, norm string, answer string").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("key string, norm string, answer string").parquet(str(src))
    q = W.cached_stream(stream).writeStream.format("memory").queryName("c").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.table("c").groupBy("hit").agg(F.count("*")).orderBy("hit").collect()]
    assert got == [(False, 2), (True, 1)]
