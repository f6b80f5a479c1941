"""Streaming results equal the batch ones once all input is read."""

from lodestone.streaming import rolling
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def run(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_hourly(spark, tmp_path):
    events, live = stream(spark, tmp_path)
    out = run(rolling.hourly(live), "hourly", "complete", tmp_path)
    assert out.agg(F.sum("n")).first()[0] == events.count()


def test_states(spark, tmp_path):
    events, live = stream(spark, tmp_path)
    out = {r["user_id"]: r["state"] for r in run(rolling.run_states(live), "states", "update", tmp_path).collect()}
    want = {r["user_id"]: r["s"] for r in events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("s")).collect()}
    assert out == want


def test_deliveries(spark, tmp_path):
    events, live = stream(spark, tmp_path)
    out = run(rolling.deliveries(live.unionByName(live)), "deliveries", "append", tmp_path)
    assert out.count() == events.count()
