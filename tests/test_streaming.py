import random

from pyspark.sql import functions as F

from stemma.operators.relations import event_log
from stemma.streaming import joblog


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(7)
    rows = [(f"k{r.randint(0, 5)}", i, r.choice(["queued", "running", "running", "done"])) for i in range(200)]
    for n in range(4):  # four files, in the order of their events
        spark.createDataFrame(rows[n * 50 : n * 50 + 50], "key string, event_id long, state string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, event_id long, state string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = joblog.log_events(stream, ("done",)).writeStream.format("memory").queryName("joblog").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(x) for x in spark.table("joblog").select("key", "sequence", "event_id", "state").collect()}
    batch = event_log(spark.createDataFrame(rows, "key string, event_id long, state string"), "key", ["event_id"], ["state"], F.col("state") == "done")
    last = {}
    want = set()
    for k, e, s in rows:
        n, state, over = last.get(k, (0, None, False))
        if not over and s != state:
            last[k] = (n + 1, s, s == "done")
            want.add((k, n + 1, e, s))
    assert got == want == {tuple(x) for x in batch.select("key", "sequence", "event_id", "state").collect()}
    log = spark.table("joblog").where("key = 'k0'")
    assert joblog.replay(log, 1).count() == log.count() - 1


def test_windows(spark, tmp_path):
    e = spark.createDataFrame([(i, i * 300, "a" if i % 2 else "b", 1.0) for i in range(50)], "user_id long, s long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    for name, df in (("tumble", joblog.windowed_counts(stream)), ("sessions", joblog.session_counts(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumble" else "append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("tumble").agg(F.sum("n")).first()[0] == 50


def test_generations(spark, tmp_path):
    for n in range(2):
        spark.createDataFrame([("p", f"h{n}", n), ("p", "same", n)], "person string, hash string, generation int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("person string, hash string, generation int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    joblog.apply_snapshots(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert {r["hash"] for r in spark.read.parquet(str(tmp_path / "state/generation=1")).collect()} == {"h0", "h1", "same"}
