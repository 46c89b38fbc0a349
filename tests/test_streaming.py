from pyspark.sql import functions as F

from mentia.operators.deliveries import SeenStore
from mentia.operators.timely import rates
from mentia.session import scratch
from mentia.streaming import pipeline as S


def drain(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.sql(f"select * from {name}")


def events(spark, root, tmp_path):
    rows = spark.read.parquet(f"{root}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    return rows, S.landed(spark, str(tmp_path / "in"), rows.schema)


def test_windows_equal_batch(spark, root, tmp_path):
    rows, stream = events(spark, root, tmp_path)
    got = drain(S.windowed_rates(stream, "ts", ["event_type"], late="60 days"), "complete", "w1")
    assert sorted(map(tuple, got.select("event_type", "window_start", "n").collect())) == sorted(map(tuple, rates(rows, "ts", ["event_type"]).collect()))


def test_sessions_and_state(spark, root, tmp_path):
    rows, stream = events(spark, root, tmp_path)
    assert drain(S.sessions(stream, "ts", "user_id", late="60 days"), "complete", "s1").agg(F.sum("n")).first()[0] == rows.count()
    last = {r.user_id: r.ts for r in rows.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    got = drain(S.latest_by_key(stream, "user_id", "ts", "value"), "update", "l1").groupBy("user_id").agg(F.max("ts").alias("ts")).collect()
    assert {r.user_id: r.ts for r in got} == last


def test_once_only_and_again(spark, root, tmp_path):
    jobs = spark.read.parquet(f"{root}/crawl_jobs.parquet")
    jobs.repartition(3).write.parquet(str(tmp_path / "jobs"))
    store, out = SeenStore(spark, scratch(spark, "once")), str(tmp_path / "out")

    def write(df, number):
        df.write.mode("overwrite").parquet(f"{out}/{number}")

    for turn in range(2):  # the second run starts without a checkpoint, as after its loss
        S.once_only(S.landed(spark, str(tmp_path / "jobs"), jobs.schema, 1), store, write, str(tmp_path / f"cp{turn}")).awaitTermination()
    kept = spark.read.parquet(out + "/*")
    assert kept.count() == kept.select("message_id").distinct().count() == store.dictionary().count()
