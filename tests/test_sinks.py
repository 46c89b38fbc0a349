import json

import pytest
from pyspark.sql import functions as F

from mentia.boolean.language import Compiler, SearchCompiler, parse
from mentia.operators.deliveries import SeenStore
from mentia.operators.folds import pool_tokens
from mentia.session import scratch
from mentia.sources import feeds, providers as P, sinks as K
from mentia.streaming import pipeline as S

FEED = """<rss><channel><item><title>Long queues</title><link>https://a.example/X</link></item><item><title>long queues again</title><link>https://a.example/x</link></item>
<item><title>Weather</title><link>https://old.reddit.com/r/b/comments/q1/t</link></item><item><title>Queues</title><link>https://m.tiktok.com/v</link></item></channel></rss>"""


def landed(spark):
    return spark.createDataFrame([(1, FEED, "https://f.example/")], "seq int, xml string, feed_url string")


def urls(df):
    return [r.url for r in df.collect()]


def test_providers(spark):
    assert urls(P.configured_feeds(landed(spark), '"long queues"')) == ["https://a.example/X", "https://a.example/x"] and len(urls(P.configured_feeds(landed(spark), "queues", 1))) == 1
    assert urls(P.tag_feeds(landed(spark), '"long queues"')) == ["https://a.example/X"]
    assert urls(P.forum_feeds(landed(spark))) == ["https://www.reddit.com/r/b/comments/q1/t"]
    assert urls(P.social_feeds(landed(spark), "tiktok")) == ["https://m.tiktok.com/v"] and urls(P.social_feeds(landed(spark), "linkedin")) == []
    assert len(urls(P.news_feeds(landed(spark)))) == 3
    assert feeds.requested("web_search", 500) == 20 and feeds.requested("post_search", 1) == 10


def test_a_provider_that_fails_while_it_runs_ends_no_other(spark):
    late = lambda s: s.range(3).select(F.lit("web").alias("source"), F.raise_error(F.lit("down")).cast("string").alias("url"))
    good = lambda s: s.createDataFrame([("web", "https://a.example/")], "source string, url string")
    assert [r.rank_no for r in feeds.discover(spark, {"a": late, "b": good}).collect()] == [2]


def test_compilers():
    tree = parse('"Acme Corp" (refund OR x)')
    assert Compiler().compile(tree) == '"Acme Corp" AND (refund OR x)' and SearchCompiler().compile(tree) == '"Acme Corp" OR refund'


def test_put_absent_envelope_and_cache(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    assert K.put_absent(rows, path, ["k"], [F.col("n")]).count() == 2
    assert [tuple(r) for r in K.put_absent(spark.createDataFrame([("a", 9), ("c", 4)], "k string, n int"), path, ["k"], [F.col("n")]).collect()] == [("c", 4)]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    jobs = K.envelope(rows.withColumns({"tenant_id": F.lit("t"), "monitor_id": F.lit(None).cast("string")}), ["k", "n"], F.lit("normal"), F.lit("2024-01-01").cast("timestamp")).collect()
    assert len({j.job_id for j in jobs}) == 3 and json.loads(jobs[0].payload) == {"k": "a", "n": 1}
    cache = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:09:00")], "i int, t string").withColumn("fetched_at", F.col("t").cast("timestamp"))
    assert [r.i for r in K.cached(cache, F.lit("2024-01-01 00:10:00")).collect()] == [2]
    K.append(cache, str(tmp_path / "log"), "fetched_at")
    assert json.loads(K.log_line("x", n=1)) == {"event": "x", "n": 1}


def test_pool_tokens(spark):
    rows = [(k, k, "release" if k == 3 else "acquire") for k in range(6)]
    df = spark.createDataFrame([("p", *r) for r in rows], "pool string, at_ms long, seq long, kind string")
    assert [(r.seq, r.granted) for r in pool_tokens(df, most=2).orderBy("seq").collect()] == [(0, True), (1, True), (2, False), (4, True), (5, False)]


def test_a_batch_lost_between_commit_and_write_is_written_again(spark, root, tmp_path):
    jobs = spark.read.parquet(f"{root}/crawl_jobs.parquet")
    jobs.coalesce(1).write.parquet(str(tmp_path / "jobs"))
    store, out, lost = SeenStore(spark, scratch(spark, "once")), str(tmp_path / "out"), []

    def write(df, number):
        if not lost:
            lost.append(number)
            raise OSError("lost after the commit")
        df.write.mode("overwrite").parquet(f"{out}/{number}")

    with pytest.raises(Exception):
        S.once_only(S.landed(spark, str(tmp_path / "jobs"), jobs.schema, 1), store, write, str(tmp_path / "cp")).awaitTermination()
    assert store.version() == 1
    S.once_only(S.landed(spark, str(tmp_path / "jobs"), jobs.schema, 1), store, write, str(tmp_path / "cp")).awaitTermination()
    assert store.version() == 1 and spark.read.parquet(out + "/*").count() == store.dictionary().count() > 0


def test_marks_are_exclusive_and_bitmaps_merge(spark, monkeypatch):
    from mentia.operators import deliveries as D

    monkeypatch.setattr(D, "MERGE", 2)
    store = SeenStore(spark, scratch(spark, "seen"), shards=2)
    for k in range(5):
        rows = spark.range(k * 10, k * 10 + 15).selectExpr("'a' as name", "concat('i', id) as ident", "id as received_at", "id as message_id")
        assert store.accept(rows, f"b{k}").count() == (15 if k == 0 else 10)
    assert store.seen().select(F.sum(F.bitmap_count("bits"))).first()[0] == 55 == store.dictionary().select("shard", "code").distinct().count()
    assert store.accept(rows, "b4").count() == 10 and store.version() == 5
    with pytest.raises(RuntimeError):
        store._commit(5, "x")


def test_dead_letters_and_stream_join(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "2024-01-01 00:00:00"), (2, None, "2024-01-01 00:05:00")], "k int, v string, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    good = str(tmp_path / "good")
    S.with_dead_letters(S.landed(spark, str(tmp_path / "in"), rows.schema), F.col("v").isNotNull(), lambda df, n: df.write.mode("overwrite").parquet(f"{good}/{n}"), str(tmp_path / "dead"), str(tmp_path / "c1")).awaitTermination()
    assert [r.k for r in spark.read.parquet(good + "/*").collect()] == [1] and [r.k for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [2]

    def fails(df, n):
        raise OSError("no")

    S.with_dead_letters(S.landed(spark, str(tmp_path / "in"), rows.schema), F.lit(True), fails, str(tmp_path / "dead2"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "dead2")).count() == 2
    left = S.landed(spark, str(tmp_path / "in"), rows.schema).select("k", F.col("t").alias("lt"))
    right = S.landed(spark, str(tmp_path / "in"), rows.schema).select("k", "v", (F.col("t") + F.expr("interval 10 minutes")).alias("rt"))
    q = S.matched_in_time(left, right, "k", ("lt", "rt")).writeStream.format("memory").queryName("met").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from met").count() == 2
