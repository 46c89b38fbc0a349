from pyspark.sql import functions as F

from mentia.operators.deliveries import SeenStore, canonical_id, surplus
from mentia.session import scratch

U = "7f1a2b3c-0001-4000-8000-00000000000"
ROWS = [
    ("a", U + "1", 10, 1), ("a", "{" + U.upper() + "1}", 9, 2), ("a", "urn:uuid:" + U + "1", 9, 3), ("a", U.replace("-", "") + "1\n", 30, 4),
    ("b", U + "1", 5, 5), ("a", None, 1, 6), ("a", None, 2, 7), ("a", "  ", 1, 8), ("a", "", 1, 9), ("a", " Job-7 ", 1, 10), ("a", "job-7", 2, 11),
]
DDL = "name string, ident string, received_at int, message_id long"


def test_surplus(spark):
    batch = spark.createDataFrame(ROWS, DDL)
    got = {(r.name, r.message_id) for r in surplus(batch, SeenStore(spark, scratch(spark, "seen"), shards=3)).collect()}
    assert got == {("a", 1), ("a", 3), ("a", 4), ("a", 11)}


def test_batches_and_lost_runs(spark):
    store = SeenStore(spark, scratch(spark, "seen"), shards=2)
    batch = spark.createDataFrame(ROWS, DDL)
    first = store.accept(batch.filter("message_id <= 2"))
    assert {r.message_id for r in first.collect()} == {2} and store.version() == 1
    # a run that wrote its tables but no mark is as if it never was
    store._fs.mkdirs(store._Path(store.path + "/dict-lost"))
    assert {r.message_id for r in surplus(batch.filter("message_id > 2"), store).collect()} == {3, 4, 11}
    assert store.version() == 2
    assert store.seen().select(F.sum(F.bitmap_count("bits"))).first()[0] == 3
    assert surplus(batch, store).count() == 7


def test_hot_identifier_and_empty(spark):
    batch = spark.range(2000).select(F.lit("a").alias("name"), F.lit("one").alias("ident"), F.lit(1).alias("received_at"), F.col("id").alias("message_id"))
    got = surplus(batch, SeenStore(spark, scratch(spark, "seen")))
    assert got.count() == 1999 and got.agg(F.min("message_id")).first()[0] == 1
    assert surplus(spark.createDataFrame([], DDL), SeenStore(spark, scratch(spark, "seen"))).count() == 0


def test_canonical(spark):
    ids = [U + "1", "{" + U + "1}", None, " "]
    df = spark.createDataFrame([(i,) for i in ids], "i string").select(canonical_id(F.col("i")).alias("c"))
    assert [r.c for r in df.collect()] == [U.replace("-", "") + "1"] * 2 + [None, None]
