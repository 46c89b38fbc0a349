import pytest
from pyspark.sql import functions as F

from mentia.llm import mixing as M


def test_permutation(spark):
    for size in (1, 2, 7, 100, 101):
        got = [r.p for r in spark.range(size).select(M.permuted(F.col("id"), F.lit(size), F.lit("s")).alias("p")).collect()]
        assert sorted(got) == list(range(size))
    assert got != list(range(101))


def test_blocks_hold_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(M, "RUN", 4)
    rows = [(s, 10 * i + (s == "b"), n) for s, sizes in (("a", [5, 30, 1, 12, 7, 8]), ("b", [64])) for i, n in enumerate(sizes)]
    counted = spark.createDataFrame(rows, "source string, doc_id long, n_tokens long")
    got = M.blocks_of(counted, 16).collect()
    per_doc, per_block = {}, {}
    for r in got:
        per_doc.setdefault(r.doc_id, []).append((r["first"], r.n))
        per_block[r.source, r.block] = per_block.get((r.source, r.block), 0) + r.n
    for s, d, n in rows:
        at = 0
        for first, size in sorted(per_doc[d]):
            assert first == at
            at += size
        assert at == n
    assert [per_block["a", b] for b in range(4)] == [16, 16, 16, 15] and [per_block["b", b] for b in range(4)] == [16] * 4


def test_shares_and_caps(spark):
    docs = spark.createDataFrame([(i, f"word{i} and some more words of a text " * 8, "big" if i % 3 else "small") for i in range(600)] + [(700, None, "big"), (701, "", "small"), (702, "x", "other")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.6, 1), ("m", "small", 0.3, 2), ("m", "gone", 0.1, 5), ("m", None, 0.1, 1)], "mix_name string, source string, target_share double, max_repeats long")
    mixed = M.mix(docs, targets, block=32, slots=64)
    got = {r.source: r for r in M.shares(mixed, targets).collect()}
    assert got["big"].actual_share == pytest.approx(2 / 3, abs=0.06) and got["gone"].tokens == 0
    assert got["big"].most_repeats <= 1 and got["small"].most_repeats <= 2
    slots = mixed.select("shard", "slot", "source", "repeat", "block").distinct()
    assert slots.count() == mixed.select("shard", "slot").distinct().count() == slots.select("source", "repeat", "block").distinct().count()
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, M.mix(docs, targets, block=32, slots=64).collect()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats long")
    assert M.mix(docs, targets).count() == 0 and M.shares(M.mix(docs, targets), targets).first().tokens == 0
