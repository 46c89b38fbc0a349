import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from mentia.llm import reading as R


def test_bands_of_documents(spark, root):
    folder = f"{root}/../sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/reading_labels.parquet")
    got = {r.doc_id: r.band for r in R.reading_bands(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    enough = {d for d, t in texts.items() if t and sum(c.isalpha() for c in t) >= 10}
    assert set(got) == enough and set(got.values()) <= {1, 2, 3}
    graded = {r.doc_id: r.band for r in labels.collect()}
    assert np.mean([got[d] == b for d, b in graded.items() if d in got]) > 0.85


def test_held_out_accuracy(root):
    folder = f"{root}/../sf0.1"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    labels = [(r["doc_id"], r["band"]) for r in pq.read_table(f"{folder}/reading_labels.parquet").to_pylist() if texts.get(r["doc_id"])]
    counts = np.zeros(R.ROWS * R.CELLS)
    for t in texts.values():
        for w in R._plain(t or ""):
            counts[R.cells(w)] += 1
    known = R.Words(np.log(counts.sum() / R.ROWS + 1) - np.log(counts + 1))
    x, y = np.array([R.features(texts[d], known) for d, _ in labels]), np.array([b for _, b in labels])
    held = np.arange(len(y)) % 4 == 0
    assert (R.fit(x[~held], y[~held]).bands(x[held]) == y[held]).mean() > 0.88


def test_diversity_reads_to_the_last_word():
    first, letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)], R.Words(np.zeros(R.ROWS * R.CELLS))
    of = lambda words: R.features(" ".join(words), letters)[4]
    assert of(first[:30]) == of(first) == of(first * 2) == 1
    assert of(first + ["same"] * 59) < 1 and of(first * 2 + ["same"] * 59) < 1


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "12 ...", "c"), (4, "a" * 20_000, "c"), (4, "Ten letters here.", "c")], "doc_id long, text string, band string")
    labels = spark.createDataFrame([(4, 1), (9, 2), (4, 7)], "doc_id long, band long")
    assert sorted(r.doc_id for r in R.reading_bands(docs, labels).collect()) == [4, 4]
    assert R.reading_bands(docs, labels.limit(0)).count() == 0 and R.reading_bands(docs.limit(0), labels).count() == 0


def plainly(text, known):
    """FEATURES of a text by patterns over that text alone."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    n = max(len(words), 1)
    facts = [(len(w), known.rarity[R.cells(w)].max(), w in R._JOINING) for w in words] or [(0, 0, False)]
    lengths, surprise, joins = map(np.array, zip(*facts))
    sentences = [k for p in re.split(r"[.!?…]+(?:\s|$)|\n+", text) if (k := len(re.findall(r"[^\W\d_]+", p)))] or [0]
    windows = [(words or [""])[i : i + 60] for i in (*range(0, n - 60, 60), max(n - 60, 0))]
    diversity = np.mean([len(set(w)) for w in windows]) / min(n, 60)
    hapax = sum(k == 1 for k in Counter(words or [""]).values())
    clauses, digits = len(re.findall(r"[,;:()–—]", text)), len(re.findall(r"\d", text))
    return [math.log1p(n), lengths.mean(), (lengths >= 9).mean(), (lengths >= 12).mean(), diversity, surprise.mean(), (surprise > 9).mean(), surprise.std(), joins.mean(), clauses / n, math.log1p(np.mean(sentences)), math.log1p(np.std(sentences)), digits / n, hapax / n]


def test_blocks_give_what_single_texts_give(root, monkeypatch):
    texts = [r["text"] for r in pq.read_table(f"{root}/../sf0.001/documents.parquet").to_pylist() if r["text"]]
    signs = [*"aßΣΟ'.!?…  \n\r\x1c_1٣²Ⅷ,;()–̇", "İ", "because", "\U00010400", "\U0001d7d8", "\ud800"]
    pick = random.Random(3)
    texts += ["".join(pick.choices(signs, k=pick.randint(0, 300))) for _ in range(300)] + ["", "\n", "12 ...", "İstanbul. İzmir!", "end.", "end.\n\n", " ".join(map(str, range(99)))]
    texts += [" ".join("".join(pick.choices("abc", k=2)) for _ in range(n)) for n in (59, 60, 61, 119, 120, 121, 180, 7000)]
    known = R.Words(np.random.default_rng(1).random(R.ROWS * R.CELLS) * 14)
    expected = np.array([plainly(t, known) for t in texts])
    for block in (1, 1000, R.BLOCK):
        monkeypatch.setattr(R, "BLOCK", block)
        assert np.allclose(R.feature_rows(texts, known), expected, rtol=0, atol=1e-9)
    assert R.feature_rows([], known).shape == (0, len(R.FEATURES))


def test_more_words_than_are_remembered(monkeypatch):
    monkeypatch.setattr(R, "KNOWN", 50)
    monkeypatch.setattr(R, "BLOCK", 200)
    pick = random.Random(4)
    texts = [" ".join("".join(pick.choices("abcdefgh", k=3)) for _ in range(n)) for n in (5, 30, 200, 7, 40, 70_000, 3, 90)]
    known = R.Words(np.random.default_rng(1).random(R.ROWS * R.CELLS) * 14)
    assert np.allclose(R.feature_rows(texts, known), [plainly(t, known) for t in texts], rtol=0, atol=1e-9)
    # numbers of more than 16 bits
    numbers, owner = np.array([70_000, 4_464, 70_000, 4_464, 1]), np.array([0, 0, 0, 1, 1])
    last, only = R._last_and_only(numbers, owner)
    assert last.tolist() == [-1, -1, 0, -1, -1] and only.tolist() == [False, True, False, True, True]


def test_counts_are_of_all_words(spark):
    texts = ["One word, and one word more.", None, "", "word İz 12", "one " * 50]
    counts = R.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    expected = np.zeros(R.ROWS * R.CELLS)
    for w in [w for t in texts if t for w in re.findall(r"[^\W\d_]+", t.lower())]:
        expected[R.cells(w)] += 1
    assert (counts == expected).all()


def test_ten_letters(spark):
    texts = ["abcdefghi", "abcdefghij", "1a.b-c d\ne f g h i 𝒋", "é" * 10, "é" * 9, "²" * 20, "." * 50_000 + "abcdefghi", "." * 50_000 + "abcdefghi" + "." * 50_000 + "j", "中" * 10, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in R.graded(docs).collect()) == [1, 2, 3, 7, 8]


def test_texts_are_not_shuffled_for_the_grades(spark, root, monkeypatch):
    docs, labels = (spark.read.parquet(f"{root}/../sf0.001/{name}.parquet") for name in ("documents", "reading_labels"))
    plans, rows = [], R._feature_rows

    def noted(documents, *rest):
        plans.append(documents._jdf.queryExecution().executedPlan().toString())
        return rows(documents, *rest)

    monkeypatch.setattr(R, "_feature_rows", noted)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        R.reading_bands(docs, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
