import random

import pytest

from mentia.llm import history as H


def brute(rows):
    accepted, out = [], set()
    for key, text, digest in sorted(rows, key=lambda r: r[0]):
        hit = None
        if text is None:
            if digest and digest.strip():
                hit = next((k for k, _, d in accepted if d and d.strip() == digest.strip()), None)
        else:
            w = H.split_words(text)
            near = [(-H.lcs_share(H.split_words(t), w), k) for k, t, _ in accepted if t is not None and w and H.lcs_share(H.split_words(t), w) >= 0.6]
            hit = min(near)[1] if near else None
        if hit is None:
            accepted.append((key, text, digest))
        else:
            out.add((hit, key))
    return out


def made(seed=3, n=120):
    rng, rows, words = random.Random(seed), [], [f"w{i}" for i in range(900)]
    for key in range(1, n + 1):
        kind = rng.random()
        texts = [t for _, t, _ in rows if t]
        if kind < 0.35 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, max(1, len(w) // 2))):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)
        elif kind < 0.45:
            text = None
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([4, 9, 40, 90])))
        rows.append((key, text, rng.choice([None, "", "h1", "h2", f"x{key}"])))
    return rows + [(900, "", "h9"), (901, "", None), (902, "   ", None), (903, None, "h9"), (904, "one", None), (905, "One", None)]


DDL = "cand_id long, text string, content_hash string"


def found(spark, rows):
    return set(map(tuple, H.repeats(spark.createDataFrame(rows, DDL)).collect()))


@pytest.mark.parametrize("seed", [3, 8])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    assert found(spark, rows) == brute(rows)


def chain():
    """Row 5 is near 2 and nearer to 4, which is accepted as 3, its earlier neighbour, repeats 1."""
    w = [f"a{i}" for i in range(100)]
    edit = lambda base, at, tag: [f"{tag}{i}" if i in at else x for i, x in enumerate(base)]
    one = w
    three = edit(w, range(0, 30), "c")
    four = edit(three, range(30, 60), "d")
    five = edit(four, range(60, 65), "e")
    two = edit(five, range(38), "f")
    return [(k, " ".join(t), None) for k, t in enumerate((one, two, three, four, five), 1)]


def test_chain_takes_the_nearest_accepted(spark):
    rows = chain()
    assert brute(rows) == {(1, 3), (4, 5)} == found(spark, rows)


def test_long_chains(spark):
    rng, rows, w = random.Random(4), [], [f"a{i}" for i in range(60)]
    for key in range(60):
        rows.append((key, " ".join(w), None))
        for _ in range(rng.randrange(4, 14)):
            w[rng.randrange(60)] = f"b{rng.randrange(10**6)}"
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("words", [15, 40, 150])
def test_edits_spread_over_the_whole_radius(spark, words):
    rng, rows = random.Random(words), []
    for key in range(0, 160, 2):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        edited = list(base)
        for i in rng.sample(range(words), int(words * rng.choice([0.05, 0.1, 0.2, 0.3, 0.35, 0.38, 0.4, 0.45]))):
            edited[i] = f"v{rng.randrange(3000)}"
        rows += [(key, " ".join(base), None), (key + 1, " ".join(edited), None)]
    want = brute(rows)
    assert len(want) > 50 and found(spark, rows) == want


@pytest.mark.parametrize("first", [16, 2, 1])
def test_hot_group_of_near_copies(spark, monkeypatch, first):
    # two centres 0.45 apart with rows around and between them, and copies of repeated rows
    monkeypatch.setattr(H, "FIRST", first)
    monkeypatch.setattr(H, "FIRST", first)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    other = [f"c{i}" if i < 27 else x for i, x in enumerate(base)]
    rows = []
    for key in range(70):
        w = list(base if key % 3 else other)
        for _ in range(rng.randrange(1, 12)):
            i = rng.randrange(60)
            w[i] = rng.choice([base[i], other[i], f"z{key}"])
        rows.append((key, " ".join(w), None))
    rows += [(100 + i, " ".join(base), None) for i in range(20)] + [(130 + i, rows[3 + i][1], None) for i in range(20)]
    assert found(spark, rows) == brute(rows)


def test_batches_equal_one_run_and_history_is_not_compared_again(spark, monkeypatch):
    rows = made(5) + [(1000 + k, t, None) for k, t, _ in chain()]
    df = spark.createDataFrame(rows, DDL)
    store, got, pairs = H.Accepted(spark), set(), []
    plain = H.neighbours

    def seen(s, asked, stores, **kw):
        pairs.append((asked, tuple(stores)))
        return plain(s, asked, stores, **kw)

    monkeypatch.setattr(H, "neighbours", seen)
    bounds = [-1, 40, 41, 90, 1002, 2000]
    for low, high in zip(bounds, bounds[1:]):
        held = set(store.blocks())
        got |= set(map(tuple, store.check(df.filter(f"cand_id > {low} and cand_id <= {high}")).collect()))
        # what is asked is always of the batch; stored blocks are only looked into
        assert all(asked not in held for asked, _ in pairs)
        assert len(store.blocks()) >= len(held)
        pairs.clear()
    assert got == brute(rows)


def test_a_batch_is_accepted_once(spark):
    store = H.Accepted(spark)
    store.commit("x", 0)
    with pytest.raises(Exception):
        store.commit("y", 0)


def test_distance_empty_tables_and_other_columns(spark):
    assert H.lcs_share("a b c d".split(), "b x d".split()) == 0.5 and H.lcs_share([], []) == 0
    assert H.repeats(spark.createDataFrame([], DDL)).count() == 0
    rows = spark.createDataFrame([(1, "a b c", None, 7, 8, 9), (2, "a b c", None, 7, 8, 9)], DDL + ", id int, n int, block int")
    assert [tuple(r) for r in H.repeats(rows).collect()] == [(1, 2)]
    very_long = " ".join(f"w{i % 5000}" for i in range(60_000))
    assert found(spark, [(1, very_long, None), (2, very_long + " x", None), (3, None, None)]) == {(1, 2)}
