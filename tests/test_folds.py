from mentia.operators import dedupe as D
from mentia.operators.folds import assign_stories, domain_tokens, drop_near


def sims(spark, rows):
    return spark.createDataFrame(rows, "m string, id long, title string, sim_hi long, sim_lo long")


def test_drop_near_compares_with_kept_rows_only(spark):
    # a ~ b ~ c, but a and c are four bits apart: c is kept, as b was dropped
    df = sims(spark, [("x", 1, "", 0, 0b1), ("x", 2, "", 0, 0b111), ("x", 3, "", 0, 0b11111), ("y", 4, "", 0, 0b1), ("x", 5, "", 0, 0), ("x", 6, "", 0, 0), (None, 7, "", 0, 1)])
    assert {r.id for r in drop_near(df, "m", ["id"], "id").collect()} == {1, 3, 4, 5, 6, 7}
    assert {r.id for r in drop_near(df, "m", ["id"], "id", look_back=1).collect()} == {1, 3, 4, 5, 6, 7}
    assert drop_near(df.limit(0), "m", ["id"], "id").count() == 0


def test_stories(spark):
    far = 0xFFFFFFFF
    df = sims(spark, [("x", 1, "Acme recalls the phone", 1, 1), ("x", 2, "Acme recalls the phone again", far, 0), ("x", 3, "Other news today", 0, far), ("x", 4, "Nothing alike", 1, 3), ("x", 5, None, 0, 0)])
    got = {r.id: r.story for r in assign_stories(df, "m", ["id"], "id").collect()}
    assert got == {1: "1", 2: "1", 3: "3", 4: "1", 5: "5"}


def test_domain_tokens(spark):
    rows = [("d", 0, 1, "acquire", None, None), ("d", 100, 2, "acquire", None, None), ("d", 600, 3, "acquire", None, None), ("d", 1200, 4, "acquire", None, None), ("d", 1300, 5, "release", 429, 5000), ("d", 2000, 6, "acquire", None, None), ("d", 6400, 7, "acquire", None, None)]
    df = spark.createDataFrame(rows, "domain string, at_ms long, seq long, kind string, status int, retry_after_ms long")
    got = {r.seq: (r.granted, r.retry_ms) for r in domain_tokens(df).collect()}
    assert got == {1: (True, 0), 2: (False, 400), 3: (True, 0), 4: (False, 250), 6: (False, 4300), 7: (True, 0)}


def test_band_join_is_exact(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    hashes = base + [h ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for h in base] + base[:5] + [0, 0]
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in enumerate(hashes)], "id long, sim_hi long, sim_lo long")
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    for t in (1, 3, 6):
        want = {(first[a], first[b]) for a in first for b in first if a and b and first[a] < first[b] and (a ^ b).bit_count() <= t}
        assert {(r.a, r.b) for r in D.near_pairs(df, "id", t).collect()} == want
    assert D.near_classes(df, "id").count() == len(hashes)


def test_components_of_chains(spark):
    nodes = spark.range(40)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 19)] + [(30, 31), (35, 31)], "a long, b long")
    got = {r.id: r.component for r in D.components(nodes, edges, "id").collect()}
    assert {got[i] for i in range(20)} == {0} and got[35] == got[31] == 30 and got[25] == 25
