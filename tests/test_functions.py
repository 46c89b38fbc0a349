import pytest
from pyspark.sql import functions as F

from mentia.functions import hashing as H, scoring as S, text as T, urls as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,digest", [("a", "af63dc4c8601ec8c"), ("hello", "a430d84680aabd0b"), ("việt", "9f95afcc7365edfb"), ("refund", "cbd4c41d1e3a433f"), ("", "cbf29ce484222325")])
def test_fnv(spark, text, digest):
    h = H.fnv1a(F.lit(text))
    assert one(spark, H.hex64(h["hi"], h["lo"])) == digest


@pytest.mark.parametrize("url,expected", [
    ("HTTPS://Shop.Acme.example:443/deals/today/?z=9&utm_medium=mail&k=4#top", "https://shop.acme.example/deals/today?k=4&z=9"),
    ("http://a.b", "http://a.b/"), ("http://a.b:80/x?fbclid=1", "http://a.b/x"), ("http://a.b/?b=1&a=2&a=1", "http://a.b/?a=2&a=1&b=1"), ("nonsense", None),
])
def test_normalize_url(spark, url, expected):
    assert one(spark, U.normalize_url(F.lit(url))) == expected


@pytest.mark.parametrize("url,expected", [("https://a.example/x", True), ("ftp://a.b", False), ("http://localhost/", False), ("http://172.20.1.1/", False), ("http://172.32.1.1/", True), ("http://10.0.0.1:80/", False), (None, False)])
def test_public(spark, url, expected):
    assert one(spark, U.is_public(F.lit(url).cast("string"))) is expected


def test_redirects_and_permalinks(spark):
    assert one(spark, U.unwrap_redirect(F.lit("http://www.bing.com/news/apiclick.aspx?ref=1&url=https%3A%2F%2Fa.example%2Fx"))) == "https://a.example/x"
    assert one(spark, U.post_permalink(F.lit("https://old.reddit.com/r/x/comments/ab1/t/#c"))) == "https://www.reddit.com/r/x/comments/ab1/t/"
    assert one(spark, U.post_permalink(F.lit("https://old.reddit.com/r/x/"))) is None
    assert one(spark, U.on_hosts(F.lit("https://m.facebook.com/a"), ["facebook.com"])) is True


def test_scores(spark):
    risks = F.array(F.lit("fraud"), F.lit("refund"), F.lit("fraud"))
    assert one(spark, S.severity(F.lit("negative"), F.lit(0.96), F.lit(98.0), risks)) == 94
    assert one(spark, S.severity(F.lit("neutral"), F.lit(0.96), F.lit(98.0), risks)) == 0
    score = lambda *x: one(spark, S.virality(*(F.lit(v).cast("double") for v in x)))
    assert (score(40, 12, 8, None, 30), score(400, 120, 80, None, 30), score(None, None, None, None, 5), score(-1, None, None, None, 5)) == (72, 100, 0, 0)
    gate = lambda *x: one(spark, S.cluster_gate(*map(F.lit, x)))
    assert [gate(40, 90, 10), gate(65, 20, 3), gate(58, 75, 1), gate(62, 45, 2), gate(55, 30, 1)] == [False, True, True, True, False]


def test_text(spark):
    html = "<title> A  b </title><script>x</script><p>One&amp;lt;</p>Two<br>Three"
    assert one(spark, T.html_title(F.lit(html))) == "A b"
    assert one(spark, T.html_to_text(F.lit(html))).split() == ["A", "b", "One<", "Two", "Three"]
    assert one(spark, T.excerpt(F.lit("ab cd  ef"), 6)) == "ab cd…"
    assert one(spark, T.readable(F.lit('{"success":true,"result":"<p>Hi</p>"}'))) == "Hi"
    assert one(spark, T.readable(F.lit('{"success":true,"result":"cut \\"off'))) == 'cut "off'
    assert one(spark, T.tokens(F.lit("Ｖiệt-Nam 42!"))) == ["việt", "nam", "42"]
    assert one(spark, H.shard_index(F.lit("tenant-alpha"))) == 62


def test_simhash_of_close_texts(spark):
    base = "the company answered late and customers asked for their money back again today in the shop"
    df = spark.createDataFrame([(1, base), (2, base + "!"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: (r.sim_hi, r.sim_lo) for r in H.simhash(df, "id", T.tokens(F.col("t"))).collect()}
    assert got[1] == got[2] and got[3] == got[4] == (0, 0)
