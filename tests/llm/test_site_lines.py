import duckdb
from pyspark.sql import functions as F

from mentia.llm import site_lines as L
from mentia.llm.queries import P4_SQL


def test_site_and_letters(spark):
    urls = ["HTTPS://www.A.example:443/x", "http://m.a.example/", "https://u:p@news.a.example?x", "nonsense", None, "//b.example/y"]
    got = [r.s for r in spark.createDataFrame([(u,) for u in urls], "u string").select(L.site_of(F.col("u")).alias("s")).collect()]
    assert got == ["a.example", "a.example", "news.a.example", None, None, "b.example"]
    assert spark.range(1).select(L.letters(F.lit("• GROẞE 12 Straße!")).alias("x")).first().x == "grossestrasse"


def rows():
    out = []
    for i in range(40):
        lines = [f"line {chr(97 + i % 26)}{i}x"]
        lines += ["Share this!"] if i % 2 else ["• SHARE  this"]
        lines += ["Rare notice"] if i < 4 else []
        lines += ["Twice here", "Twice here"] if i < 6 else []
        lines += ["123", "..."]
        out.append((i, f"https://www.s.example/{i % 30}", "\n".join(lines), "clash"))
    out += [(100, None, "Share this!", ""), (101, "https://s.example/q", None, ""), (102, "https://s.example/w", "", ""), (103, "https://t.example/w", "x" * 50_000, "")]
    return out


def test_against_sql(spark):
    df = spark.createDataFrame(rows(), "norm_id long, canonical_url string, text string, site string")
    got = sorted(map(tuple, L.repeated_lines(df).collect()))
    con = duckdb.connect()
    con.execute("create table normalized_content (norm_id bigint, canonical_url varchar, text varchar, site varchar)")
    con.executemany("insert into normalized_content values (?, ?, ?, ?)", rows())
    assert got == sorted(con.execute(P4_SQL).fetchall()) and len(got) > 40
    kept = {r.norm_id: r.text for r in L.drop_repeated_lines(df).collect()}
    assert "hare" not in kept[7].lower() and "Rare notice" in kept[0] and kept[100] == "Share this!" and kept[101] is None and kept[102] == ""


def test_empty(spark):
    df = spark.createDataFrame([], "norm_id long, canonical_url string, text string")
    assert L.repeated_lines(df).count() == 0
