import pytest
from pyspark.sql import functions as F

from mentia.boolean import BooleanQueryError, matches, matching_many, matching_queries, parse, render, validate
from mentia.boolean.language import from_json, simplify_for_search, to_json, topic_tags

CASES = [
    ('"Acme Corp" refund OR complaint NOT school', "acme corp gave a refund", True),
    ('"Acme Corp" refund OR complaint NOT school', "complaint about acme but school event", False),
    ("NOT NOT a", "a", True),
    ("abc", "xabcd", True),
    ('("lừa đảo" OR "khiếu nại") AND NOT (học OR trường)', "bị lừa đảo hôm qua", True),
    ('("lừa đảo" OR "khiếu nại") AND NOT (học OR trường)', "khiếu nại ở trường", False),
]


@pytest.mark.parametrize("query,text,expected", CASES)
def test_matches(spark, query, text, expected):
    assert spark.range(1).select(matches(parse(query), F.lit(text)).alias("m")).first().m is expected


@pytest.mark.parametrize("query", ['"open', '""', "", "(a", "a)", "AND a", "a OR", "NOT"])
def test_errors(query):
    with pytest.raises(BooleanQueryError):
        parse(query)


@pytest.mark.parametrize("query", [q for q, _, _ in CASES] + ['a "b c" OR (d e) NOT "f"'])
def test_render_and_json_round_trip(query):
    tree = parse(query)
    assert parse(render(tree)) == tree and from_json(to_json(tree)) == tree


def test_precedence_and_positions():
    assert render(parse("a b OR c NOT d")) == "a AND b OR c AND NOT d"
    assert render(parse("(a OR b) c")) == "(a OR b) AND c"
    assert validate("ab (c") == {"valid": False, "error": "missing closing parenthesis", "position": 3}
    assert validate('ab "c')["position"] == 3


def test_many_queries_and_corrupt_ones(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None)], "id int, t string")
    asked = [(f"q{i}", "alpha" if i % 2 else "NOT gamma") for i in range(250)] + [("bad", "(")]
    got = {r.id: r.matched for r in matching_queries(df, F.col("t"), asked).collect()}
    assert len(got[1]) == 250 and set(got[2]) == {f"q{i}" for i in range(0, 250, 2)}


def test_search_text():
    assert simplify_for_search('"Acme Corp" AND (refund OR x) NOT school') == '"Acme Corp" OR refund OR school'
    assert topic_tags('"Acme Corp" AND Refund-Now') == ["acme-corp", "refund-now"]


def test_many_by_automaton_equal_the_compiled(spark):
    texts = ["alpha beta gamma", "beta delta", "", None, "ALPHA School".lower()]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    asked = [("a", "alpha"), ("b", "NOT alpha"), ("c", "beta NOT (gamma OR delta)"), ("d", 'alpha AND NOT "alpha school"'), ("e", "lph"), ("f", "NOT NOT beta OR zeta"), ("bad", "(")]
    want = {(r.id, q) for r in matching_queries(df, F.col("t"), asked).collect() for q in r.matched}
    for block in (2, 100):
        got = matching_many(df, "id", F.col("t"), spark.createDataFrame(asked, "query_id string, query string"), block=block)
        assert {tuple(r) for r in got.collect()} == want
