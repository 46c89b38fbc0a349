import pytest

from mentia.llm import pages as P, queries as Q, residue as R, style_tree as S

PAGE = """<!doctype html>
<head>
<title>T - Sitename</title>
<style>
.a{color:red}
</style>
</head>
<body>
<!-- n 1 -->
<div class="nav"><a href="/">Home</a></div>
<div id="x">
<h1>Head &amp; line</h1>
<div>First paragraph of the article, which is long enough to be one.<br>
It goes on here, and ends.</div>
<aside><a href="/r">Other story</a></aside>
<div>Second paragraph of the article, which is long enough too.</div>
</div>
<p class="foot">All rights reserved.</p>"""


NONE = S.Nodes(set(), set())


def test_lines_of_a_page():
    lines = P.lines_of(PAGE)
    assert [l.no for l in lines] == list(range(1, len(PAGE.split("\n")) + 1))
    shown = {l.no: l.text for l in lines if l.text}
    assert 3 not in shown and 5 not in shown and 9 not in shown
    assert shown[12] == "Head & line" and lines[11].heading
    assert lines[13].style == lines[12].style == "div" and lines[9].link and lines[14].link


def test_article_of_a_page():
    low = S.Nodes({S.node_code("all rights reserved")}, set())
    assert S.article_lines(P.lines_of(PAGE), None, "sitename", low) == [12, 13, 14, 16]


def test_placeholders_of_plain_texts_are_no_markup():
    assert not P.is_page("<%= title %> and <<city>>")
    assert P.lines_of("a\n\n <<city>>")[2].text == "<<city>>"


def test_importance():
    assert S.importance(1, 100) == 1 and S.importance(100, 100) == 0 and S.importance(10, 100) == pytest.approx(0.5)


def test_keys_and_labels():
    assert P.keys("By Ann Bee, Sitename staff", "sitename")[0] == "by ann bee § staff"
    assert P.keys("12 March 2024 10:00", "") == []
    assert P.label("Read also: Some title") == "l:read also" and P.label("Acme: warranty") == ""
    assert P.label("What is new: the shop closed early.") == "" and P.label("Words: Ann Bee") == "b:words"


@pytest.mark.parametrize("line,bad", [
    ("Please enable JavaScript to view this page.", True), ("JavaScript is required. Reload after turning it on.", True),
    ("Headline goes here: {{ title }}", True), ("{city} said on %%DAY%% that all is well with everyone today", True),
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", True), ("Fatal error: Uncaught TypeError in /srv/www/render.php on line 12", True),
    ("Không tìm thấy trang bạn yêu cầu.", True), ("Seite nicht gefunden.", True), ("Página no encontrada.", True), ("Accès refusé.", True),
    ('The outage page of Acme said "service temporarily unavailable" while 12 orders were waiting.', False),
    ("Visitors saw « page introuvable » for an hour.", False), ("The shop in Rome was closed.", False), ("", False), ("...", False),
])
def test_residue_lines(line, bad):
    assert R.is_residue(line) is bad


def test_residue_of_articles():
    real = "A paragraph about the company and its customers, long enough to be one."
    assert not R.in_place_of_content([real, 'It greeted them as "Dear {{firstName}}", which was odd.'])
    assert not R.in_place_of_content([real, "In the template, Ann writes ${price} where the shop prints 5 dollars."])
    assert R.in_place_of_content([real, "The refund would be *|AMOUNT|* within two hours."])
    assert R.in_place_of_content(["Your session has expired. Sign in again to continue."])
    assert not R.in_place_of_content([]) and not R.in_place_of_content([real * 2000])


def corpus(spark):
    rows = []
    for i in range(60):
        text = f"This site sets cookies. Accept\nStory number {chr(97 + i % 26) * 3}{i} about a thing\nReported by Ann Bee for Sitename\nThe {chr(97 + i % 26) * 4} firm number {i} explained at length what happened to its {chr(98 + i % 25) * 5} customers.\nTerms of use · Privacy"
        rows.append((i, f"https://sitename.example/{i}", None, text))
    rows += [(60, "https://sitename.example/60", None, "This site sets cookies. Accept\nPlease enable JavaScript to view this page.\nTerms of use · Privacy"), (61, None, None, ""), (62, "https://sitename.example/62", None, None), (63, "https://sitename.example/0", None, rows[0][3])]
    return spark.createDataFrame(rows, "norm_id long, canonical_url string, title string, text string").withColumnsRenamed({})


@pytest.mark.parametrize("copies", [True, False])
def test_extract(spark, monkeypatch, copies):
    if not copies:
        monkeypatch.setattr(S, "COPY_BYTES", 0)
    docs = S.documents_of(corpus(spark), "t", "norm_id", "canonical_url", "text", "title")
    got = {r.record_id: r for r in S.extract(docs).collect()}
    assert len(got) == 63 and got[0].lines == [2, 4] and got[63].lines == [2, 4]
    assert [i for i in got if got[i].residue] == [60] and got[60].lines == [] and got[61].lines == []


def test_corpus_nodes_of_small_hosts(spark):
    notice = "We and our partners keep cookies on your device. Accept or refuse them."
    rows = [(i, f"https://host{i}.example/a", f"{notice}\nThe {chr(97 + i % 26) * 4} firm explained at length what happened to its {chr(98 + i // 26) * 5} customers number {i}.") for i in range(60)]
    docs = S.documents_of(spark.createDataFrame(rows, "norm_id long, canonical_url string, text string"), "t", "norm_id", "canonical_url", "text")
    assert {tuple(r.lines) for r in S.extract(docs).collect()} == {(2,)}


def test_languages_count_the_pages_of_both_tables(spark, root, monkeypatch):
    counted, count = [], S.unimportant_nodes
    monkeypatch.setattr(S, "unimportant_nodes", lambda docs: counted.append({r[0] for r in docs.select("record_table").distinct().collect()}) or count(docs))
    assert {r.record_table for r in Q.p5_found(spark, root).collect()} <= {"normalized_content", "classifications"}
    assert counted == [{"raw_content", "normalized_content"}]


def test_noscript_alone_stands_for_the_article():
    alone = "<html><body>\n<noscript>Please enable JavaScript to view this page.</noscript>\n</body></html>"
    assert S._decide(alone, None, "", NONE)[2]
    assert not S._decide(PAGE + "\n<noscript>Please enable JavaScript to view this page.</noscript>", None, "", NONE)[2]
    assert not S._decide('<html><body>\n<a href="/">Home</a>\n</body></html>', None, "", NONE)[2]


def test_long_notices_differ_by_site_and_month_only():
    codes = [set(S.node_codes(P.Line(0, f"{name} keeps cookies since {month} 2024. " + "We ask for your consent to it. " * 12, "", (), False, False), name.lower())) for name, month in (("Acmenews", "May"), ("Otherpost", "June"))]
    assert codes[0] == codes[1] != set()


def test_nodes_of_a_large_host_follow_importance_alone(spark):
    docs = spark.range(8000).selectExpr("'big.example' as site", "if(id < 38, 'Read our rules of the house', '') as text")
    got = {r.site: len(r.nodes) for r in S.unimportant_nodes(docs).collect()}
    assert S.importance(38, 8000) < S.IMPORTANCE and got[S.code("big.example")] >= 1


def test_branches_of_a_host_are_judged_by_the_importance_of_what_stands_in_them(spark):
    # a layout of its own: an unimportant branch takes a line with it that no other page has, an important one keeps a repeated element
    rows = []
    for i in range(40):
        extra = "<li>Seen on this page alone, and nowhere else on this host</li>" if i == 7 else ""
        rows.append((i, f"https://layout.example/{i}", None, f"""<html><body>
<section class="q"><ul>
<li>First of the house</li>
<li>Second of the house</li>
<li>Third of the house</li>
{extra}
</ul></section>
<div class="z">
<p>The {chr(97 + i % 26) * 4} firm number {i} explained at length what happened to its {chr(98 + i % 25) * 5} customers.</p>
<p>It was {chr(97 + i // 2) * 6} who asked for it, and nobody in {chr(99 + i % 20) * 7} answered for a week.</p>
</div>
</body></html>"""))
    docs = S.documents_of(spark.createDataFrame(rows, "norm_id long, canonical_url string, title string, text string"), "t", "norm_id", "canonical_url", "text")
    low = {r.site: set(r.styles) for r in S.unimportant_nodes(docs).collect()}[S.code("layout.example")]
    nodes = P.lines_of(rows[7][3])[2].nodes
    assert nodes == (">html>body>section.q>ul/li", ">html>body>section.q>ul") and set(S.style_codes(nodes)) <= low
    assert low.isdisjoint(S.style_codes(P.lines_of(rows[7][3])[8].nodes))
    got = {r.record_id: r.lines for r in S.extract(docs).collect()}
    assert set(map(tuple, got.values())) == {(9, 10)}
    # without the branches the line stays
    numbers, _, _ = S._decide(rows[7][3], None, "layout.example", NONE)
    assert 6 in numbers


def test_extract_of_nothing(spark):
    docs = S.documents_of(corpus(spark).limit(0), "t", "norm_id", "canonical_url", "text", "title")
    assert S.extract(docs).count() == 0
