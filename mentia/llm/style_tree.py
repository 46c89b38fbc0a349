"""Problem 3: page boilerplate mixed with main content, by a site style tree.

The documents of a host are merged into one tree. Its presentation nodes are chains of elements with their
classes, as they enclose a line; below them hang content nodes, the masked words of lines. With m pages, a
content node met on n of them has the entropy log n / log m over pages and the importance 1 - log_m n: what
stands on one page counts 1, what every page repeats 0. A presentation node met on m pages has the mean
importance of the content below it, each counted as often as it is met. A page loses the branches of
unimportant presentation nodes, whatever stands in them there, and the leaves that meet an unimportant
content node of the host or of the whole corpus; and what lies outside the element, or in plain texts outside
the span, that holds the important text. Plain texts are pages of one presentation node. Furniture that differs by
page inside a node that also holds articles is left to the rules on single lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mentia.llm import pages as P
from mentia.llm.residue import in_place_of_content, is_residue
from mentia.llm.site_lines import site_of
from mentia.session import cut

#: A content node is unimportant under this importance, from this many pages.
IMPORTANCE, MIN_PAGES = 0.6, 3
#: A presentation node is unimportant under this mean importance, from this many pages.
BRANCH_IMPORTANCE, BRANCH_PAGES = 0.3, 8
#: A content node of the whole corpus: share of all pages and least number of hosts.
CORPUS_SHARE, CORPUS_HOSTS = 0.0015, 3
#: Bytes of the table of unimportant nodes up to which each executor gets a copy; beyond, it is joined.
COPY_BYTES = 16 << 20
#: The site of rows without one, and the key of nodes of the whole corpus.
UNKNOWN = ""


def code(key: str) -> int:
    """64-bit code of a key: Spark's ``xxhash64`` of it."""
    x = xxhash.xxh64_intdigest(key, seed=42)
    return x - (1 << 64) if x >> 63 else x


EVERYWHERE = code("*")


def node_keys(line: P.Line, name: str) -> list[str]:
    """All content keys of a leaf."""
    if not line.text:
        return []
    keys = P.keys(line.text, name)
    mark = P.label(line.text)
    return [*keys, mark] if mark else keys


#: Bits of a content node's code that tell its first OPENING words; the others tell all of it.
OPENING, OPENING_BITS = 3, 20
#: Codes of leaves under this length are remembered: what a site repeats is mostly short.
LONG_LEAF = 300


def node_code(key: str) -> int:
    """Code of a content key, by its first words and by all of it."""
    return _opening(key.split(" ", OPENING)[:OPENING]) << 64 - OPENING_BITS | code(key) & (1 << 64 - OPENING_BITS) - 1


@lru_cache(maxsize=100_000)
def _opening_of(words: str) -> int:
    x = code(words) & (1 << OPENING_BITS) - 1
    return x - (1 << OPENING_BITS) if x >> OPENING_BITS - 1 else x


def _opening(words: list[str]) -> int:
    return _opening_of(" ".join(words))


@lru_cache(maxsize=100_000)
def _short_codes(text: str, name: str) -> tuple[int, ...]:
    return tuple([node_code(k) for k in node_keys(P.Line(0, text, "", (), False, False), name)])


def node_codes(line: P.Line, name: str) -> tuple[int, ...]:
    """Codes of a leaf's content nodes."""
    if len(line.text) < LONG_LEAF:
        return _short_codes(line.text, name) if line.text else ()
    return tuple([node_code(k) for k in node_keys(line, name)])


class Nodes:
    """Unimportant content nodes of a host and of the corpus, and with what words they begin."""

    def __init__(self, own: set[int], every: set[int]):
        self.own, self.every = own, every
        self.openings = {x >> 64 - OPENING_BITS for x in own} | {x >> 64 - OPENING_BITS for x in every}

    def meet(self, line: P.Line, name: str) -> bool:
        """Whether one of a leaf's content nodes is among them. Of a long leaf that begins unlike all of them, no more is read."""
        if len(line.text) >= LONG_LEAF and (len(name) <= 3 or name not in line.text.lower()):
            first = P.words(line.text[:200])
            # a leaf of many words has no key but its words
            if len(first) >= 8 and _opening(first[:OPENING]) not in self.openings:
                return False
        return any([k in self.own or k in self.every for k in node_codes(line, name)])


@lru_cache(maxsize=100_000)
def style_codes(nodes: tuple[str, ...]) -> tuple[int, ...]:
    """Codes of a leaf's presentation nodes."""
    return tuple(code(f"s:{n}") for n in nodes)


def importance(n: float, m: float) -> float:
    """1 - log_m n: the importance of a node met on n of m pages."""
    return 1.0 if n <= 1 else max(0.0, 1 - math.log(n) / math.log(max(m, 2)))


# ---------------------------------------------------------------- one document


_LETTER = re.compile(r"[^\W\d_]")


def _set_apart(line: P.Line) -> bool:
    """Whether a line's kind makes it furniture beside an article."""
    return line.link or line.style.startswith("noscript") or ":" in line.text and bool(P.HANDLE.match(line.text))


def article_lines(lines: list[P.Line], title: str | None, name: str, nodes: Nodes, branches: set[int] = frozenset()) -> list[int]:
    """Numbers of the lines of the article itself; the rules are those of the module's text. ``branches`` are unimportant."""
    n = len(lines)
    furniture = [True] * n
    headline, titled = None, P.words(title) if title else None
    for i, line in enumerate(lines):
        if not line.text or not _LETTER.search(line.text):
            continue
        # the same words are about as long
        if line.heading or (headline is None and titled and len(line.text) <= 3 * len(title) + 60 and P.words(line.text) == titled):
            headline = i if headline is None else headline
            furniture[i] = False
            continue
        bad = _set_apart(line)
        if not bad and (branches and not branches.isdisjoint(style_codes(line.nodes)) or nodes.meet(line, name)):
            # failure messages and the like are met on many pages, but they stand for the article
            bad = not is_residue(line.text)
        furniture[i] = bool(bad)
    kept = [i for i in range(n) if not furniture[i]]
    if not kept:
        return []
    # the element that holds the important text: the deepest one with most of it
    if any(lines[i].path for i in kept):
        weight: Counter[tuple[int, ...]] = Counter()
        total = 0
        for i in kept:
            size = len(lines[i].text)
            total += size
            for depth in range(1, len(lines[i].path) + 1):
                weight[lines[i].path[:depth]] += size
        best = max((path for path, w in weight.items() if w >= 0.6 * total), key=len, default=())
        kept = [i for i in kept if lines[i].path[: len(best)] == best]
    if headline is not None and headline in kept:
        kept = [i for i in kept if i >= headline]
    return _span(lines, kept, headline)


def _bodies(lines: list[P.Line], kept: list[int], headline: int | None) -> list[int]:
    """Paragraphs and their wrapped pieces, rather than captions."""
    out: list[int] = []
    for i in kept:
        text = lines[i].text
        if i == headline:
            continue
        goes_on = bool(out) and out[-1] == i - 1 and len(lines[i - 1].text) >= 45 and not P.ends_sentence(lines[i - 1].text)
        if goes_on or len(text) >= 60 or P.ends_sentence(text) and len(text.split()) >= 3 or is_residue(text):
            out.append(i)
    return out


def _span(lines: list[P.Line], kept: list[int], headline: int | None) -> list[int]:
    """From the headline to the last paragraph or list item; captions count where text of the article follows."""
    bodies = _bodies(lines, kept, headline)
    if not bodies:
        return [] if headline is None else [lines[headline].no]
    last = bodies[-1]
    out = [i for i in kept if i <= last or _item(lines[i])]
    if headline is None:
        # one caption right before the first paragraph may be the headline
        before = [i for i in out if i < bodies[0]]
        out = before[-1:] + [i for i in out if i >= bodies[0]]
    return [lines[i].no for i in out]


def _item(line: P.Line) -> bool:
    """A list item: of a list element, or a short phrase with a bullet or one comma and no colon."""
    if line.style.startswith("li") and not line.link:
        return True
    text = line.text
    return not line.style and len(text) < 60 and ":" not in text and "!" not in text and " – " not in text and (text.count(",") == 1 or bool(P.BULLET.match(text)))


# ---------------------------------------------------------------- the corpus


def documents_of(df: DataFrame, table: str, key: str, url: str, text: str, title: str | None = None) -> DataFrame:
    """(record_table, record_id, site, title, text) of the rows with a text."""
    titles = F.col(title) if title else F.lit(None).cast("string")
    return df.filter(F.col(text).isNotNull()).select(F.lit(table).alias("record_table"), F.col(key).cast("bigint").alias("record_id"), F.coalesce(site_of(F.col(url)), F.lit(UNKNOWN)).alias("site"), titles.alias("title"), F.col(text).alias("text"))


def _counts(batches: Iterator) -> Iterator:
    """Partial counts of pages by host, presentation node and content node, all as codes.

    Node 0 is the presentation node itself, with what encloses it in ``up``; that of style 0 is the host. A leaf's words
    hang below its presentation node, its other keys below the host.
    """
    import pyarrow as pa

    for batch in batches:
        by: dict[str, Counter] = {}
        for site, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            name = P.site_name(site) if site else ""
            met = {(0, 0, 0)}
            for line in P.lines_of(text):
                if line.text:
                    style, up = style_codes(line.nodes) or (0, 0)
                    keys = node_codes(line, name)
                    if keys:
                        met.add((style, keys[0], 0))
                        met.update([(0, k, 0) for k in keys[1:]])
                    met.update(((style, 0, up), (up, 0, 0)))
            by.setdefault(site, Counter()).update(met)
        keys = np.array([k for c in by.values() for k in c], np.int64).reshape(-1, 3)
        sites = np.repeat(np.array([code(site) for site in by], np.int64), [len(c) for c in by.values()])
        ns = np.fromiter((n for c in by.values() for n in c.values()), np.int64, len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sites, keys[:, 0], keys[:, 1], keys[:, 2], ns)], ["site", "style", "node", "up", "n"])


def unimportant_nodes(docs: DataFrame) -> DataFrame:
    """(site bigint, nodes array<bigint>, styles array<bigint>): content and presentation nodes of low importance by host.

    All are codes. The content nodes of the corpus stand under EVERYWHERE. A host of m pages keeps at most
    lines-per-page * m^0.6 content nodes. Nodes of the corpus are summed over all hosts, also those with one page of the
    node.
    """
    counts = docs.select("site", "text").mapInArrow(_counts, "site bigint, style bigint, node bigint, up bigint, n bigint")
    # batches are summed already; one shuffle by host and node serves both sums
    counts = cut(counts.repartition("site", "node").groupBy("site", "style", "node", "up").agg(F.sum("n").alias("n")))
    pages = counts.filter("node = 0 and style = 0").select("site", F.col("n").alias("m"))
    nodes = counts.filter("node <> 0").groupBy("site", "node").agg(F.sum("n").alias("n"))
    rank = lambda n, m: 1 - F.log(n) / F.log(F.greatest(m, F.lit(2)))
    own = nodes.filter(F.col("n") >= MIN_PAGES).join(pages, "site").filter(rank("n", "m") < IMPORTANCE).groupBy("site").agg(F.collect_list("node").alias("nodes"))
    # a leaf's node has its content; what encloses it has that of all leaves below
    met = counts.filter("node = 0 and style <> 0").groupBy("site", "style").agg(F.max("n").alias("m"), F.max("up").alias("up"), F.min("up").alias("low")).withColumn("up", F.when(F.col("up") != 0, F.col("up")).otherwise(F.col("low")))
    content = counts.filter("node <> 0 and style <> 0").groupBy("site", "style", "n").agg(F.count("*").alias("k")).join(met.drop("m", "low"), ["site", "style"])
    below = content.select("site", "n", "k", F.explode(F.array("style", "up")).alias("style")).filter("style <> 0").join(met.filter(f"m >= {BRANCH_PAGES}").select("site", "style", "m"), ["site", "style"])
    weight = F.col("n") * F.col("k")
    mean = F.sum(weight * F.greatest(F.lit(0.0), rank("n", "m"))) / F.sum(weight)
    styles = below.groupBy("site", "style").agg(mean.alias("mean")).filter(F.col("mean") < BRANCH_IMPORTANCE).groupBy("site").agg(F.collect_list("style").alias("styles"))
    total = pages.agg(F.sum("m")).first()[0] or 0
    every = nodes.groupBy("node").agg(F.sum("n").alias("n"), F.count("*").alias("hosts")).filter((F.col("hosts") >= CORPUS_HOSTS) & (F.col("n") >= CORPUS_SHARE * total))
    none = F.array().cast("array<bigint>")
    out = own.join(styles, "site", "full").select("site", F.coalesce("nodes", none).alias("nodes"), F.coalesce("styles", none).alias("styles"))
    return out.unionByName(every.agg(F.collect_list("node").alias("nodes")).select(F.lit(EVERYWHERE).alias("site"), "nodes", none.alias("styles")))


def _named(lines: list[P.Line], every: set[int]) -> str:
    """What a page without an address calls its site: the word that, masked, makes most lines corpus-wide nodes."""
    votes: Counter[str] = Counter()
    for line in lines:
        for word in {w.lower() for w in line.text.split() if len(w) > 5 and w[0].isupper() and w.isalpha()}:
            votes[word] += any(node_code(k) in every for k in P.keys(line.text, word)) and "§" in P.keys(line.text, word)[0]
    return max((w for w in votes if votes[w]), key=lambda w: (votes[w], w), default="")


def _decide(text: str, title: str | None, site: str, nodes: Nodes, branches: set[int] = frozenset()) -> tuple[list[int], list[str], bool]:
    """(line numbers of the article, their texts, whether residue stands in its place) of one document."""
    lines = P.lines_of(text)
    name = P.site_name(site) if site else _named(lines, nodes.every)
    numbers = article_lines(lines, title, name, nodes, branches)
    if not numbers:
        # with no article beside them, noscript lines, links and handles may stand in its place themselves
        texts = [line.text for line in lines if line.text and _set_apart(line) and (is_residue(line.text) or not nodes.meet(line, name))]
        return [], [], in_place_of_content(texts)
    texts = [lines[n - 1].text for n in numbers]
    return numbers, texts, in_place_of_content(texts)


def extract(docs: DataFrame, each=None, extra: str = "", counted: DataFrame | None = None) -> DataFrame:
    """(record_table, record_id, residue, lines array<int>) of documents_of rows, one each.

    ``lines`` are the article's, empty where ``residue``; lines are counted from 1. Empty texts have
    none. ``each``, if given, maps (line numbers, texts) of an article to the values of the additional
    columns ``extra`` (DDL), null where ``residue``. ``counted`` has the rows whose nodes are counted, if
    they are more than ``docs``.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    nodes = cut(unimportant_nodes(docs if counted is None else counted))
    # the corpus has at most lines-per-page / CORPUS_SHARE nodes; those of all hosts are counted first
    copies = 8 * (nodes.agg(F.sum(F.size("nodes") + F.size("styles"))).first()[0] or 0) <= COPY_BYTES
    here = nodes if copies else nodes.filter(F.col("site") == EVERYWHERE)
    shared = spark.sparkContext.broadcast({r.site: (np.array(r.nodes, np.int64), np.array(r.styles, np.int64)) for r in here.toLocalIterator()})
    ddl = "record_table string, record_id bigint, residue boolean, lines array<int>" + (f", {extra}" if extra else "")
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    names = schema.names[4:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int | str, tuple[Nodes, set[int]]] = {}
        given = lambda site: [set(x.tolist()) for x in shared.value.get(site, (np.empty(0),) * 2)]
        every = given(EVERYWHERE)[0]

        def of(site: int) -> tuple[Nodes, set[int]]:
            if site not in sets:
                if len(sets) > 256:
                    sets.clear()
                own, branches = given(site)
                sets[site] = Nodes(own, every), branches
            return sets[site]

        for batch in batches:
            rows = batch.to_pydict()
            out: dict[str, list] = {c: [] for c in ("residue", "lines", *names)}
            for i, (site, title, text) in enumerate(zip(rows["site"], rows["title"], rows["text"])):
                if not copies and site not in sets:
                    if len(sets) > 256:
                        sets.clear()
                    sets[site] = Nodes(set(rows["own"][i] or ()), every), set(rows["branches"][i] or ())
                nodes_, branches = of(code(site)) if copies else sets[site]
                numbers, texts, bad = _decide(text, title, site, nodes_, branches)
                out["residue"].append(bad)
                out["lines"].append([] if bad else numbers)
                values = each(numbers, texts) if each and not bad else [None] * len(names)
                for name, value in zip(names, values):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict({"record_table": rows["record_table"], "record_id": rows["record_id"], **out}, schema=schema)

    if not copies:
        known = nodes.withColumnsRenamed({"site": "at", "nodes": "own", "styles": "branches"})
        docs = docs.withColumn("at", F.xxhash64("site")).join(known, "at", "left").drop("at")
    return docs.mapInArrow(run, ddl)
