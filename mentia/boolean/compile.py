"""Trees to Catalyst: a term is met where its normalised text is a substring of the normalised text."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mentia.boolean.language import BooleanQueryError, Group, Node, Not, Term, from_json, parse

#: Queries evaluated by one projection; more are chunked, as generated methods are limited in size.
CHUNK = 100


def matches(node: Node, text: Column) -> Column:
    """Boolean expression of a tree over a text that is in lower case and NFKC. Null texts don't match terms."""
    if isinstance(node, Term):
        return F.coalesce(F.contains(text, F.lit(unicodedata.normalize("NFKC", node.value).lower())), F.lit(False))
    if isinstance(node, Not):
        return ~matches(node.child, text)
    assert isinstance(node, Group)
    parts = [matches(c, text) for c in node.children]
    if node.kind == "and":
        return reduce(lambda a, b: a & b, parts, F.lit(True)) if not parts else reduce(lambda a, b: a & b, parts)
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def matching_queries(df: DataFrame, text: Column, queries: list[tuple[str, str]], out: str = "matched", trees: bool = False) -> DataFrame:
    """``df`` with the ids of ``queries`` ((id, query) pairs) that match, in one scan and without a join.

    ``trees`` says that queries are stored trees. A query that can't be read matches nothing.
    """
    read = []
    for ident, query in queries:
        try:
            read.append((ident, from_json(query) if trees else parse(query)))
        except BooleanQueryError:
            continue
    df = df.withColumn("__text", text)
    found = []
    for i in range(0, len(read), CHUNK):
        df = df.withColumn(name := f"__m{i}", F.array_compact(F.array(*(F.when(matches(t, F.col("__text")), F.lit(q)) for q, t in read[i : i + CHUNK]))))
        found.append(name)
    matched = F.concat(*(F.col(c) for c in found)) if found else F.array().cast("array<string>")
    return df.withColumn(out, matched).drop("__text", *found)
