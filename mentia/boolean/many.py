"""Many queries at once: one automaton over the terms of a block of queries finds which trees are worth evaluating."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mentia.boolean.language import BooleanQueryError, Group, Node, Not, Term, from_json, parse

#: Queries of a block: what an executor holds of them at a time, however many there are.
BLOCK = 20_000


def folded(term: Term) -> str:
    return unicodedata.normalize("NFKC", term.value).lower()


def true_of(node: Node, met: set[str]) -> bool:
    """Whether a tree is true of a text that has the terms ``met``. An empty AND is true, an empty OR false."""
    if isinstance(node, Term):
        return folded(node) in met
    if isinstance(node, Not):
        return not true_of(node.child, met)
    assert isinstance(node, Group)
    return (all if node.kind == "and" else any)(true_of(c, met) for c in node.children)


def positive(node: Node, kept: bool = True) -> set[str]:
    """Terms of a tree under an even number of NOTs: without any of them a text matches no more than an empty one."""
    if isinstance(node, Term):
        return {folded(node)} if kept else set()
    if isinstance(node, Not):
        return positive(node.child, not kept)
    return {t for c in node.children for t in positive(c, kept)}


def every(node: Node) -> set[str]:
    if isinstance(node, Term):
        return {folded(node)}
    return every(node.child) if isinstance(node, Not) else {t for c in node.children for t in every(c)}


class Block:
    """Trees of a block of queries, by the terms that make them worth evaluating."""

    def __init__(self, queries: list[tuple[str, Node]]):
        import ahocorasick

        self.trees = queries
        self.always = [i for i, (_, tree) in enumerate(queries) if true_of(tree, set())]
        self.by_term: dict[str, list[int]] = {}
        for i, (_, tree) in enumerate(queries):
            for term in positive(tree):
                self.by_term.setdefault(term, []).append(i)
        self.found = ahocorasick.Automaton()
        for term in {t for _, tree in queries for t in every(tree)} - {""}:
            self.found.add_word(term, term)
        if len(self.found):
            self.found.make_automaton()

    def matched(self, text: str | None) -> list[str]:
        """Ids of the queries that a text matches. Null texts have no terms."""
        met = {t for _, t in self.found.iter(text)} if text and len(self.found) else set()
        worth = {*self.always, *(i for t in met for i in self.by_term.get(t, ()))}
        return [self.trees[i][0] for i in sorted(worth) if true_of(self.trees[i][1], met)]


def matching_many(df: DataFrame, key: str, text: Column, queries: DataFrame, ident: str = "query_id", query: str = "query", trees: bool = False, block: int = BLOCK) -> DataFrame:
    """(key, ident) of rows and the queries (ident, query) that match their normalised ``text``.

    The queries are read in blocks of a stated number, one scan of ``df`` a block; a tree is evaluated only where one of
    its terms was met or where it is true without any. Queries that can't be read match nothing.
    """
    rows = df.select(F.col(key), text.alias("__text"))
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key,)} | {ident: queries.schema[ident].dataType.simpleString()}
    schema = f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}"

    def scan(held: list[tuple[str, Node]]) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            made = Block(shared.value)
            for batch in batches:
                ids, out_ids, out = batch.column(0).to_pylist(), [], []
                for i, value in zip(ids, batch.column(1).to_pylist()):
                    for q in made.matched(value):
                        out_ids.append(i)
                        out.append(q)
                yield pa.RecordBatch.from_arrays([pa.array(out_ids, batch.schema.field(0).type), pa.array(out, pa.string() if kinds[ident] == "string" else pa.int64())], [key, ident])

        return rows.mapInArrow(run, schema)

    parts, held = [], []
    for r in queries.select(ident, query).filter(F.col(query).isNotNull()).toLocalIterator():
        try:
            held.append((r[0], from_json(r[1]) if trees else parse(r[1])))
        except BooleanQueryError:
            continue
        if len(held) == block:
            parts.append(scan(held))
            held = []
    return reduce(DataFrame.unionByName, [*parts, scan(held)])
