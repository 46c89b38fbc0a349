"""Order-dependent operators: each row is judged against what was kept before it.

Rows are partitioned by key and sorted within partitions, then stream through Python with the bounded
state of one key at a time. No group is ever held: the memory of a task doesn't depend on its keys. The
order is part of the meaning, so one key is one task's work; the set-wise forms in ``dedupe`` have no
such limit and are what the queries use.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

#: Earlier rows that a row is compared with: near duplicates and stories.
NEAR_LOOK_BACK, STORY_LOOK_BACK = 200, 50
NEAR_BITS, STORY_OVERLAP = 3, 0.55


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """Rows that ``step(state, row)`` returns, in order, each key with a fresh ``start()``; None drops a row."""
    import pandas as pd

    names = [f.strip().split()[0].strip("`") for f in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                key = tuple(None if pd.isna(row[k]) else row[k] for k in keys)
                if state is None or key != current:
                    current, state = key, start()
                got = step(state, row)
                if got is not None:
                    out.append([got[n] for n in names])
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def title_words(title) -> frozenset[str]:
    if not isinstance(title, str):
        return frozenset()
    return frozenset(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", title).lower()))


def overlap(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def bits(hi: int, lo: int) -> int:
    return (int(hi) << 32) | int(lo)


def drop_near(df: DataFrame, key: str, order: list[str], ident: str, bits_apart: int = NEAR_BITS, look_back: int = NEAR_LOOK_BACK) -> DataFrame:
    """(key, ident) of the rows kept: those within ``bits_apart`` of none of the last ``look_back`` kept ones.

    Rows have sim_hi and sim_lo. Zero hashes, of empty texts, are kept and compared with nothing.
    """

    def step(kept: deque, row: dict):
        h = bits(row["sim_hi"], row["sim_lo"])
        if h and any((h ^ k).bit_count() <= bits_apart for k in kept):
            return None
        if h:
            kept.append(h)
        return row

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, ident))
    return fold(df.select(key, ident, "sim_hi", "sim_lo", *[o for o in order if o not in (key, ident)]), [key], order, lambda: deque(maxlen=look_back), step, schema)


def assign_stories(df: DataFrame, key: str, order: list[str], ident: str, title: str = "title", look_back: int = STORY_LOOK_BACK) -> DataFrame:
    """(key, ident, story): the story of the best of the last rows, near by hash or by title; else its own.

    A row counts 2 for a near hash plus the overlap of titles; among equal ones the latest wins.
    """

    def step(recent: deque, row: dict):
        h, words, best, story = bits(row["sim_hi"], row["sim_lo"]), title_words(row[title]), 0.0, None
        for other, other_words, other_story in recent:
            near = bool(h) and bool(other) and (h ^ other).bit_count() <= NEAR_BITS
            share = overlap(words, other_words)
            score = 2.0 * near + share
            if (near or share >= STORY_OVERLAP) and score > best:
                best, story = score, other_story
        story = story or str(row[ident])
        recent.appendleft((h, words, story))
        return {**row, "story": story}

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, ident)) + ", story string"
    return fold(df.select(key, ident, title, "sim_hi", "sim_lo", *[o for o in order if o not in (key, ident, title)]), [key], order, lambda: deque(maxlen=look_back), step, schema)


def domain_tokens(df: DataFrame, key: str = "domain", order: tuple[str, ...] = ("at_ms", "seq"), concurrency: int = 2, delay_ms: int = 500) -> DataFrame:
    """(key, seq, granted, retry_ms) of acquire rows, as each domain's requests and releases come in.

    Rows have at_ms, seq, kind (acquire or release), status and retry_after_ms. A token is granted where
    fewer than ``concurrency`` are out, the delay since the last one is over, and no back-off runs;
    a release with status 429 or 403 backs off for its retry time.
    """
    concurrency, delay_ms = max(1, min(8, concurrency)), max(0, min(60_000, delay_ms))

    def step(state: dict, row: dict):
        now = int(row["at_ms"])
        if row["kind"] == "release":
            state["out"] = max(state["out"] - 1, 0)
            if row["status"] in (429, 403):
                state["backoff"] = max(state["backoff"], now + max(0, int(row["retry_after_ms"] or 0)))
            return None
        blocked = max(state["next"], state["backoff"])
        granted = state["out"] < concurrency and blocked <= now
        if granted:
            state["out"] += 1
            state["next"] = now + delay_ms
        return {key: row[key], "seq": row["seq"], "granted": granted, "retry_ms": 0 if granted else max(250, blocked - now)}

    return fold(df, [key], list(order), lambda: {"out": 0, "next": 0, "backoff": 0}, step, f"`{key}` string, seq bigint, granted boolean, retry_ms bigint")


def pool_tokens(df: DataFrame, key: str = "pool", order: tuple[str, ...] = ("at_ms", "seq"), most: int = 100) -> DataFrame:
    """(key, seq, granted, active) of acquire rows: a token is granted while fewer than ``most`` (110 at the utmost) are out; releases give one back."""
    most = max(1, min(110, most))

    def step(state: dict, row: dict):
        if row["kind"] == "release":
            state["out"] = max(state["out"] - 1, 0)
            return None
        granted = state["out"] < most
        state["out"] += granted
        return {key: row[key], "seq": row["seq"], "granted": granted, "active": state["out"]}

    return fold(df, [key], list(order), lambda: {"out": 0}, step, f"`{key}` string, seq bigint, granted boolean, active int")
