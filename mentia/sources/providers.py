"""Providers of candidates over landed feeds and answers, each with its own filters. A limit is a request's parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mentia.boolean import matches, parse
from mentia.functions import urls as U
from mentia.functions.text import norm_text
from mentia.operators.dedupe import first_wins
from mentia.sources.feeds import CANDIDATE, read_feeds, read_sitemaps

#: Hosts of the public searches restricted to one site.
SOCIAL_HOSTS = {"facebook": ["facebook.com"], "tiktok": ["tiktok.com"], "linkedin": ["linkedin.com"]}


def matching(candidates: DataFrame, query: str) -> DataFrame:
    """Candidates whose title and snippet match a Boolean query."""
    both = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))
    return candidates.filter(matches(parse(query), norm_text(both)))


def first_by_address(candidates: DataFrame, order: list[str]) -> DataFrame:
    """The first candidate of each address, case aside."""
    return first_wins(candidates, [F.lower("url")], [F.col(o) for o in order])


def asked(candidates: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """As many candidates as a request asks for; all without a limit."""
    return candidates if limit is None else candidates.orderBy(*order).limit(limit)


def configured_feeds(landed: DataFrame, query: str, limit: int | None = None, order: tuple[str, ...] = ("seq", "url")) -> DataFrame:
    """Candidates of landed feeds (seq, xml, feed_url) that match the query."""
    return asked(matching(read_feeds(landed, keep=["seq"]), query), [*order], limit)


def news_feeds(landed: DataFrame, interstitial: str = "news.google.com", limit: int | None = None) -> DataFrame:
    """Candidates of news feeds: click redirectors unwrapped, an aggregator's own pages dropped, each address once."""
    rows = read_feeds(landed, keep=["seq"]).withColumn("url", U.unwrap_redirect(F.col("url")))
    rows = rows.filter(F.col("url").isNotNull() & ~U.on_hosts(F.col("url"), [interstitial])).withColumn("source", F.lit("news"))
    return asked(first_by_address(rows, ["seq", "url"]), ["seq", "url"], limit)


def tag_feeds(landed: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Candidates of topic feeds that match the query, each address once."""
    return asked(first_by_address(matching(read_feeds(landed, keep=["seq"]), query), ["seq", "url"]), ["seq", "url"], limit)


def forum_feeds(landed: DataFrame, limit: int | None = None) -> DataFrame:
    """Posts of a forum's public search feed, at their canonical addresses, each once."""
    rows = read_feeds(landed, keep=["seq"]).withColumn("url", U.post_permalink(F.col("url"))).filter("url is not null").withColumn("source", F.lit("reddit"))
    return asked(first_by_address(rows, ["seq", "url"]), ["seq", "url"], limit)


def sitemaps(landed: DataFrame, limit: int | None = None) -> DataFrame:
    """Locations of landed sitemaps (seq, xml), in order."""
    return asked(read_sitemaps(landed, keep=["seq"]), ["seq", "url"], limit)


def social_feeds(landed: DataFrame, network: str, limit: int | None = None) -> DataFrame:
    """Results of a search restricted to one network's hosts: others are dropped, each address once."""
    rows = read_feeds(landed, keep=["seq"]).filter(U.on_hosts(F.col("url"), SOCIAL_HOSTS[network])).withColumn("source", F.lit(network))
    return asked(first_by_address(rows, ["seq", "url"]), ["seq", "url"], limit)


def profile_candidates(monitors: DataFrame, profile: str = "profile", keep: tuple[str, ...] = ("monitor_id",)) -> DataFrame:
    """Addresses of monitors' profiles as candidates that come before all others."""
    rows = monitors.select(*keep, F.inline(U.profile_seeds(F.col(profile))))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in CANDIDATE if f.name not in ("source", "url", "metadata")]
    return rows.select(*keep, F.lit("web").alias("source"), "url", *empty, F.create_map(F.lit("provider"), F.lit("profile"), F.lit("profileKey"), F.col("key")).alias("metadata"))


def merged_feeds(feeds: DataFrame, url: str = "url", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The first of feed addresses that differ by case or slashes at the end; blank ones are dropped."""
    return first_wins(feeds.withColumn(url, F.trim(url)).filter(F.col(url) != ""), [U.merge_key(F.col(url))], [F.col(o) for o in order])
