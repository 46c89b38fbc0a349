"""Problem 4: lines repeated across the documents of one site.

Two lines are the same if their letters are, ignoring case and all that is no letter. The documents of
a line, told apart by address, are kept as compressed bitmaps per site: one container for each 32,768
address ordinals, and only where the line occurs. Variants of a line share a key, so building by key is
the union of their bitmaps; cardinalities are exact. A line goes where its count reaches ``min_urls``
and ``min_share`` of the site's addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mentia.session import cut

MIN_URLS, MIN_SHARE = 5, 0.1
#: Parts of a site whose addresses are numbered beside each other.
PARTS = 256


def site_of(url: Column) -> Column:
    """Host of an address in lower case without user, port and leading ``www.`` or ``m.``; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", 1)
    host = F.regexp_replace(host, r"^(?:www|m)\.", "")
    return F.when(host != "", host)


def letters(line: Column) -> Column:
    """The letters of a line in lower case, the sharp s as two, one after another."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\p{L}]+", ""), "ß", "ss")


def lines_of(df: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """(key, site, line_no, h1, h2) of every line with letters. (h1, h2) is the line's 128-bit code."""
    rows = df.filter(F.col(url).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.coalesce(site_of(F.col(url)), F.lit("")).alias("site"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    rows = rows.select("key", "site", (F.col("pos") + 1).cast("bigint").alias("line_no"), letters(F.col("line")).alias("line")).filter("line <> ''")
    # two independent 64-bit hashes stand for the line in shuffles; among 10^12 different lines the
    # chance of one clash is about 10^-15
    return rows.select("key", "site", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.reverse("line")).alias("h2"))


def _numbered(addresses: DataFrame) -> DataFrame:
    """(site, url, ordinal): dense numbers from 0 within each site, so that a site of m addresses has m / 32,768 containers.

    Numbered in two steps: within parts of a site, and over its parts, of which there are PARTS at the most.
    """
    rows = addresses.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("site", "part").orderBy("url")) - 1)
    sizes = rows.groupBy("site", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("site", "part", before.alias("base")), ["site", "part"]).select("site", "url", (F.col("base") + F.col("n")).cast("bigint").alias("ordinal"))


def repeated_lines(df: DataFrame, key: str = "norm_id", url: str = "canonical_url", text: str = "text", min_urls: int = MIN_URLS, min_share: float = MIN_SHARE) -> DataFrame:
    """(key, line_no) of the lines of ``df`` that their site repeats, lines counted from 1.

    Rows with a null address or text have none; addresses without a host are one site. Lines without
    letters don't count. Repeated rows each come out; a line counts once for each different address,
    however often it stands there. Other columns are ignored. An empty input gives an empty result.
    """
    lines = lines_of(df, key, url, text)
    # a line that stands fewer than min_urls times has no min_urls addresses: most lines go here, before
    # any bitmap; partial sums, so a hot line sends one row a map task
    dictionary = lines.groupBy("site", "h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_urls).drop("n")
    dictionary = cut(dictionary.withColumn("line_id", F.monotonically_increasing_id()))
    met = cut(lines.join(dictionary, ["site", "h1", "h2"]).select("key", "site", "line_no", "line_id"))

    addresses = df.filter(F.col(url).isNotNull()).select(F.coalesce(site_of(F.col(url)), F.lit("")).alias("site"), F.col(url).alias("url"))
    ordinals = cut(_numbered(addresses.distinct()))
    totals = ordinals.groupBy("site").agg(F.count("*").alias("total"))
    at = df.filter(F.col(url).isNotNull()).select(F.col(key).alias("key"), F.col(url).alias("url")).join(ordinals, "url").select("key", "ordinal").distinct()
    hits = met.select("key", "line_id", "site").distinct().join(at, "key")
    containers = hits.groupBy("line_id", "site", F.bitmap_bucket_number("ordinal").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("ordinal")).alias("bits"))
    counts = containers.groupBy("line_id", "site").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    frequent = counts.join(totals, "site").filter((F.col("n") >= min_urls) & (F.col("n") >= min_share * F.col("total"))).select("line_id")
    return met.join(frequent, "line_id", "left_semi").select(F.col("key").alias(key), "line_no")


def drop_repeated_lines(df: DataFrame, key: str = "norm_id", url: str = "canonical_url", text: str = "text", **limits) -> DataFrame:
    """``df`` with those lines deleted from ``text``; null texts stay null. ``key`` must be unique."""
    gone = repeated_lines(df, key, url, text, **limits).groupBy(key).agg(F.collect_set("line_no").alias("__gone"))
    kept = F.array_join(F.transform(F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(x.alias("x"), (i + 1).cast("bigint").alias("n"))), lambda s: ~F.array_contains("__gone", s["n"])), lambda s: s["x"]), "\n")
    return df.join(gone, key, "left").withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)).drop("__gone")
