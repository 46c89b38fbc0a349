"""Exact and near duplicates, stories, and searches by vectors and titles."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from mentia.functions.hashing import hamming, jaccard
from mentia.session import cut


#: Queries a block of the exact vector search: what one task holds of them, however many there are.
BLOCK_QUERIES = 500


def first_wins(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return _ranked(df, keys, order).filter("__n = 1").drop("__n")


def latest_wins(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The last row of each key, as repeated upserts leave it. ``order`` is ascending."""
    return _ranked(df, keys, [o.desc() for o in order]).filter("__n = 1").drop("__n")


def top_per(df: DataFrame, keys: list[Column], order: list[Column], most: int, place: str | None = None) -> DataFrame:
    """At most ``most`` rows of each key; with their ``place``, a bigint from 1, if it is named."""
    rows = _ranked(df, keys, order).filter(F.col("__n") <= most)
    return (rows.withColumn(place, F.col("__n").cast("bigint")) if place else rows).drop("__n")


def clamp_threshold(bits: int) -> int:
    """A threshold of Hamming distances within its bounds."""
    return max(0, min(32, bits))


def _ranked(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    # a filter on a rank is pushed to before the shuffle, so a hot key sends few rows a map task
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def insert_absent(new: DataFrame, target: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``new`` to append: the first of each key that ``target`` doesn't have."""
    return first_wins(new, [F.col(k) for k in keys], order).join(target.select(*keys), keys, "left_anti")


def band_rows(sims: DataFrame, key: str, threshold: int = 3, spare: int = 3) -> DataFrame:
    """(key, sim_hi, sim_lo, band, value): the tables of a search within ``threshold`` bits of a 64-bit SimHash.

    The bits are cut into threshold + ``spare`` blocks; a table's key is ``spare`` of them. Two hashes within the
    threshold agree in that many blocks at least, so an equi-join on the keys is exact, and with 3 and 3 the 20 keys
    have some 32 bits each: unlike hashes seldom meet, however many there are. Zero hashes, those of empty texts,
    are left out: they would all meet in one bucket.
    """
    blocks = threshold + spare
    bounds = [round(64 * k / blocks) for k in range(blocks + 1)]

    def limb_bits(low: int, high: int) -> list[tuple[Column, int]]:
        runs, at = [], low
        while at < high:
            stop = min(high, 32 if at < 32 else 64)
            limb = F.col("sim_lo") if at < 32 else F.col("sim_hi")
            runs.append((F.shiftright(limb, at % 32).bitwiseAND(F.lit((1 << (stop - at)) - 1)), stop - at))
            at = stop
        return runs

    value = []
    for band, chosen in enumerate(itertools.combinations(range(blocks), spare)):
        out = F.lit(0).cast("bigint")
        for block in chosen:
            for bits, width in limb_bits(bounds[block], bounds[block + 1]):
                out = F.shiftleft(out, width).bitwiseOR(bits)
        value.append(F.struct(F.lit(band).alias("band"), out.alias("value")))
    return sims.filter("sim_hi <> 0 or sim_lo <> 0").select(key, "sim_hi", "sim_lo", F.inline(F.array(*value)))


def near_pairs(sims: DataFrame, key: str, threshold: int = 3) -> DataFrame:
    """(a, b, distance) between different SimHashes within ``threshold`` bits, a < b being each hash's least key.

    Rows of one hash form one class, led by its least key; they are not expanded into pairs.
    """
    classes = sims.groupBy("sim_hi", "sim_lo").agg(F.min(key).alias(key))
    rows = band_rows(classes, key, threshold)
    a = rows.select(F.col(key).alias("a"), F.col("sim_hi").alias("ah"), F.col("sim_lo").alias("al"), "band", "value")
    b = rows.select(F.col(key).alias("b"), F.col("sim_hi").alias("bh"), F.col("sim_lo").alias("bl"), "band", "value")
    distance = hamming(F.col("ah"), F.col("al"), F.col("bh"), F.col("bl"))
    met = a.join(b, ["band", "value"]).filter(F.col("a") < F.col("b")).withColumn("distance", distance).filter(F.col("distance") <= threshold)
    return met.select("a", "b", "distance").distinct()


def near_classes(sims: DataFrame, key: str, threshold: int = 3) -> DataFrame:
    """(key, class_id, links): a row's class, the least key of its SimHash, and its class's near classes."""
    classes = sims.groupBy("sim_hi", "sim_lo").agg(F.min(key).alias("class_id"))
    pairs = near_pairs(sims, key, threshold)
    links = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("links"))
    return sims.join(classes, ["sim_hi", "sim_lo"]).join(links, "class_id", "left").select(key, "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, component): least key of everything a node is linked to, by alternating large and small stars.

    The number of rounds grows with the logarithm of the longest chain; each round is cut.
    """
    pairs = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        after = down.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = cut(after)
        changed = after.exceptAll(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()).isEmpty() and after.count() == pairs.count()
        pairs = after
        if changed:
            break
    roots = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(key).join(roots.withColumnRenamed("u", key), key, "left").withColumn("component", F.coalesce("component", key))


def title_matches(df: DataFrame, key: str, words: Column, queries: Column, least: float = 0.55) -> DataFrame:
    """(query_id, key, overlap) of rows whose words overlap those of a query row by ``least`` or more.

    ``queries`` says which rows are queries. Words are an inverted index: a pair needs a word in common,
    and of its rarest ones, as a set of n words that overlaps by t shares one of any n - ceil(t n) + 1.
    """
    rows = df.select(F.col(key), F.array_distinct(words).alias("w"), queries.alias("q")).filter(F.size("w") > 0)
    often = rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = rows.select(key, "q", F.explode("w").alias("word")).join(often, "word").groupBy(key, "q").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("by"))
    prefix = ranked.select(key, "q", F.explode(F.slice("by", 1, F.greatest(F.lit(1), (F.size("by") - F.ceil(F.size("by") * F.lit(least)) + 1).cast("int")))).alias("p")).select(key, "q", F.col("p.word").alias("word"))
    met = prefix.filter("q").select(F.col(key).alias("query_id"), "word").join(prefix.select(key, "word"), "word").filter(F.col("query_id") != F.col(key)).select("query_id", key).distinct()
    a = rows.select(F.col(key).alias("query_id"), F.col("w").alias("wa"))
    return met.join(a, "query_id").join(rows.select(key, F.col("w").alias("wb")), key).withColumn("overlap", jaccard(F.col("wa"), F.col("wb"))).filter(F.col("overlap") >= least).select("query_id", key, "overlap")


def nearest_vectors(df: DataFrame, key: str, vector: str, queries: Column, most: int = 10, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, key, similarity, place): the nearest rows of every query row by cosine, against all rows, exactly.

    Query rows are packed in blocks of a stated number; a task multiplies a batch of rows with one block as matrices
    and keeps ``most`` a query before anything is shuffled. Rows go to tasks by block and a salt, so that few
    blocks make no few tasks. Vectors are of one length; rows of zero length are near to nothing.
    """
    spark = df.sparkSession
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    rows = df.select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double") / norm).alias("v"), norm.alias("len"), queries.alias("q")).filter("len > 0").drop("len")
    count = max(1, -(-rows.filter("q").count() // block))
    # a block is a bounded list, so each is read by its tasks and none is sent to all
    asked = rows.filter("q").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)))
    salts = max(1, spark.sparkContext.defaultParallelism)
    blocks = asked.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("qs")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))).alias("block"))
    kind = df.schema[key].dataType.simpleString()

    def run(_, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        out = []
        q_ids, q = [s["id"] for s in right["qs"].iloc[0]], np.array([s["v"] for s in right["qs"].iloc[0]])
        for at in range(0, len(left), 4096):
            part = left.iloc[at : at + 4096]
            ids, scores = part["id"].to_numpy(), q @ np.stack(part["v"].to_numpy()).T
            for i, ident in enumerate(q_ids):
                row = np.where(ids == ident, -np.inf, scores[i])
                k = min(most, len(row))
                # all ties of the last one stay, to be settled by their keys
                floor = np.partition(row, len(row) - k)[len(row) - k] - 1e-8
                near = np.flatnonzero((row >= floor) & np.isfinite(row))
                out.append(pd.DataFrame({"query_id": ident, "id": ids[near], "similarity": row[near]}))
        return pd.concat(out)

    scored = spread.groupBy("block", "salt").cogroup(blocks.groupBy("block", "salt")).applyInPandas(run, f"query_id {kind}, id {kind}, similarity double").withColumnRenamed("id", key)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), key))
    return scored.withColumn("place", place).filter(F.col("place") <= most)
