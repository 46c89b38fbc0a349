"""Problem 9: sources combined to target weights by token size.

The tokens of each source are packed into blocks of fixed length, documents in the order of their id.
The output is shards of a fixed number of slots; each shard draws the counts of its sources from a
multinomial with the target shares, and the j-th slot of a source takes block perm(j mod n) of its
repetition j div n, perm being a keyed permutation of the source's n blocks that differs between
repetitions. Slots and blocks then meet in one join by (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from mentia.llm.encode import TOKENIZERS, count_tokens
from mentia.session import cut

BLOCK, SLOTS, SEED = 1024, 256, 17
#: Standard deviations that a source's cap stays above its expected draws.
MARGIN = 4.0
#: Documents a bucket of the running sums has on average, and shards a step of the running draws.
RUN, STEP = 4096, 4096


def blocks_of(counted: DataFrame, block: int = BLOCK, key: str = "doc_id") -> DataFrame:
    """(source, block, doc_id, first, n): the pieces of documents in each block of their source.

    ``counted`` has (source, key, n_tokens) of documents with tokens. ``first`` is the place of the piece's
    first token in its document. Only the last block of a source is short.
    """
    # running sums in two steps, so that no source, however large, is summed in one task: within buckets of keys by
    # their hash, and over the buckets, of which there are RUN times fewer than documents
    buckets = counted.groupBy("source").agg(F.ceil(F.count("*") / RUN).alias("buckets"))
    rows = counted.join(buckets, "source").withColumn("run", F.pmod(F.xxhash64(key), F.col("buckets"))).drop("buckets")
    runs = rows.groupBy("source", "run").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("base", before).drop("size")
    within = F.sum("n_tokens").over(Window.partitionBy("source", "run").orderBy(key, "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", within).join(runs, ["source", "run"]).withColumn("start", F.col("base") + F.col("upto") - F.col("n_tokens"))
    last = F.col("start") + F.col("n_tokens") - 1
    rows = rows.withColumn("last", last).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("last") / block))))
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("last"), (F.col("block") + 1) * block - 1)
    return rows.select("source", "block", F.col(key), (low - F.col("start")).cast("bigint").alias("first"), (high - low + 1).cast("bigint").alias("n"))


def plan(targets: DataFrame, sizes: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(mix_name, source, share, cap, blocks, total): how much each mix can hold.

    Shares are those of the sources that have blocks, scaled to 1. ``total`` is the largest number of
    slots at which no source is expected to pass its cap less MARGIN deviations; of a shard's slots at
    least. A null or negative share counts 0 and a null cap 1.
    """
    rows = targets.select("mix_name", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("wanted"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("repeats")).join(sizes, "source").filter((F.col("wanted") > 0) & (F.col("repeats") > 0))
    mix = Window.partitionBy("mix_name")
    rows = rows.withColumn("share", F.col("wanted") / F.sum("wanted").over(mix)).withColumn("cap", F.col("repeats") * F.col("blocks"))
    # expected + MARGIN * sqrt(expected) <= cap, solved for the expected draws
    root = (-F.lit(MARGIN) + F.sqrt(F.lit(MARGIN**2) + 4 * F.col("cap"))) / 2
    most = F.min(F.pow(root, 2) / F.col("share")).over(mix)
    total = F.greatest(F.floor(most / slots), F.lit(1)) * slots
    return rows.select("mix_name", "source", "share", "cap", "blocks", total.cast("bigint").alias("total"))


def draws(planned: DataFrame, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(mix_name, shard, source, n): multinomial counts of each shard. The same for the same seed."""
    mixes = planned.groupBy("mix_name").agg(F.sort_array(F.collect_list(F.struct("source", "share"))).alias("parts"), F.first("total").alias("total"))
    # from one row a mix to its shards in two steps, so that they aren't made by one task
    steps = mixes.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") / slots - 1) / STEP).cast("int")))).repartition("mix_name", "step")
    last = F.least((F.col("step") + 1) * STEP, (F.col("total") / slots).cast("int")) - 1
    shards = steps.withColumn("shard", F.explode(F.sequence(F.col("step") * STEP, last)))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for name, shard, parts in zip(pdf["mix_name"], pdf["shard"], pdf["parts"]):
                rng = np.random.default_rng([seed, int(shard), *name.encode()])
                share = np.array([p["share"] for p in parts], float)
                for part, n in zip(parts, rng.multinomial(slots, share / share.sum())):
                    out.append((name, int(shard), part["source"], int(n)))
            yield pd.DataFrame(out, columns=["mix_name", "shard", "source", "n"])

    return shards.select("mix_name", "shard", "parts").mapInPandas(run, "mix_name string, shard int, source string, n bigint")


def permuted(index: Column, size: Column, *salt: Column) -> Column:
    """A keyed permutation of 0..size-1: four Feistel rounds on the square above, walked until inside."""
    side = F.ceil(F.sqrt(size.cast("double")))
    side = F.when(side * side < size, side + 1).otherwise(side).cast("bigint")

    def once(x: Column) -> Column:
        left, right = F.floor(x / side).cast("bigint"), F.pmod(x, side)
        for turn in range(4):
            left, right = right, F.pmod(left + F.pmod(F.xxhash64(right, F.lit(turn), *salt), side), side)
        return left * side + right

    # the walk of x stays in the cycle of x, which holds an element below size; a square exceeds size by less than 2
    # sides, so few steps are needed. What 64 leave outside is an error
    step = lambda x, _: F.when(x < size, x).otherwise(once(x))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(index), step)
    return F.when(out < size, out).otherwise(F.raise_error(F.lit("a permutation didn't end")).cast("bigint"))


def slots_of(planned: DataFrame, drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """(mix_name, shard, slot, source, repeat, block): what stands in each slot.

    Shards from the first on in which a source would pass its cap, which the margin makes all but impossible, are left
    out whole, so that every shard has all its slots.
    """
    # running draws in two steps: within STEP shards, and over the steps
    rows = drawn.withColumn("step", F.floor(F.col("shard") / STEP))
    steps = rows.groupBy("mix_name", "source", "step").agg(F.sum("n").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("mix_name", "source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.select("mix_name", "source", "step", before.alias("base"))
    within = F.sum("n").over(Window.partitionBy("mix_name", "source", "step").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", within).join(steps, ["mix_name", "source", "step"]).withColumn("upto", F.col("upto") + F.col("base")).drop("base", "step")
    rows = rows.join(planned.select("mix_name", "source", "cap", "blocks"), ["mix_name", "source"])
    over = rows.filter(F.col("upto") > F.col("cap")).groupBy("mix_name").agg(F.min("shard").alias("over"))
    rows = rows.join(over, "mix_name", "left").filter(F.col("over").isNull() | (F.col("shard") < F.col("over"))).drop("over")
    rows = rows.filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    rows = rows.withColumn("j", F.col("upto") - F.col("n") + F.col("k"))
    rows = rows.withColumn("repeat", F.floor(F.col("j") / F.col("blocks")).cast("bigint")).withColumn("i", F.pmod("j", "blocks"))
    block = permuted(F.col("i"), F.col("blocks"), F.lit(seed), F.col("mix_name"), F.col("source"), F.col("repeat"))
    slot = F.pmod(F.xxhash64("source", "k"), F.lit(1 << 30))
    order = F.row_number().over(Window.partitionBy("mix_name", "shard").orderBy(slot, "source", "k")) - 1
    return rows.select("mix_name", "shard", order.alias("slot"), "source", "repeat", block.alias("block"))


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, folder: str = TOKENIZERS) -> DataFrame:
    """(mix_name, shard, slot, source, repeat, block, doc_id, first, n): the pieces in every slot.

    A document without tokens or of no target's source is in no slot. A source without documents has no
    slot and its share goes to the others in proportion. Repeated documents each count. Empty tables
    give an empty result.
    """
    wanted = documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi") if _small(targets) else documents.join(targets.select("source").distinct(), "source", "left_semi")
    # tokens are counted once
    counted = cut(count_tokens(wanted, ["source", key], folder=folder).filter("n_tokens > 0"))
    pieces = cut(blocks_of(counted, block, key))
    sizes = pieces.groupBy("source").agg((F.max("block") + 1).alias("blocks"))
    planned = cut(plan(targets, sizes, slots))
    return slots_of(planned, cut(draws(planned, slots, seed)), seed).join(pieces, ["source", "block"]).select("mix_name", "shard", "slot", "source", "repeat", "block", key, "first", "n")


def _small(df: DataFrame, rows: int = 10_000) -> bool:
    """Whether a table has at most ``rows`` rows, reading no more."""
    return df.limit(rows + 1).count() <= rows


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, tokens, actual_share, most_repeats) of every target, reached or not."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum("n").alias("tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    rows = targets.select("mix_name", "source", "target_share").join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "most_repeats"])
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return rows.select("mix_name", "source", "target_share", "tokens", F.when(total > 0, F.col("tokens") / total).alias("actual_share"), "most_repeats")
