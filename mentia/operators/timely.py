"""Operators along time: rates, bursts, spikes, as-of joins, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mentia.functions.hashing import shard_index


def velocity(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, per_hour): mean growth an hour between consecutive snapshots, 0 for fewer than two times."""
    order = Window.partitionBy(key).orderBy(at, value)
    hours = (F.unix_micros(at) - F.unix_micros(F.lag(at).over(order))) / 3_600_000_000
    steps = df.select(key, at, value).withColumns({"hours": hours, "delta": F.col(value) - F.lag(value).over(order)})
    return steps.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("hours") > 0, F.col("delta") / F.col("hours"))), F.lit(0.0)).alias("per_hour"))


def rates(df: DataFrame, at: str, keys: list[str], width: str = "15 minutes", **sums: Column) -> DataFrame:
    """Rows and ``sums`` of each key in tumbling windows."""
    return df.groupBy(*keys, F.window(at, width).alias("w")).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items())).select(*keys, F.col("w.start").alias("window_start"), "n", *sums)


def adaptive_interval(mentions: Column, negatives: Column) -> Column:
    """Minutes to the next scan by the rates of the last quarter of an hour."""
    return F.when(negatives >= 5, 2).when((negatives >= 2) | (mentions >= 20), 5).when(mentions >= 8, 10).when(mentions >= 2, 15).otherwise(30)


def bursts(df: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(key, started, ended, n): runs of rows without a pause of ``gap``."""
    return df.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("ended")).select(key, F.col("w.start").alias("started"), "ended", "n")


def spikes(daily: DataFrame, key: str, day: str, n: str, days: int = 7, deviations: float = 2.0) -> DataFrame:
    """Days whose count passes the mean of the ``days`` before by ``deviations`` standard deviations."""
    before = Window.partitionBy(key).orderBy(F.datediff(day, F.lit("1970-01-01"))).rangeBetween(-days, -1)
    return daily.withColumns({"mean": F.avg(n).over(before), "deviation": F.stddev_pop(n).over(before)}).filter(F.col(n) > F.col("mean") + deviations * F.col("deviation"))


def cooled(df: DataFrame, keys: list[str], at: str, minutes: int) -> DataFrame:
    """Rows without an earlier row of the same keys in the last ``minutes``."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    return df.withColumn("__before", before).filter(F.col("__before").isNull() | (F.unix_micros(at) - F.unix_micros("__before") >= minutes * 60_000_000)).drop("__before")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str], span: str = "day") -> DataFrame:
    """``left`` with the columns ``take`` of the latest ``right`` row at or before its time, null where none.

    One union and windows instead of a range join; right rows stand before left rows of one time. Rows are split by
    ``span`` too, so that a hot key is many tasks; what a span leaves behind is carried over spans, of which there
    are few a key.
    """
    kind = "struct<" + ",".join(f"`{c}`:{right.schema[c].dataType.simpleString()}" for c in take) + ">"
    l_rows = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__got"))
    r_rows = right.select(*keys, at, F.lit(0).alias("__side"), F.struct(*take).alias("__got"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True).withColumn("__span", F.date_trunc(span, F.col(at).cast("timestamp")))
    order = Window.partitionBy(*keys, "__span").orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__got", F.last("__got", ignorenulls=True).over(order)).filter("__side = 1")
    # the last row of each span of the right side, carried to the spans after it
    spans = r_rows.groupBy(*keys, F.date_trunc(span, F.col(at).cast("timestamp")).alias("__span")).agg(F.max_by("__got", F.struct(at)).alias("__last"))
    wanted = l_rows.select(*keys, F.date_trunc(span, F.col(at).cast("timestamp")).alias("__span")).distinct().withColumn("__last", F.lit(None).cast(kind))
    carried = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    before = spans.unionByName(wanted).groupBy(*keys, "__span").agg(F.first("__last", ignorenulls=True).alias("__last")).withColumn("__before", carried).drop("__last").filter("__before is not null")
    on = [both[k].eqNullSafe(before[k]) for k in (*keys, "__span")]
    met = both.join(before, on, "left")
    got = F.coalesce(both["__got"], before["__before"])
    return met.select(*(both[c] for c in left.columns), *(got[c].alias(c) for c in take))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, **quantiles: float) -> DataFrame:
    """(keys, n, one column a quantile): discrete quantiles of a whole-number column, exactly.

    Values are counted first. Ranks are found in two steps, over ranges of values and within the one that holds
    the rank, so that no key's values are held in one task.
    """
    counts = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    # ranges double in width with the size of a value: some thousand a key, whatever the values are
    size = F.floor(F.log2(F.abs(F.col("v").cast("double")) + 1)).cast("int")
    slot = F.floor((F.abs(F.col("v").cast("double")) + 1) / F.pow(F.lit(2.0), size) * 64).cast("int")
    counts = counts.withColumn("range", F.when(F.col("v") < 0, -1).otherwise(1) * (size * 128 + slot))
    ranges = counts.groupBy(*keys, "range").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys).orderBy("range")
    ranges = ranges.withColumns({"upto": F.sum("n").over(by), "total": F.sum("n").over(Window.partitionBy(*keys))})
    asked = F.inline(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in quantiles.items())))
    ranges = ranges.select("*", asked).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total"))))
    hit = ranges.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(*keys, "range", "name", "total", (F.col("rank") - F.col("upto") + F.col("n")).alias("left"))
    hit = hit.withColumnsRenamed({k: f"__{k}" for k in (*keys, "range")})
    inside = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "range").orderBy("v")))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, "range")]
    found = inside.join(hit, on).filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
    return found.groupBy(*keys).agg(F.max("total").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in quantiles))


def claimable(status: Column, next_scan_at: Column, claimed_until: Column, now: Column) -> Column:
    """Active, due, and without a lease that still runs."""
    return (status == "active") & (next_scan_at <= now) & (claimed_until.isNull() | (claimed_until < now))


def claim(due: DataFrame, now: Column, limit: int = 50, lease_seconds: int = 120, shards: int = 64) -> DataFrame:
    """Rows to claim: at most ``limit`` a shard, the longest due first, with their lease and next time.

    The next time is an interval after the later of the old one and now.
    """
    limit, lease_seconds = max(1, min(200, limit)), max(15, min(3600, lease_seconds))
    open_rows = due.filter(claimable(F.col("status"), F.col("next_scan_at"), F.col("claimed_until"), now)).withColumn("shard", shard_index(F.col("tenant_id"), shards))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("next_scan_at", "monitor_id"))
    every = F.greatest(F.lit(1), F.col("scan_interval_sec")).cast("bigint")
    taken = open_rows.withColumn("place", place).filter(F.col("place") <= limit)
    return taken.withColumns({"claimed_until": F.timestamp_micros(F.unix_micros(now) + lease_seconds * 1_000_000), "next_scan_at": F.timestamp_micros(F.unix_micros(F.greatest("next_scan_at", now)) + every * 1_000_000)}).drop("place")
