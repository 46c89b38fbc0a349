"""The same operators over streams: watermarked windows, idempotent batches, keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mentia.operators.deliveries import SeenStore


def landed(spark: SparkSession, path: str, schema, files_per_batch: int = 20) -> DataFrame:
    """A stream of Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_rates(stream: DataFrame, at: str, keys: list[str], late: str = "10 minutes", width: str = "15 minutes", slide: str | None = None, **sums: Column) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; rows later than ``late`` are dropped."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    grouped = stream.withWatermark(at, late).groupBy(window.alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items())).select(*keys, F.col("w.start").alias("window_start"), "n", *sums)


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's rows without a pause of ``gap``."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")


def suppressed(stream: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key; repeats inside the watermark go."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def once_only(stream: DataFrame, store: SeenStore, write: Callable[[DataFrame, int], None], checkpoint: str, name: str = "messages", ident: str = "job_id") -> StreamingQuery:
    """Deliveries handed on once: each micro-batch accepts unseen identifiers of the store.

    The store's mark names the micro-batch, and the accepted messages are part of what it makes current. A batch that is
    run again after a loss, wherever it was lost, is given the same messages and writes the same rows; ``write`` must
    replace what it wrote for the batch's number.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.lit(name).alias("name"), F.col(ident).alias("ident"), "received_at", "message_id")
        kept = store.accept(rows, f"{name}-{number}").filter(F.col("name") == name).select("message_id")
        write(batch.join(kept, "message_id", "left_semi"), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_dead_letters(stream: DataFrame, usable: Column, write: Callable[[DataFrame, int], None], dead: str, checkpoint: str, retries: int = 3) -> StreamingQuery:
    """Rows that can be used are written, with so many retries; those that can't are kept below ``dead`` by batch, with what was wrong.

    A batch that fails every time goes to ``dead`` as a whole, so that the ones behind it go on.
    """

    def each(batch: DataFrame, number: int) -> None:
        reason = F.when(F.coalesce(usable, F.lit(False)), F.lit(None).cast("string")).otherwise("unusable")
        marked = batch.withColumn("__reason", reason)
        failed = None
        for _ in range(1 + retries):
            try:
                write(marked.filter("__reason is null").drop("__reason"), number)
                failed = None
                break
            except Exception as e:  # the batch must not end the stream
                failed = f"{type(e).__name__}: {e}"[:500]
        left = marked.filter("__reason is not null") if failed is None else marked.withColumn("__reason", F.coalesce("__reason", F.lit(failed)))
        left.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matched_in_time(left: DataFrame, right: DataFrame, key: str, at: tuple[str, str], within: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of two streams of the same key, the right one at most ``within`` after the left: old state is dropped on both sides."""
    l_at, r_at = at
    a = left.withWatermark(l_at, late).withColumnRenamed(key, "__key")
    b = right.withWatermark(r_at, late)
    return a.join(b, (F.col("__key") == F.col(key)) & (F.col(r_at) >= F.col(l_at)) & (F.col(r_at) <= F.col(l_at) + F.expr(f"interval {within}"))).drop("__key")


def every_minute(stream: DataFrame, tick: Callable[[DataFrame, int], None], checkpoint: str, minutes: int = 1) -> StreamingQuery:
    """``tick`` on what came in, every so many minutes."""
    return stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{minutes} minutes").start()


def latest_by_key(stream: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, at, value): last value of each key so far, kept as state; a change comes out as it is met."""
    import pandas as pd

    def step(k, pdfs, state):
        best = state.get if state.exists else None
        changed = False
        for pdf in pdfs:
            top = pdf.sort_values(at).iloc[-1]
            if best is None or top[at].value > best[0]:
                best, changed = (top[at].value, float(top[value])), True
        if changed:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], at: [pd.Timestamp(best[0])], value: [best[1]]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, at, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} timestamp, {value} double", "at bigint, value double", "update", "NoTimeout")
