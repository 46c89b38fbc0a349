"""Where rows go: content-addressed tables, caches, logs and job envelopes. All are idempotent or append-only."""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mentia.operators.dedupe import first_wins

LOG = logging.getLogger("mentia")
SCHEMA_VERSION, CACHE_SECONDS = 1, 600


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def put_absent(rows: DataFrame, path: str, keys: list[str], order: list[Column]) -> DataFrame:
    """Append the first row of each key that the table at ``path`` doesn't have, and return what was appended.

    A batch is written under a name of its own, so that a run that is lost leaves nothing half-written in the table.
    """
    spark = rows.sparkSession
    new = first_wins(rows, [F.col(k) for k in keys], order)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    new.write.parquet(draft)
    written = spark.read.parquet(draft)
    written.write.mode("append").parquet(path)
    return written


def cached(cache: DataFrame, now: Column, at: str = "fetched_at", seconds: int = CACHE_SECONDS) -> DataFrame:
    """Rows of a cache that are still fresh."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return cache.filter((age >= 0) & (age < seconds * 1_000_000))


def envelope(rows: DataFrame, payload: list[str], priority: Column, now: Column, keep: tuple[str, ...] = ("tenant_id", "monitor_id")) -> DataFrame:
    """Jobs of rows: a queue's columns and the payload as JSON. The job id follows from the payload, so that a row sent again is the same job."""
    body = F.to_json(F.struct(*payload))
    ident = F.sha2(F.concat_ws("\x1f", *keep, body), 256)
    return rows.select(F.lit(SCHEMA_VERSION).alias("schema_version"), ident.alias("job_id"), F.substring(ident, 1, 16).alias("trace_id"), *keep, priority.alias("priority"), now.alias("created_at"), F.lit(0).alias("attempt"), body.alias("payload"))


def append(rows: DataFrame, path: str, at: str = "created_at") -> None:
    """Append to a log, by day."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def log_line(event: str, **fields) -> str:
    """One line of JSON for the process's own log."""
    line = json.dumps({"event": event, **fields}, ensure_ascii=False, default=str, sort_keys=True)
    LOG.info(line)
    return line
