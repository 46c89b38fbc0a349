"""Queries of the general data problems: p1 and p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mentia.operators.deliveries import SeenStore, surplus
from mentia.operators.instants import normalize_instants
from mentia.session import scratch
from mentia.sources.tables import table

#: (table, id, time of arrival) of the tables whose published_at is normalised.
DATED = [("discoveries", "discovery_id", "discovered_at"), ("crawl_jobs", "message_id", "created_at")]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """record_table, record_id, utc_us of every published_at that denotes an instant in another form than the own one."""
    zones, out = table(spark, root, "feed_zones"), None
    for name, key, arrival in DATED:
        found = normalize_instants(table(spark, root, name), zones, arrival=arrival, key=key).filter("status = 'resolved'").select(F.lit(name).alias("record_table"), F.col(key).alias("record_id"), "utc_us")
        out = found if out is None else out.unionByName(found)
    return out


def p1_status(spark: SparkSession, root: str) -> DataFrame:
    """Rows by table, notation and outcome, unresolved ambiguity included."""
    zones, out = table(spark, root, "feed_zones"), None
    for name, key, arrival in DATED:
        found = normalize_instants(table(spark, root, name), zones, arrival=arrival, key=key).select(F.lit(name).alias("record_table"), "interpretation", "status")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("record_table", "interpretation", "status").agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """record_table, message_id of the surplus deliveries of crawl jobs and alerts."""
    batch = None
    for name, ident in (("crawl_jobs", "job_id"), ("alert_messages", "alert_id")):
        rows = table(spark, root, name).select(F.lit(name).alias("name"), F.col(ident).alias("ident"), "received_at", "message_id")
        batch = rows if batch is None else batch.unionByName(rows)
    store = SeenStore(spark, scratch(spark, "seen"))
    return surplus(batch, store).select(F.col("name").alias("record_table"), "message_id")


P6_SQL = r"""
WITH a AS (
  SELECT 'crawl_jobs' AS record_table, job_id AS i, received_at, message_id FROM crawl_jobs
  UNION ALL SELECT 'alert_messages', alert_id, received_at, message_id FROM alert_messages),
b AS (SELECT *, regexp_replace(regexp_replace(lower(i), '[\s\x{a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}{}()]', '', 'g'), '^(?:urn:)?(?:uuid:)?', '') AS bare FROM a WHERE i IS NOT NULL),
k AS (SELECT *, CASE WHEN regexp_matches(replace(bare, '-', ''), '^[0-9a-f]{32}$') THEN replace(bare, '-', '') ELSE bare END AS k FROM b)
SELECT record_table, message_id FROM (
  SELECT *, row_number() OVER (PARTITION BY record_table, k ORDER BY received_at, message_id) AS n FROM k WHERE k <> '') WHERE n > 1
"""
