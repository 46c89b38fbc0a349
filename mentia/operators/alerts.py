"""Alerts: the decision, what is sent where, and what became of it, all as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mentia.functions import scoring as S
from mentia.functions.hashing import idempotency_key
from mentia.functions.text import escape_html

# What states, deliveries and feedback can be.
STATES = ("pending", "sent", "acknowledged", "resolved", "failed")
DELIVERY = ("pending", "sent", "failed", "skipped")
FEEDBACK = ("relevant", "not_relevant", "wrong_sentiment", "resolved", "flagged")
BANDS = ("critical", "high", "medium", "low")


def decide(analysed: DataFrame) -> DataFrame:
    """Alerts of analysed mentions: alert_type, band, priority, dedupe_key and the reason to show.

    Rows have monitor_id, content_id, cluster_id, sentiment, severity, members and reason. A negative mention from 60
    on alerts by itself, otherwise its story does where it is material (at no virality). A story without a cluster
    goes by its content. Null reasons stay null.
    """
    own = F.coalesce((F.col("sentiment") == "negative") & (F.col("severity") >= 60), F.lit(False))
    material = F.coalesce(S.cluster_gate(F.col("severity"), F.lit(0), F.col("members")), F.lit(False))
    kind = F.when(own, "negative_mention").otherwise("cluster_virality")
    of = F.when(own, F.col("content_id")).otherwise(F.coalesce("cluster_id", "content_id"))
    version = F.when(own, F.lit("negative-v1")).otherwise("cluster-v1")
    told = F.when(own, F.col("reason")).otherwise(F.format_string("Cluster growth alert (%d related mentions)", "members"))
    rows = analysed.filter(own | material)
    return rows.withColumns(
        {
            "alert_type": kind,
            "band": S.band(F.col("severity")),
            "priority": F.when(F.col("severity") >= 76, "emergency").otherwise("priority"),
            "dedupe_key": idempotency_key(F.col("monitor_id"), of, version),
            "alert_reason": told,
        }
    )


def message(band: Column, title: Column, reason: Column, url: Column) -> Column:
    """Body of a notification, its parts escaped; missing parts are empty."""
    part = lambda c: escape_html(F.coalesce(c, F.lit("")))
    return F.concat(F.lit("<b>"), F.upper(part(band)), F.lit("</b> "), part(title), F.lit("\n"), part(reason), F.lit("\n"), part(url))


def channel_actions(plans: DataFrame, receipts: DataFrame, keys: list[str]) -> DataFrame:
    """``plans`` (keys, channel, configured) with ``action`` and ``why``: what was sent once is skipped, then what isn't configured.

    ``receipts`` has (keys, channel, status), any number of each.
    """
    on = [*keys, "channel"]
    sent = receipts.filter("status = 'sent'").select(*on).distinct().withColumn("__sent", F.lit(True))
    rows = plans.join(sent, on, "left")
    why = F.when(F.col("__sent"), "already_sent").when(~F.coalesce("configured", F.lit(False)), "not_configured")
    return rows.withColumns({"why": why, "action": F.when(why.isNull(), "send").otherwise("skip")}).drop("__sent")


def outcomes(plans: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, configured, sent, failed, skipped, state, why) of every alert of ``plans``.

    Only results of configured channels count, except that without any all skipped ones are none either. One
    channel that was sent makes the alert sent.
    """
    on = [*keys, "channel"]
    configured = plans.filter("configured").select(*on).distinct()
    counted = results.join(configured, on, "left_semi").groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("sent", "failed", "skipped")))
    planned = plans.groupBy(*keys).agg(F.count_distinct(F.when(F.col("configured"), F.col("channel"))).alias("configured"))
    rows = planned.join(counted, keys, "left").fillna(0, ["sent", "failed", "skipped"])
    why = F.when(F.col("configured") == 0, "no_channels_configured").when(F.col("sent") > 0, "at_least_one_channel_sent").otherwise("all_configured_channels_failed")
    return rows.withColumns({"why": why, "state": F.when((F.col("configured") > 0) & (F.col("sent") > 0), "sent").otherwise("failed")})


def states(events: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """(key, state, sent_at, acknowledged_at, resolved_at) after all ``events`` (key, state, at): last state, first times.

    Events of unknown states are refused. ``order`` settles ties.
    """
    known = events.filter(F.col("state").isin(*STATES))
    first = lambda s: F.min(F.when(F.col("state") == s, F.col(at))).alias(f"{s}_at")
    return known.groupBy(key).agg(F.max_by("state", F.struct(at, order)).alias("state"), first("sent"), first("acknowledged"), first("resolved"))


def attempts(log: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """(keys, status, attempt) after a log of upserts (keys, status, given attempt or null), in order of ``at``.

    The first upsert counts 1 or what it gives, a later one what it gives, or one more unless it is pending.
    """
    allowed = log.filter(F.col("status").isin(*DELIVERY))
    order = Window.partitionBy(*keys).orderBy(*at)
    rows = allowed.withColumns({"__n": F.row_number().over(order), "__given": F.greatest(F.lit(1), F.col("attempt"))})
    rows = rows.withColumn("__given", F.when(F.col("attempt").isNotNull(), F.col("__given")).when(F.col("__n") == 1, 1))
    # counting starts again at every given attempt
    rows = rows.withColumn("__part", F.count("__given").over(order))
    step = F.when(F.col("__given").isNull() & (F.col("status") != "pending"), 1).otherwise(0)
    rows = rows.groupBy(*keys, "__part").agg(F.max("__given").alias("__base"), F.sum(step).alias("__more"), F.max_by("status", "__n").alias("status"))
    return rows.groupBy(*keys).agg(F.max_by("status", "__part").alias("status"), F.max_by(F.col("__base") + F.col("__more"), "__part").cast("bigint").alias("attempt"))


def feedback(mentions: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """(key, status, relevant, not_relevant): mentions after feedback; ``resolved`` is for good, other actions are kept only.

    Actions that aren't allowed, and those on mentions that don't exist, are refused.
    """
    allowed = log.filter(F.col("action").isin(*FEEDBACK))
    n = lambda a: F.count_if(F.col("action") == a)
    by = allowed.groupBy(key).agg(n("relevant").alias("relevant"), n("not_relevant").alias("not_relevant"), n("resolved").alias("__resolved"))
    rows = mentions.join(by, key, "left").fillna(0, ["relevant", "not_relevant", "__resolved"])
    return rows.select(key, F.when(F.col("__resolved") > 0, "resolved").otherwise(F.col("status")).alias("status"), "relevant", "not_relevant")


def open_state(state: str | None) -> Column:
    """Filter on alert states: ``open`` and ``unresolved`` are all but resolved, a known state itself, others no filter."""
    if state in ("open", "unresolved"):
        return F.col("state") != "resolved"
    return F.col("state") == state if state in STATES else F.lit(True)


def precision(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, judged, precision): relevant among judged mentions, null where none was judged."""
    sums = rows.groupBy(*keys).agg(F.sum("relevant").alias("r"), F.sum(F.col("relevant") + F.col("not_relevant")).alias("judged"))
    return sums.select(*keys, "judged", F.when(F.col("judged") > 0, F.round(F.col("r") / F.col("judged"), 6)).alias("precision"))
