"""Queries of the alert chain over whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mentia.functions import scoring as S, text as T
from mentia.operators import alerts as A, dedupe as D
from mentia.plans.reference import _BAND_SQL, _BOOST_SQL, QUERIES, SQL, query
from mentia.sources.tables import table

__all__ = ["QUERIES", "SQL"]

#: Latest mentions of a monitor in which members of a story are counted.
STORY_LOOK_BACK = 50

_ANALYSED_CTE = f"""r AS (SELECT class_id, sum({_BOOST_SQL}) AS risk FROM (SELECT DISTINCT class_id, unnest(risk_categories) AS c FROM classifications) GROUP BY class_id),
k AS (SELECT * FROM (SELECT cand_id, monitor_id, content_id, story_cluster_id, relevance_score, title, canonical_url, row_number() OVER (PARTITION BY monitor_id ORDER BY received_at DESC NULLS LAST, cand_id DESC) AS place FROM ai_candidates)),
m AS (SELECT monitor_id, story_cluster_id, count(*) AS members FROM k WHERE place <= 50 GROUP BY ALL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY analyzed_at DESC NULLS LAST, class_id DESC) AS n FROM classifications) WHERE n = 1),
a AS (SELECT k.cand_id, k.monitor_id, k.content_id, k.story_cluster_id AS cluster_id, k.title, k.canonical_url, o.sentiment, o.reason, greatest(1, coalesce(m.members, 1)) AS members,
 CASE WHEN o.sentiment = 'negative' THEN CAST(floor(greatest(0, least(100, 25 + greatest(0, least(1, o.confidence)) * 25 + greatest(0, least(100, k.relevance_score)) / 100.0::DOUBLE * 10 + coalesce(r.risk, 0))) + 0.5) AS BIGINT) ELSE 0 END AS severity
 FROM k JOIN one o ON o.content_id = k.content_id LEFT JOIN r ON r.class_id = o.class_id LEFT JOIN m ON m.monitor_id IS NOT DISTINCT FROM k.monitor_id AND m.story_cluster_id IS NOT DISTINCT FROM k.story_cluster_id),
d AS (SELECT *, sentiment = 'negative' AND severity >= 60 AS own, severity >= 50 AND members >= 3 AND severity >= 60 AS story FROM a),
al AS (SELECT *, CASE WHEN own THEN 'negative_mention' ELSE 'cluster_virality' END AS alert_type, {_BAND_SQL} AS band, CASE WHEN severity >= 76 THEN 'emergency' ELSE 'priority' END AS priority,
 sha256(coalesce(monitor_id, '') || chr(31) || coalesce(CASE WHEN own THEN content_id ELSE coalesce(cluster_id, content_id) END, '') || chr(31) || CASE WHEN own THEN 'negative-v1' ELSE 'cluster-v1' END) AS dedupe_key,
 CASE WHEN own THEN reason ELSE 'Cluster growth alert (' || members || ' related mentions)' END AS alert_reason FROM d WHERE own OR story),
ins AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY cand_id) AS first_of FROM al) WHERE first_of = 1)"""


def analysed(spark: SparkSession, root: str) -> DataFrame:
    """Candidates with the last analysis of their content, its severity and the members of their story."""
    rows = table(spark, root, "ai_candidates").select("cand_id", "monitor_id", "content_id", "story_cluster_id", "relevance_score", "title", "canonical_url", "received_at")
    recent = D.top_per(rows, [F.col("monitor_id")], [F.col("received_at").desc_nulls_last(), F.desc("cand_id")], STORY_LOOK_BACK)
    members = recent.groupBy(F.col("monitor_id").alias("mm"), F.col("story_cluster_id").alias("mc")).agg(F.count("*").alias("members"))
    last = D.latest_wins(table(spark, root, "classifications"), [F.col("content_id")], [F.col("analyzed_at"), F.col("class_id")]).select("content_id", "sentiment", "confidence", "reason", "risk_categories")
    met = rows.join(last, "content_id").join(members, F.col("monitor_id").eqNullSafe(F.col("mm")) & F.col("story_cluster_id").eqNullSafe(F.col("mc")), "left")
    severity = S.severity(F.col("sentiment"), F.col("confidence"), F.col("relevance_score").cast("double"), F.col("risk_categories"))
    return met.select("cand_id", "monitor_id", "content_id", F.col("story_cluster_id").alias("cluster_id"), "title", "canonical_url", "sentiment", "reason", F.greatest(F.lit(1), F.coalesce("members", F.lit(1))).alias("members"), severity.alias("severity"))


def new_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Alerts to insert: the first of each key."""
    return D.first_wins(A.decide(analysed(spark, root)), [F.col("dedupe_key")], [F.col("cand_id")])


@query(f"WITH {_ANALYSED_CTE} SELECT cand_id, dedupe_key, alert_type, band, priority, severity, members, alert_reason FROM ins")
def alert_decisions(spark: SparkSession, root: str) -> DataFrame:
    """Alerts of analysed candidates, inserted once by key."""
    return new_alerts(spark, root).select("cand_id", "dedupe_key", "alert_type", "band", "priority", "severity", F.col("members").cast("bigint").alias("members"), "alert_reason")


@query(f"""WITH {_ANALYSED_CTE}, e AS (SELECT cand_id, upper(band) AS b, replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t, replace(replace(replace(coalesce(alert_reason, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS r, replace(replace(replace(coalesce(canonical_url, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS u FROM ins)
SELECT cand_id, '<b>' || b || '</b> ' || t || chr(10) || r || chr(10) || u AS body FROM e""")
def notifications(spark: SparkSession, root: str) -> DataFrame:
    """What is sent for each new alert."""
    return new_alerts(spark, root).select("cand_id", A.message(F.col("band"), F.col("title"), F.col("alert_reason"), F.col("canonical_url")).alias("body"))


# the log of deliveries that the tables hold: one row a message, channels and results by its number
_LOG_CTE = """log AS (SELECT alert_id, message_id, received_at, CASE message_id % 2 WHEN 0 THEN 'email' ELSE 'chat' END AS channel, CASE (message_id // 2) % 5 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'pending' ELSE 'lost' END AS status, CASE WHEN message_id % 7 = 0 THEN attempt END AS attempt FROM alert_messages WHERE alert_id IS NOT NULL AND trim(alert_id) <> ''),
plan AS (SELECT a.alert_id, c.channel, CASE c.channel WHEN 'email' THEN a.tenant ELSE a.critical END AS configured FROM (SELECT alert_id, bool_or(tenant_id IS NOT NULL) AS tenant, bool_or(severity = 'critical') AS critical FROM alert_messages WHERE alert_id IS NOT NULL AND trim(alert_id) <> '' GROUP BY alert_id) a CROSS JOIN (SELECT unnest(['email', 'chat']) AS channel) c)"""


def delivery_log(spark: SparkSession, root: str) -> DataFrame:
    """(alert_id, message_id, received_at, channel, status, attempt) of every delivery; odd messages go to the chat."""
    m = F.col("message_id")
    kinds = F.element_at(F.array(*map(F.lit, ("sent", "failed", "skipped", "pending", "lost"))), (F.floor(m / 2) % 5 + 1).cast("int"))
    rows = table(spark, root, "alert_messages").filter("alert_id is not null and trim(alert_id) <> ''")
    return rows.select("alert_id", "message_id", "received_at", F.when(m % 2 == 0, "email").otherwise("chat").alias("channel"), kinds.alias("status"), F.when(m % 7 == 0, F.col("attempt")).alias("attempt"))


def channel_plans(spark: SparkSession, root: str) -> DataFrame:
    """(alert_id, channel, configured): e-mail where a tenant is known, the chat for critical alerts."""
    rows = table(spark, root, "alert_messages").filter("alert_id is not null and trim(alert_id) <> ''")
    by = rows.groupBy("alert_id").agg(F.bool_or(F.col("tenant_id").isNotNull()).alias("tenant"), F.bool_or(F.col("severity") == "critical").alias("critical"))
    return by.select("alert_id", F.inline(F.array(F.struct(F.lit("email").alias("channel"), F.col("tenant").alias("configured")), F.struct(F.lit("chat").alias("channel"), F.col("critical").alias("configured")))))


@query(f"""WITH {_LOG_CTE}, s AS (SELECT DISTINCT alert_id, channel FROM log WHERE status = 'sent'),
w AS (SELECT p.alert_id, p.channel, CASE WHEN s.alert_id IS NOT NULL THEN 'already_sent' WHEN NOT coalesce(p.configured, false) THEN 'not_configured' END AS why FROM plan p LEFT JOIN s ON s.alert_id = p.alert_id AND s.channel = p.channel)
SELECT alert_id, channel, why, CASE WHEN why IS NULL THEN 'send' ELSE 'skip' END AS action FROM w""")
def channel_actions(spark: SparkSession, root: str) -> DataFrame:
    """What to do for each alert and channel."""
    return A.channel_actions(channel_plans(spark, root), delivery_log(spark, root), ["alert_id"]).select("alert_id", "channel", "why", "action")


@query(f"""WITH {_LOG_CTE}, n AS (SELECT l.alert_id, count(*) FILTER (status = 'sent') AS sent, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM log l WHERE EXISTS (SELECT 1 FROM plan p WHERE p.alert_id = l.alert_id AND p.channel = l.channel AND p.configured) GROUP BY l.alert_id),
c AS (SELECT alert_id, count(DISTINCT CASE WHEN configured THEN channel END) AS configured FROM plan GROUP BY alert_id)
SELECT c.alert_id, c.configured, coalesce(sent, 0) AS sent, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped, CASE WHEN configured = 0 THEN 'no_channels_configured' WHEN coalesce(sent, 0) > 0 THEN 'at_least_one_channel_sent' ELSE 'all_configured_channels_failed' END AS why, CASE WHEN configured > 0 AND coalesce(sent, 0) > 0 THEN 'sent' ELSE 'failed' END AS state FROM c LEFT JOIN n ON n.alert_id = c.alert_id""")
def delivery_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Outcome of each alert over its configured channels."""
    return A.outcomes(channel_plans(spark, root), delivery_log(spark, root), ["alert_id"])


@query(f"""WITH {_LOG_CTE}, o AS (SELECT *, row_number() OVER w AS n FROM log WHERE status <> 'lost' WINDOW w AS (PARTITION BY alert_id, channel ORDER BY received_at, message_id)),
g AS (SELECT *, CASE WHEN attempt IS NOT NULL THEN greatest(1, attempt) WHEN n = 1 THEN 1 END AS given FROM o),
p AS (SELECT *, count(given) OVER (PARTITION BY alert_id, channel ORDER BY n) AS part FROM g),
x AS (SELECT alert_id, channel, part, max(given) AS base, count(*) FILTER (given IS NULL AND status <> 'pending') AS more, arg_max(status, n) AS status FROM p GROUP BY ALL)
SELECT alert_id, channel, arg_max(status, part) AS status, CAST(arg_max(base + more, part) AS BIGINT) AS attempt FROM x GROUP BY alert_id, channel""")
def delivery_attempts(spark: SparkSession, root: str) -> DataFrame:
    """Last status and number of attempts of each delivery."""
    return A.attempts(delivery_log(spark, root), ["alert_id", "channel"], ["received_at", "message_id"])


_EVENTS_CTE = """ev AS (SELECT alert_id, message_id, received_at AS done, CASE message_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'sent' WHEN 2 THEN 'acknowledged' WHEN 3 THEN 'resolved' WHEN 4 THEN 'failed' ELSE 'unknown' END AS state FROM alert_messages WHERE alert_id IS NOT NULL AND trim(alert_id) <> '' AND received_at IS NOT NULL),
st AS (SELECT alert_id, arg_max(state, (done, message_id)) AS state, min(done) FILTER (state = 'sent') AS sent_at, min(done) FILTER (state = 'acknowledged') AS acknowledged_at, min(done) FILTER (state = 'resolved') AS resolved_at FROM ev WHERE state <> 'unknown' GROUP BY alert_id)"""


def alert_states_of(spark: SparkSession, root: str) -> DataFrame:
    m = F.col("message_id")
    kinds = F.element_at(F.array(*map(F.lit, (*A.STATES, "unknown"))), (F.element_at(F.array(*map(F.lit, (1, 2, 3, 4, 5, 6))), (m % 6 + 1).cast("int"))))
    events = table(spark, root, "alert_messages").filter("alert_id is not null and trim(alert_id) <> '' and received_at is not null").select("alert_id", "message_id", F.col("received_at").alias("at"), kinds.alias("state"))
    return A.states(events, "alert_id", "at", "message_id")


@query(f"WITH {_EVENTS_CTE} SELECT alert_id, state, CAST(epoch_us(sent_at) AS BIGINT) AS sent_us, CAST(epoch_us(acknowledged_at) AS BIGINT) AS acknowledged_us, CAST(epoch_us(resolved_at) AS BIGINT) AS resolved_us FROM st")
def alert_states(spark: SparkSession, root: str) -> DataFrame:
    """Last state and first times of each alert."""
    us = lambda c: F.unix_micros(F.col(f"{c}_at").cast("timestamp")).alias(f"{c}_us")
    return alert_states_of(spark, root).select("alert_id", "state", us("sent"), us("acknowledged"), us("resolved"))


_FIRST_URL_CTE = "u AS (SELECT * FROM (SELECT canonical_url, title, source, ingested_at AS discovered_at, published_at, row_number() OVER (PARTITION BY canonical_url ORDER BY norm_id) AS k FROM normalized_content WHERE canonical_url IS NOT NULL) WHERE k = 1)"


def alert_rows(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries of alerts with their state and, nested, the mention they are about, null where it isn't stored."""
    mention = D.first_wins(table(spark, root, "normalized_content").filter("canonical_url is not null"), [F.col("canonical_url")], [F.col("norm_id")])
    mention = mention.select("canonical_url", F.struct("title", "source", F.col("ingested_at").alias("discovered_at"), "published_at").alias("mention"))
    rows = table(spark, root, "alert_messages").select("message_id", "alert_id", "canonical_url", "severity", "severity_score", "created_at")
    return rows.join(alert_states_of(spark, root).select("alert_id", "state"), "alert_id", "left").join(mention, "canonical_url", "left")


@query(f"""WITH {_EVENTS_CTE}, {_FIRST_URL_CTE} SELECT a.message_id, a.severity, st.state, u.title AS mention_title, u.canonical_url IS NOT NULL AS has_mention FROM alert_messages a LEFT JOIN st ON st.alert_id = a.alert_id LEFT JOIN u ON u.canonical_url = a.canonical_url
WHERE a.created_at >= TIMESTAMP '2024-01-15' AND a.created_at <= TIMESTAMP '2025-12-31 23:59:59.999' AND coalesce(a.severity_score, 0) >= 60 AND st.state <> 'resolved' ORDER BY coalesce(u.discovered_at, a.created_at) DESC, a.created_at DESC, a.message_id LIMIT 100""")
def open_alerts(spark: SparkSession, root: str) -> DataFrame:
    """The latest hundred open alerts of a span: a top-k report."""
    at = lambda x: F.lit(x).cast("timestamp")
    rows = alert_rows(spark, root).filter(F.col("created_at").between(at("2024-01-15"), at("2025-12-31 23:59:59.999"))).filter(F.coalesce("severity_score", F.lit(0.0)) >= 60).filter(A.open_state("open"))
    rows = rows.orderBy(F.coalesce("mention.discovered_at", "created_at").desc(), F.desc("created_at"), "message_id").limit(100)
    return rows.select("message_id", "severity", "state", F.col("mention.title").alias("mention_title"), F.col("mention").isNotNull().alias("has_mention"))


_OWN_SQL = r"CASE WHEN regexp_matches(u.published_at, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$') THEN try_cast(replace(replace(u.published_at, 'T', ' '), 'Z', '') AS TIMESTAMP) END"


@query(f"""WITH {_EVENTS_CTE}, {_FIRST_URL_CTE}, t AS (SELECT a.message_id, a.created_at, coalesce({_OWN_SQL}, u.discovered_at, a.created_at) AS happened FROM alert_messages a LEFT JOIN u ON u.canonical_url = a.canonical_url)
SELECT message_id, CAST(epoch_us(happened) AS BIGINT) AS event_us FROM t WHERE happened IS NULL OR (happened >= TIMESTAMP '2024-06-01' AND happened <= TIMESTAMP '2025-06-30 23:59:59.999') ORDER BY happened DESC NULLS FIRST, message_id LIMIT 200""")
def alerts_by_publication(spark: SparkSession, root: str) -> DataFrame:
    """The latest two hundred alerts of a span by the time of their event; those without a time stay: a top-k report."""
    own = F.when(F.col("mention.published_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"), F.try_to_timestamp("mention.published_at"))
    at = F.coalesce(own, F.col("mention.discovered_at").cast("timestamp"), F.col("created_at").cast("timestamp"))
    bound = lambda x: F.lit(x).cast("timestamp")
    rows = alert_rows(spark, root).select("message_id", at.alias("at")).filter(F.col("at").isNull() | F.col("at").between(bound("2024-06-01"), bound("2025-06-30 23:59:59.999")))
    return rows.orderBy(F.col("at").desc_nulls_first(), "message_id").limit(200).select("message_id", F.unix_micros("at").alias("event_us"))


_FEEDBACK_CTE = """fb AS (SELECT norm_id, CASE class_id % 7 WHEN 0 THEN 'relevant' WHEN 1 THEN 'not_relevant' WHEN 2 THEN 'wrong_sentiment' WHEN 3 THEN 'resolved' WHEN 4 THEN 'flagged' WHEN 5 THEN 'relevant' ELSE 'liked' END AS action FROM classifications),
f AS (SELECT norm_id, count(*) FILTER (action = 'relevant') AS relevant, count(*) FILTER (action = 'not_relevant') AS not_relevant, count(*) FILTER (action = 'resolved') AS resolved FROM fb WHERE action <> 'liked' GROUP BY norm_id),
fm AS (SELECT n.norm_id, n.source, CASE WHEN coalesce(resolved, 0) > 0 THEN 'resolved' ELSE 'new' END AS status, coalesce(relevant, 0) AS relevant, coalesce(not_relevant, 0) AS not_relevant FROM normalized_content n LEFT JOIN f ON f.norm_id = n.norm_id)"""


def judged(spark: SparkSession, root: str) -> DataFrame:
    actions = F.element_at(F.array(*map(F.lit, ("relevant", "not_relevant", "wrong_sentiment", "resolved", "flagged", "relevant", "liked"))), (F.col("class_id") % 7 + 1).cast("int"))
    log = table(spark, root, "classifications").select("norm_id", actions.alias("action"))
    return A.feedback(table(spark, root, "normalized_content").select("norm_id", F.lit("new").alias("status")), log, "norm_id")


@query(f"WITH {_FEEDBACK_CTE} SELECT norm_id, status, relevant, not_relevant FROM fm")
def feedback_states(spark: SparkSession, root: str) -> DataFrame:
    """Mentions after feedback."""
    return judged(spark, root)


@query(f"WITH {_FEEDBACK_CTE} SELECT source, CAST(sum(relevant + not_relevant) AS BIGINT) AS judged, CASE WHEN sum(relevant + not_relevant) > 0 THEN round(sum(relevant) / sum(relevant + not_relevant)::DOUBLE, 6) END AS precision FROM fm GROUP BY source")
def source_precision(spark: SparkSession, root: str) -> DataFrame:
    """Share of relevant mentions among judged ones, by source."""
    return A.precision(judged(spark, root).join(table(spark, root, "normalized_content").select("norm_id", "source"), "norm_id"), ["source"])


@query(f"""WITH {_EVENTS_CTE}, a AS (SELECT x.tenant_id, count(DISTINCT x.alert_id) FILTER (st.state <> 'resolved') AS open_alerts FROM alert_messages x JOIN st ON st.alert_id = x.alert_id GROUP BY x.tenant_id),
c AS (SELECT m.tenant_id, count(*) AS mentions, count(*) FILTER (o.sentiment = 'negative') AS negatives FROM ai_candidates k JOIN monitors m ON m.monitor_id = k.monitor_id LEFT JOIN (SELECT * FROM (SELECT content_id, sentiment, row_number() OVER (PARTITION BY content_id ORDER BY analyzed_at DESC NULLS LAST, class_id DESC) AS n FROM classifications) WHERE n = 1) o ON o.content_id = k.content_id GROUP BY m.tenant_id)
SELECT m.tenant_id, count(*) AS monitors, count(*) FILTER (m.status <> 'archived') AS active, coalesce(max(c.mentions), 0) AS mentions, coalesce(max(c.negatives), 0) AS negatives, coalesce(max(a.open_alerts), 0) AS open_alerts FROM monitors m LEFT JOIN c ON c.tenant_id = m.tenant_id LEFT JOIN a ON a.tenant_id = m.tenant_id WHERE m.tenant_id IS NOT NULL GROUP BY m.tenant_id""")
def workspace_totals(spark: SparkSession, root: str) -> DataFrame:
    """Monitors, mentions, negatives and open alerts of each tenant."""
    monitors = table(spark, root, "monitors")
    last = D.latest_wins(table(spark, root, "classifications"), [F.col("content_id")], [F.col("analyzed_at"), F.col("class_id")]).select("content_id", "sentiment")
    counts = table(spark, root, "ai_candidates").select("monitor_id", "content_id").join(last, "content_id", "left").groupBy("monitor_id").agg(F.count("*").alias("mentions"), F.count_if(F.col("sentiment") == "negative").alias("negatives"))
    by_tenant = counts.join(monitors.select("monitor_id", "tenant_id"), "monitor_id").groupBy("tenant_id").agg(F.sum("mentions").alias("mentions"), F.sum("negatives").alias("negatives"))
    open_rows = table(spark, root, "alert_messages").select("alert_id", "tenant_id").join(alert_states_of(spark, root).filter("state <> 'resolved'").select("alert_id"), "alert_id").groupBy("tenant_id").agg(F.count_distinct("alert_id").alias("open_alerts"))
    base = monitors.filter("tenant_id is not null").groupBy("tenant_id").agg(F.count("*").alias("monitors"), F.count_if(F.col("status") != "archived").alias("active"))
    return base.join(by_tenant, "tenant_id", "left").join(open_rows, "tenant_id", "left").fillna(0, ["mentions", "negatives", "open_alerts"])


@query("""SELECT a.message_id FROM alert_messages a WHERE EXISTS (SELECT 1 FROM monitors m WHERE m.tenant_id = a.tenant_id AND m.monitor_id = a.monitor_id AND m.status <> 'archived')""")
def member_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Alerts of monitors that belong to the tenant they name."""
    members = table(spark, root, "monitors").filter("status <> 'archived'").select("tenant_id", "monitor_id")
    return table(spark, root, "alert_messages").join(members, ["tenant_id", "monitor_id"], "left_semi").select("message_id")


@query(r"""SELECT message_id, CASE WHEN h IS NOT NULL THEN CAST(greatest(1, ceil(h / 1000.0)) AS BIGINT) END AS wait_s FROM (SELECT message_id, CASE WHEN message_id % 3 < 2 THEN (message_id * 37) % 9000 END AS h FROM alert_messages)""")
def retry_hints(spark: SparkSession, root: str) -> DataFrame:
    """Seconds to wait that an error text tells of, null where it tells of none."""
    m = F.col("message_id")
    error = F.concat(F.when(m % 3 == 0, "browser_pool_busy:").when(m % 3 == 1, "failed: domain_busy:").otherwise("busy:"), (m * 37 % 9000).cast("string"))
    return table(spark, root, "alert_messages").select("message_id", T.delay_hint(error).alias("wait_s"))
