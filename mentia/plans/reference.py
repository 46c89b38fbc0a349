"""Queries of the monitoring pipeline over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mentia.boolean import matching_many, matching_queries, parse
from mentia.boolean.language import Group, Node, Not, Term
from mentia.functions import hashing as H, scoring as S, text as T, urls as U
from mentia.operators import dedupe as D, timely as O
from mentia.session import cut
from mentia.sources import feeds
from mentia.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2025-06-30 12:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ordered(c: str) -> Column:
    return F.col(c).asc_nulls_first()


# ------------------------------------------------------------------ the Boolean language

ASKED = [
    ("refund", "refund OR hoàn"),
    ("leak", '"data leak" AND NOT petition'),
    ("queues", '("long queues" OR "xếp hàng") reseller'),
    ("nested", "NOT (the OR und OR les) AND (pin OR batería OR Akku)"),
]


def to_sql(node: Node, text: str) -> str:
    """The SQL predicate of a tree, for the comparison."""
    if isinstance(node, Term):
        return f"contains({text}, '{node.value.lower()}')"
    if isinstance(node, Not):
        return f"NOT ({to_sql(node.child, text)})"
    assert isinstance(node, Group)
    return "(" + f" {node.kind.upper()} ".join(to_sql(c, text) for c in node.children) + ")"


@query(" UNION ALL ".join(f"SELECT norm_id, '{i}' AS query_id FROM normalized_content WHERE {to_sql(parse(q), 'lower(coalesce(title, chr(32)) || chr(10) || coalesce(text, chr(32)))')}" for i, q in ASKED))
def query_matches(spark: SparkSession, root: str) -> DataFrame:
    """Texts and the Boolean queries that they match, in one scan."""
    both = F.concat(F.coalesce("title", F.lit(" ")), F.lit("\n"), F.coalesce("text", F.lit(" ")))
    found = matching_queries(table(spark, root, "normalized_content").select("norm_id", both.alias("both")), T.norm_text(F.col("both")), ASKED)
    return found.select("norm_id", F.explode("matched").alias("query_id"))


@query(r"""WITH t AS (SELECT norm_id, lower(coalesce(title, ' ') || chr(10) || coalesce(text, ' ')) AS t FROM normalized_content),
q AS (SELECT monitor_id, regexp_extract(lower(raw_query), '^"?([^" ]+)"?', 1) AS a, regexp_extract(lower(raw_query), '" or (\S+)$', 1) AS b, contains(raw_query, '(refund OR outage)') AS risky, regexp_extract(lower(raw_query), 'and not "([^"]+)"$', 1) AS n FROM monitors WHERE raw_query IS NOT NULL)
SELECT t.norm_id, q.monitor_id FROM t JOIN q ON (contains(t.t, q.a) OR q.b <> '' AND contains(t.t, q.b)) AND (NOT q.risky OR contains(t.t, 'refund') OR contains(t.t, 'outage')) AND (q.n = '' OR NOT contains(t.t, q.n))""")
def monitor_matches(spark: SparkSession, root: str) -> DataFrame:
    """Texts that match each monitor's own query, by one automaton over the terms of all."""
    both = F.concat(F.coalesce("title", F.lit(" ")), F.lit("\n"), F.coalesce("text", F.lit(" ")))
    return matching_many(table(spark, root, "normalized_content"), "norm_id", T.norm_text(both), table(spark, root, "monitors").select("monitor_id", "raw_query"), "monitor_id", "raw_query")


# ------------------------------------------------------------------ scores


def _instr_sum(terms: list[str], low: str) -> str:
    return "(" + " + ".join(f"CAST(contains({low}, '{t}') AS INT)" for t in terms) + ")"


def _any(terms: list[str], low: str) -> str:
    return "(" + " OR ".join(f"contains({low}, '{t}')" for t in terms) + ")"


@query(f"""WITH t AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, {_instr_sum(S.NEGATIVE_TERMS, 'low')} AS n, {_instr_sum(S.POSITIVE_TERMS, 'low')} AS p,
 array_to_string(list_filter([{', '.join(f"CASE WHEN {_any(w, 'low')} THEN '{k}' END" for k, w in S.RISK_TERMS.items())}], lambda x: x IS NOT NULL), ',') AS risks FROM t)
SELECT doc_id, CASE WHEN n > p THEN 'negative' WHEN p > n THEN 'positive' ELSE 'neutral' END AS sentiment, CASE WHEN n = p THEN 0.45 ELSE 0.62 END::DOUBLE AS confidence, coalesce(risks, '') AS risks FROM s""")
def fallback_sentiment(spark: SparkSession, root: str) -> DataFrame:
    """Sentiment, confidence and risks of every document by the lexical classifier."""
    low = table(spark, root, "documents").filter("text is not null").select("doc_id", F.lower("text").alias("low"))
    rows = low.select("doc_id", S.fallback_sentiment(F.col("low")).alias("sentiment"), F.array_join(S.risk_categories(F.col("low")), ",").alias("risks"))
    return rows.select("doc_id", "sentiment", S.fallback_confidence(F.col("sentiment")).cast("double").alias("confidence"), "risks")


_BOOST_SQL = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.RISK_BOOSTS.items()) + " ELSE 0 END"
_BAND_SQL = "CASE WHEN severity >= 76 THEN 'critical' WHEN severity >= 51 THEN 'high' WHEN severity >= 26 THEN 'medium' ELSE 'low' END"
_SEVERITY_CTE = f"""r AS (SELECT class_id, sum({_BOOST_SQL}) AS risk FROM (SELECT DISTINCT class_id, unnest(risk_categories) AS c FROM classifications) GROUP BY class_id),
sev AS (SELECT c.*, CASE WHEN sentiment = 'negative' THEN CAST(floor(greatest(0, least(100, 25 + greatest(0, least(1, confidence)) * 25 + 90 / 100.0::DOUBLE * 10 + coalesce(risk, 0))) + 0.5) AS BIGINT) ELSE 0 END AS severity
 FROM classifications c LEFT JOIN r ON r.class_id = c.class_id)"""


def classified(spark: SparkSession, root: str) -> DataFrame:
    """Classifications with their severity at a relevance of 90."""
    rows = table(spark, root, "classifications")
    return rows.withColumn("severity", S.severity(F.col("sentiment"), F.col("confidence"), F.lit(90.0), F.col("risk_categories")))


@query(f"WITH {_SEVERITY_CTE} SELECT class_id, severity, {_BAND_SQL} AS band FROM sev")
def severity_scores(spark: SparkSession, root: str) -> DataFrame:
    return classified(spark, root).select("class_id", "severity", S.band(F.col("severity")).alias("band"))


@query(f"""WITH low AS (SELECT cand_id, monitor_name, priority, lower(coalesce(title, '') || chr(10) || coalesce(text, '')) AS low FROM (SELECT *, 'normal' AS priority FROM ai_candidates))
SELECT cand_id, CAST(least(100, 85 + CASE WHEN contains(low, lower(monitor_name)) THEN 10 ELSE 0 END + CASE WHEN {_instr_sum(['refund', 'reseller', 'hoàn'], 'low')} > 1 THEN 5 ELSE 0 END) AS BIGINT) AS relevance,
 CASE WHEN {_any(S.FAST_LANE_TERMS, 'low')} THEN 'priority' ELSE priority END AS lane FROM low""")
def relevance_and_lane(spark: SparkSession, root: str) -> DataFrame:
    """Relevance and queue of every candidate."""
    rows = table(spark, root, "ai_candidates").select("cand_id", "monitor_name", F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))).alias("low"))
    rows = matching_queries(rows, F.col("low"), [("a", "refund"), ("b", "reseller"), ("c", "hoàn")])
    return rows.select("cand_id", S.relevance(F.col("low"), F.col("monitor_name"), F.size("matched")).cast("bigint").alias("relevance"), S.fast_lane(F.col("low"), F.lit("normal")).alias("lane"))


@query("""WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS likes, count(*) FILTER (event_type = 'signup') AS comments, count(*) FILTER (event_type = 'purchase') AS shares, count(*) FILTER (event_type = 'view') AS views, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::DOUBLE AS age FROM events GROUP BY user_id)
SELECT user_id, CAST(floor(greatest(0, least(100, log10(1 + (likes + 3 * comments + 5 * shares + 0.05::DOUBLE * views) / greatest(1, age) * 60) / log10(2001) * 100)) + 0.5) AS BIGINT) AS virality FROM e""")
def virality_scores(spark: SparkSession, root: str) -> DataFrame:
    """Virality of every user's engagement."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    sums = table(spark, root, "events").groupBy("user_id").agg(n("click").alias("likes"), n("signup").alias("comments"), n("purchase").alias("shares"), n("view").alias("views"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60_000_000).alias("age"))
    return sums.select("user_id", S.virality(*map(F.col, ("likes", "comments", "shares", "views", "age"))).alias("virality"))


@query(f"""WITH {_SEVERITY_CTE}, m AS (SELECT content_id, count(*) AS members, max(severity) AS severity FROM sev GROUP BY content_id)
SELECT content_id, members, severity FROM m WHERE severity >= 50 AND ((members >= 3 AND severity >= 60) OR (members >= 2 AND severity >= 60 AND 40 >= 40))""")
def material_stories(spark: SparkSession, root: str) -> DataFrame:
    """Contents that pass the gate for stories at a virality of 40."""
    rows = classified(spark, root).groupBy("content_id").agg(F.count("*").alias("members"), F.max("severity").alias("severity"))
    return rows.filter(S.cluster_gate(F.col("severity"), F.lit(40), F.col("members")))


# ------------------------------------------------------------------ reads

_MENTION_CTE = f"""{_SEVERITY_CTE}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm_id ORDER BY analyzed_at DESC NULLS LAST, class_id DESC) AS k FROM sev) WHERE k = 1),
mentions AS (SELECT n.norm_id, n.content_id, n.canonical_url, n.source, n.title, n.ingested_at AS discovered_at, coalesce(l.sentiment, 'unknown') AS sentiment, coalesce(l.severity, 0) AS severity, l.topic FROM normalized_content n LEFT JOIN last l ON l.norm_id = n.norm_id)"""


def mentions(spark: SparkSession, root: str) -> DataFrame:
    """Contents with their latest analysis; unknown sentiment and severity 0 without one."""
    last = D.latest_wins(classified(spark, root), [F.col("norm_id")], [F.col("analyzed_at"), F.col("class_id")]).select("norm_id", F.col("sentiment").alias("s"), F.col("severity").alias("v"), "topic")
    rows = table(spark, root, "normalized_content").join(last, "norm_id", "left")
    return rows.select("norm_id", "content_id", "canonical_url", "source", "title", F.col("ingested_at").alias("discovered_at"), F.coalesce("s", F.lit("unknown")).alias("sentiment"), F.coalesce("v", F.lit(0)).cast("bigint").alias("severity"), "topic")


@query(f"WITH {_MENTION_CTE} SELECT norm_id, source, severity, CAST(epoch_us(discovered_at) AS BIGINT) AS discovered_us FROM mentions WHERE severity >= 40 AND sentiment = 'negative' AND discovered_at >= TIMESTAMP '2024-03-01' AND discovered_at <= TIMESTAMP '2025-10-31 23:59:59.999' ORDER BY discovered_at DESC, norm_id LIMIT 50")
def list_mentions(spark: SparkSession, root: str) -> DataFrame:
    """The latest fifty severe mentions of a span: a top-k report."""
    rows = mentions(spark, root).filter("severity >= 40 and sentiment = 'negative'").filter(F.col("discovered_at").between(F.lit("2024-03-01").cast("timestamp"), F.lit("2025-10-31 23:59:59.999").cast("timestamp")))
    return rows.orderBy(F.desc("discovered_at"), "norm_id").limit(50).select("norm_id", "source", "severity", F.unix_micros(F.col("discovered_at").cast("timestamp")).alias("discovered_us"))


@query("""SELECT a.message_id, a.severity, m.monitor_type, m.status FROM alert_messages a LEFT JOIN monitors m ON m.monitor_id = a.monitor_id
WHERE coalesce(a.severity_score, 0) >= 60 AND a.created_at >= TIMESTAMP '2024-06-01' AND a.severity IN ('high', 'critical')""")
def list_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Severe alerts with what is known of their monitor."""
    rows = table(spark, root, "alert_messages").filter(F.coalesce("severity_score", F.lit(0.0)) >= 60).filter(F.col("created_at") >= F.lit("2024-06-01").cast("timestamp")).filter(F.col("severity").isin("high", "critical"))
    return rows.join(table(spark, root, "monitors").select("monitor_id", "monitor_type", "status"), "monitor_id", "left").select("message_id", "severity", "monitor_type", "status")


@query("""SELECT alert_id, count(*) AS deliveries, array_to_string(list(CAST(message_id AS VARCHAR) ORDER BY received_at, message_id), ',') AS messages FROM alert_messages WHERE alert_id IS NOT NULL AND alert_id <> '' GROUP BY alert_id""")
def alert_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries nested by alert, in order of arrival."""
    rows = table(spark, root, "alert_messages").filter("alert_id <> ''").groupBy("alert_id").agg(F.count("*").alias("deliveries"), F.sort_array(F.collect_list(F.struct("received_at", "message_id"))).alias("m"))
    return rows.select("alert_id", "deliveries", F.array_join(F.transform("m", lambda s: s["message_id"].cast("string")), ",").alias("messages"))


@query("SELECT cand_id FROM ai_candidates a WHERE NOT EXISTS (SELECT 1 FROM normalized_content n WHERE n.content_id = a.content_id)")
def unknown_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Candidates whose content isn't stored yet."""
    return table(spark, root, "ai_candidates").join(table(spark, root, "normalized_content").select("content_id"), "content_id", "left_anti").select("cand_id")


@query(f"WITH {_MENTION_CTE} SELECT norm_id, topic, severity, sentiment FROM mentions WHERE severity > 0")
def mention_details(spark: SparkSession, root: str) -> DataFrame:
    """Mentions of any severity with their analysis."""
    return mentions(spark, root).filter("severity > 0").select("norm_id", "topic", "severity", "sentiment")


# ------------------------------------------------------------------ union, first and last wins, upserts


@query("""SELECT discovery_id, monitor_id, url FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id, lower(url) ORDER BY discovered_at NULLS FIRST, discovery_id) AS k FROM discoveries WHERE url IS NOT NULL) WHERE k = 1""")
def first_discoveries(spark: SparkSession, root: str) -> DataFrame:
    """The first discovery of each address by a monitor, case aside."""
    rows = table(spark, root, "discoveries").filter("url is not null")
    return D.first_wins(rows, [F.col("monitor_id"), F.lower("url")], [ordered("discovered_at"), F.col("discovery_id")]).select("discovery_id", "monitor_id", "url")


@query("""SELECT discovery_id FROM (SELECT discovery_id, row_number() OVER (PARTITION BY monitor_id, source ORDER BY discovered_at DESC NULLS LAST, discovery_id) AS k FROM discoveries) WHERE k <= 80""")
def capped_candidates(spark: SparkSession, root: str) -> DataFrame:
    """At most eighty candidates a monitor and source, the latest: the cap is the feature."""
    return D.top_per(table(spark, root, "discoveries"), [F.col("monitor_id"), F.col("source")], [F.col("discovered_at").desc_nulls_last(), F.col("discovery_id")], 80).select("discovery_id")


@query("""SELECT discovery_key, message_id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY discovery_key ORDER BY received_at DESC NULLS LAST, message_id DESC) AS k FROM crawl_jobs WHERE discovery_key IS NOT NULL) WHERE k = 1""")
def latest_jobs(spark: SparkSession, root: str) -> DataFrame:
    """The last delivered job of each discovery, as upserts leave it."""
    rows = table(spark, root, "crawl_jobs").filter("discovery_key is not null")
    return D.latest_wins(rows, [F.col("discovery_key")], [F.col("received_at"), F.col("message_id")]).select("discovery_key", "message_id", "attempt")


@query("""SELECT content_id, source, norm_id FROM (SELECT *, row_number() OVER (PARTITION BY content_id, source ORDER BY ingested_at NULLS FIRST, norm_id) AS k FROM normalized_content) n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM ai_candidates a WHERE a.content_id = n.content_id AND a.source = n.source)""")
def contents_to_insert(spark: SparkSession, root: str) -> DataFrame:
    """First rows of contents that the target doesn't have."""
    new = table(spark, root, "normalized_content").select("content_id", "source", "norm_id", "ingested_at")
    return D.insert_absent(new, table(spark, root, "ai_candidates"), ["content_id", "source"], [ordered("ingested_at"), F.col("norm_id")]).select("content_id", "source", "norm_id")


@query("""SELECT strftime(received_at, '%Y-%m') AS month, count(*) AS crawl_requests, count(DISTINCT discovery_key) AS discoveries, CAST(sum(attempt) AS BIGINT) AS retries FROM crawl_jobs WHERE received_at IS NOT NULL GROUP BY 1""")
def usage_monthly(spark: SparkSession, root: str) -> DataFrame:
    """Counters of each month."""
    rows = table(spark, root, "crawl_jobs").filter("received_at is not null")
    return rows.groupBy(F.date_format("received_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("crawl_requests"), F.countDistinct("discovery_key").alias("discoveries"), F.sum("attempt").cast("bigint").alias("retries"))


@query("""SELECT monitor_id, priority, CAST(epoch_us(min(created_at) FILTER (attempt = 0)) AS BIGINT) AS first_us, CAST(epoch_us(min(created_at) FILTER (attempt > 0)) AS BIGINT) AS retried_us FROM crawl_jobs GROUP BY ALL""")
def first_times(spark: SparkSession, root: str) -> DataFrame:
    """First time of each state, later ones ignored."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    return table(spark, root, "crawl_jobs").groupBy("monitor_id", "priority").agg(F.min(F.when(F.col("attempt") == 0, at)).alias("first_us"), F.min(F.when(F.col("attempt") > 0, at)).alias("retried_us"))


@query("""WITH u AS (SELECT 0 AS rank_no, monitor_id, url FROM crawl_jobs WHERE priority = 'emergency' UNION ALL SELECT 1, monitor_id, url FROM discoveries)
SELECT monitor_id, lower(url) AS url, CAST(min(rank_no) AS BIGINT) AS rank_no, count(*) AS n FROM u WHERE url IS NOT NULL GROUP BY 1, 2""")
def candidate_union(spark: SparkSession, root: str) -> DataFrame:
    """Candidates of several providers, the first provider's rank kept."""
    a = table(spark, root, "crawl_jobs").filter("priority = 'emergency'").select(F.lit(0).alias("rank_no"), "monitor_id", "url")
    both = a.unionByName(table(spark, root, "discoveries").select(F.lit(1).alias("rank_no"), "monitor_id", "url")).filter("url is not null")
    return both.groupBy("monitor_id", F.lower("url").alias("url")).agg(F.min("rank_no").cast("bigint").alias("rank_no"), F.count("*").alias("n"))


# ------------------------------------------------------------------ roll-ups


@query("SELECT coalesce(CASE WHEN sentiment IN ('positive', 'neutral', 'negative') THEN sentiment END, 'unknown') AS sentiment, count(*) AS n, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS DOUBLE) AS share FROM classifications GROUP BY 1")
def sentiment_counts(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when(F.col("sentiment").isin("positive", "neutral", "negative"), F.col("sentiment")).otherwise("unknown")
    rows = table(spark, root, "classifications").groupBy(kind.alias("sentiment")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n, CAST(floor(100.0 * count(*) / max(count(*)) OVER () + 0.5) AS BIGINT) AS bar FROM normalized_content GROUP BY 1")
def source_counts(spark: SparkSession, root: str) -> DataFrame:
    """Contents by source, with the length of a bar in percent of the longest."""
    rows = table(spark, root, "normalized_content").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    return rows.withColumn("bar", S.round_half_up(100.0 * F.col("n") / F.max("n").over(Window.partitionBy())))


@query(f"WITH {_MENTION_CTE} SELECT source, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'unknown') AS unknown, count(*) AS total FROM mentions GROUP BY source")
def channel_sentiment(spark: SparkSession, root: str) -> DataFrame:
    """Sentiments by channel."""
    kinds = ["negative", "neutral", "positive", "unknown"]
    wide = mentions(spark, root).groupBy("source").pivot("sentiment", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)
    return wide.withColumn("total", sum((F.col(k) for k in kinds), F.lit(0)).cast("bigint"))


@query("""SELECT monitor_id, count(*) AS jobs, count(DISTINCT url) AS urls, count(*) FILTER (priority = 'emergency') AS emergencies, count(*) FILTER (attempt > 0) AS retries FROM crawl_jobs GROUP BY monitor_id""")
def monitor_rollup(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "crawl_jobs").groupBy("monitor_id").agg(F.count("*").alias("jobs"), F.countDistinct("url").alias("urls"), F.count_if(F.col("priority") == "emergency").alias("emergencies"), F.count_if(F.col("attempt") > 0).alias("retries"))


@query("""WITH c AS (SELECT monitor_id, source, count(*) AS n FROM discoveries GROUP BY ALL) SELECT monitor_id, sum(n)::BIGINT AS total, arg_max(source, (n, source)) AS top_source, max(n) AS top_n FROM c GROUP BY monitor_id""")
def top_channels(spark: SparkSession, root: str) -> DataFrame:
    """Each monitor's strongest channel."""
    rows = table(spark, root, "discoveries").groupBy("monitor_id", "source").agg(F.count("*").alias("n"))
    return rows.groupBy("monitor_id").agg(F.sum("n").alias("total"), F.max_by("source", F.struct("n", "source")).alias("top_source"), F.max("n").alias("top_n"))


@query("""SELECT tenant_id, monitor_id, source, CAST(grouping_id(tenant_id, monitor_id, source) AS BIGINT) AS level, count(*) AS n FROM discoveries GROUP BY ROLLUP (tenant_id, monitor_id, source)""")
def tenant_rollup(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "discoveries").rollup("tenant_id", "monitor_id", "source").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"))


@query("""SELECT tenant_id, CAST(CAST(received_at AS DATE) AS VARCHAR) AS day, count(*) AS alerts, count(*) FILTER (severity = 'critical') AS critical, count(DISTINCT mention_id) AS mentions FROM alert_messages WHERE received_at IS NOT NULL GROUP BY 1, 2""")
def daily_report(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "alert_messages").filter("received_at is not null")
    return rows.groupBy("tenant_id", F.to_date("received_at").cast("string").alias("day")).agg(F.count("*").alias("alerts"), F.count_if(F.col("severity") == "critical").alias("critical"), F.countDistinct("mention_id").alias("mentions"))


@query("""SELECT source, count(*) AS pages, count(*) FILTER (http_status BETWEEN 200 AND 299) AS ok, count(*) FILTER (http_status = 429) AS limited, CAST(round(1.0 * count(*) FILTER (http_status BETWEEN 200 AND 299) / count(*), 6) AS DOUBLE) AS coverage FROM raw_content GROUP BY source""")
def source_health(spark: SparkSession, root: str) -> DataFrame:
    """Success of fetches by source."""
    ok = F.count_if(F.col("http_status").between(200, 299))
    return table(spark, root, "raw_content").groupBy("source").agg(F.count("*").alias("pages"), ok.alias("ok"), F.count_if(F.col("http_status") == 429).alias("limited"), F.round(ok / F.count("*"), 6).alias("coverage"))


@query("""SELECT status, count(*) AS monitors, coalesce(sum(CASE WHEN monitor_type = 'brand' THEN 1 ELSE 0 END), 0)::BIGINT AS brands, coalesce(sum(CASE WHEN scan_interval_sec <= 900 THEN 1 ELSE 0 END), 0)::BIGINT AS hot FROM monitors GROUP BY status""")
def scheduler_stats(spark: SparkSession, root: str) -> DataFrame:
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return table(spark, root, "monitors").groupBy("status").agg(F.count("*").alias("monitors"), one(F.col("monitor_type") == "brand").alias("brands"), one(F.col("scan_interval_sec") <= 900).alias("hot"))


@query("""SELECT priority, count(*) AS n, CAST(quantile_disc(epoch_us(received_at) - epoch_us(created_at), 0.5) AS BIGINT) AS p50, CAST(quantile_disc(epoch_us(received_at) - epoch_us(created_at), 0.95) AS BIGINT) AS p95 FROM crawl_jobs WHERE received_at IS NOT NULL AND created_at IS NOT NULL GROUP BY priority""")
def queue_latency(spark: SparkSession, root: str) -> DataFrame:
    """Median and 95th percentile of the time in the queue, in microseconds."""
    age = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = table(spark, root, "crawl_jobs").filter("received_at is not null and created_at is not null").select("priority", age.alias("age"))
    return O.exact_quantiles(rows, ["priority"], "age", p50=0.5, p95=0.95)


# ------------------------------------------------------------------ text, addresses, hashes

_NORMAL_SQL = r"""list_sort(list_transform(list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(?:utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(?:=|$)')), lambda p: p))"""


@query(rf"""WITH p AS (SELECT discovery_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS auth, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, {_NORMAL_SQL} AS q FROM discoveries WHERE url IS NOT NULL),
n AS (SELECT discovery_id, scheme || '://' || CASE scheme WHEN 'https' THEN regexp_replace(auth, ':443$', '') WHEN 'http' THEN regexp_replace(auth, ':80$', '') ELSE auth END || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/$', '') END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url,
 scheme IN ('http', 'https') AND NOT regexp_matches(split_part(auth, ':', 1), '^(localhost|.*\.localhost|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|fc.*|fd.*)$') AS is_public FROM p)
SELECT discovery_id, url, is_public FROM n""")
def normal_urls(spark: SparkSession, root: str) -> DataFrame:
    """Addresses in one form, and whether they may be fetched."""
    rows = table(spark, root, "discoveries").filter("url is not null")
    return rows.select("discovery_id", U.normalize_url(F.col("url")).alias("url"), U.is_public(F.col("url")).alias("is_public"))


_HIDE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""


def _entities_sql(x: str) -> str:
    for mark, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        x = f"regexp_replace({x}, '(?i){mark}', '{sign}', 'g')"
    return x


_SPACE_SQL = "[\\s   -     　﻿]"
_LINE_SQL = f"trim(regexp_replace({_entities_sql(f"regexp_replace({_HIDE_SQL}, '<[^>]+>', ' ', 'g')")}, '{_SPACE_SQL}+', ' ', 'g'))"


@query(rf"""WITH t AS (SELECT raw_id, content_type, body, {_LINE_SQL} AS line, trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1), '{_SPACE_SQL}+', ' ', 'g')) AS title,
 coalesce(list_sum(list_transform(regexp_extract_all(body, '(?is)<script\b[^>]*>.*?</script>'), lambda s: length(s))), 0) / greatest(1, length(body))::DOUBLE AS ratio FROM raw_content WHERE body IS NOT NULL)
SELECT raw_id, CAST(length(line) AS BIGINT) AS chars, CAST(CASE WHEN contains(lower(content_type), 'html') THEN CASE WHEN title <> '' THEN 20 ELSE 0 END + CASE WHEN length(line) >= 300 THEN 40 ELSE 0 END + CASE WHEN length(line) >= 1000 THEN 20 ELSE 0 END + CASE WHEN ratio < 0.35 THEN 20 ELSE 0 END WHEN length(body) >= 100 THEN 100 ELSE 50 END AS BIGINT) AS quality, md5(line) AS digest FROM t""")
def fetch_quality(spark: SparkSession, root: str) -> DataFrame:
    """Length, quality and digest of each page's visible text."""
    rows = table(spark, root, "raw_content").filter("body is not null")
    body = F.col("body")
    rows = rows.select("raw_id", "content_type", "body", T.html_to_line(body).alias("line"), T.html_title(body).alias("title"), T.script_ratio(body).alias("ratio"))
    score = S.fetch_quality(F.col("content_type"), body, F.col("title"), F.col("line"), F.col("ratio"))
    return rows.select("raw_id", F.length("line").cast("bigint").alias("chars"), score.cast("bigint").alias("quality"), F.md5("line").alias("digest"))


def _rules_sql(x: str, *tables) -> str:
    """The rules of readable text as nested SQL."""
    for pattern, sign in (rule for table in tables for rule in table):
        x = f"regexp_replace({x}, '{pattern}', '{sign.replace(chr(39), chr(39) * 2)}', 'g')"
    return x


_EDGES = f"^{_SPACE_SQL}+|{_SPACE_SQL}+$"
_READ_SQL = f"""regexp_replace({_rules_sql('body', T.HIDDEN_RULES, T.BREAK_RULES, T.TAG_RULES, T.ENTITY_RULES, T.BLANK_RULES)}, '{_EDGES}', '', 'g')"""
_PLAIN_SQL = f"""regexp_replace({_rules_sql('body', T.BLANK_RULES[:1], T.ESCAPE_RULES, T.BLANK_RULES[1:])}, '{_EDGES}', '', 'g')"""


@query(rf"""WITH b AS (SELECT raw_id, regexp_replace(body, '{_EDGES}', '', 'g') AS body FROM raw_content WHERE body IS NOT NULL),
t AS (SELECT raw_id, CASE WHEN regexp_matches(body, '(?is)</?[a-z].*>') THEN {_READ_SQL} ELSE {_PLAIN_SQL} END AS text FROM b),
l AS (SELECT *, trim(regexp_replace(text, '{_SPACE_SQL}+', ' ', 'g')) AS line FROM t)
SELECT raw_id, regexp_replace(split_part(text, chr(10), 1), '{_EDGES}', '', 'g') AS first_line, CASE WHEN length(line) <= 600 THEN line ELSE rtrim(substr(line, 1, 599)) || '…' END AS excerpt, length(text) AS chars FROM l""")
def readable_pages(spark: SparkSession, root: str) -> DataFrame:
    """Readable text of each page, with its first line and excerpt."""
    rows = table(spark, root, "raw_content").filter("body is not null").select("raw_id", T.readable(F.col("body")).alias("text"))
    return rows.select("raw_id", T.first_line(F.col("text")).alias("first_line"), T.excerpt(F.col("text")).alias("excerpt"), F.length("text").cast("bigint").alias("chars"))


@query(f"""WITH t AS (SELECT norm_id, trim(regexp_replace(text, '{_SPACE_SQL}+', ' ', 'g')) AS line FROM normalized_content WHERE text IS NOT NULL)
SELECT norm_id, CASE WHEN length(line) <= 120 THEN line ELSE rtrim(substr(line, 1, 119)) || '…' END AS excerpt FROM t""")
def excerpts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "normalized_content").filter("text is not null").select("norm_id", T.excerpt(F.col("text"), 120).alias("excerpt"))


@query(r"""SELECT discovery_id, discovery_key, sha256(coalesce(monitor_id, '') || chr(31) || coalesce(source, '') || chr(31) || coalesce(url, '')) AS made_key FROM discoveries""")
def discovery_keys(spark: SparkSession, root: str) -> DataFrame:
    """Stored and computed keys of discoveries."""
    return table(spark, root, "discoveries").select("discovery_id", "discovery_key", H.idempotency_key(F.col("monitor_id"), F.col("source"), F.col("url")).alias("made_key"))


@query("""SELECT tenant_id, CAST(('0x' || substr(sha256(tenant_id), 1, 8))::BIGINT % 64 AS BIGINT) AS shard, count(*) AS n FROM discoveries WHERE tenant_id IS NOT NULL GROUP BY 1, 2""")
def tenant_shards(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "discoveries").filter("tenant_id is not null").groupBy("tenant_id").agg(F.count("*").alias("n"))
    return rows.select("tenant_id", H.shard_index(F.col("tenant_id")).cast("bigint").alias("shard"), "n")


@query(r"""SELECT cand_id, CAST(len(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS BIGINT) AS n_tokens, sha256(array_to_string(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'), ' ')) AS content_digest FROM ai_candidates WHERE title IS NOT NULL""")
def content_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Tokens and digest of titles: spacing and punctuation don't change it."""
    rows = table(spark, root, "ai_candidates").filter("title is not null").select("cand_id", T.tokens(F.col("title")).alias("t"))
    return rows.select("cand_id", F.size("t").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("content_digest"))


_FNV_SQL = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_WORDS_SQL = r"SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS w FROM ai_candidates"


@query(f"SELECT w AS token, lpad(lower(hex(CAST({_FNV_SQL} AS UBIGINT))), 16, '0') AS fnv FROM ({_WORDS_SQL})")
def fnv_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """64-bit FNV-1a of every token of the titles."""
    words = table(spark, root, "ai_candidates").select(F.explode(T.tokens(F.col("title"))).alias("token")).distinct()
    return words.select("token", H.fnv1a(F.col("token")).alias("h")).select("token", H.hex64(F.col("h.hi"), F.col("h.lo")).alias("fnv"))


_SIM_CTE = f"""tok AS (SELECT cand_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM ai_candidates WHERE text IS NOT NULL),
h AS (SELECT w, {_FNV_SQL} AS f FROM (SELECT DISTINCT w FROM tok)),
b AS (SELECT t.cand_id, i, sum(CASE WHEN (h.f // (1::HUGEINT << i)) % 2 = 1 THEN 1 ELSE -1 END) AS s FROM tok t JOIN h ON h.w = t.w CROSS JOIN range(0, 64) r(i) GROUP BY ALL),
sim AS (SELECT cand_id, CAST(sum(CASE WHEN i >= 32 AND s > 0 THEN 1::BIGINT << (i - 32) ELSE 0 END) AS BIGINT) AS sim_hi, CAST(sum(CASE WHEN i < 32 AND s > 0 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS sim_lo FROM b GROUP BY cand_id)"""


def text_sims(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "ai_candidates").filter("text is not null").select("cand_id", "text")
    return H.simhash(rows, "cand_id", T.tokens(F.col("text")))


@query(f"WITH {_SIM_CTE} SELECT cand_id, sim_hi, sim_lo FROM sim")
def text_simhash(spark: SparkSession, root: str) -> DataFrame:
    """SimHash of every text."""
    return text_sims(spark, root)


@query(f"""WITH {_SIM_CTE}, c AS (SELECT sim_hi, sim_lo, min(cand_id) AS id FROM sim GROUP BY ALL)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.sim_hi, b.sim_hi)) + bit_count(xor(a.sim_lo, b.sim_lo)) AS BIGINT) AS distance FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.sim_hi, b.sim_hi)) + bit_count(xor(a.sim_lo, b.sim_lo)) <= 3""")
def near_text_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of different text SimHashes within three bits."""
    return D.near_pairs(cut(text_sims(spark, root)), "cand_id").withColumn("distance", F.col("distance").cast("bigint"))


@query(f"""WITH RECURSIVE {_SIM_CTE}, c AS (SELECT sim_hi, sim_lo, min(cand_id) AS id FROM sim GROUP BY ALL),
e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id <> b.id AND bit_count(xor(a.sim_hi, b.sim_hi)) + bit_count(xor(a.sim_lo, b.sim_lo)) <= 3),
w AS (SELECT id, id AS root FROM c UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id WHERE w.root < e.b)
SELECT s.cand_id, min(w.root) AS story FROM sim s JOIN c ON c.sim_hi = s.sim_hi AND c.sim_lo = s.sim_lo JOIN w ON w.id = c.id GROUP BY s.cand_id""")
def text_stories(spark: SparkSession, root: str) -> DataFrame:
    """Stories: all texts that near pairs connect."""
    sims = cut(text_sims(spark, root))
    classes = sims.groupBy("sim_hi", "sim_lo").agg(F.min("cand_id").alias("id"))
    found = D.components(classes, D.near_pairs(sims, "cand_id"), "id")
    return sims.join(classes, ["sim_hi", "sim_lo"]).join(found, "id").select("cand_id", F.col("component").alias("story"))


@query(r"""WITH t AS (SELECT discovery_id, list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS w FROM discoveries WHERE title IS NOT NULL)
SELECT q.discovery_id AS query_id, t.discovery_id, CAST(len(list_intersect(q.w, t.w)) AS DOUBLE) / len(list_distinct(list_concat(q.w, t.w))) AS overlap FROM t q JOIN t ON q.discovery_id % 50 = 0 AND q.discovery_id <> t.discovery_id AND len(q.w) > 0 AND len(t.w) > 0
WHERE CAST(len(list_intersect(q.w, t.w)) AS DOUBLE) / len(list_distinct(list_concat(q.w, t.w))) >= 0.55""")
def similar_titles(spark: SparkSession, root: str) -> DataFrame:
    """Titles that overlap those of the stated queries, every fiftieth row, by 0.55 or more."""
    rows = table(spark, root, "discoveries").filter("title is not null")
    return D.title_matches(rows, "discovery_id", T.tokens(F.col("title")), F.col("discovery_id") % 50 == 0)


@query(f"""WITH {_SIM_CTE.split('b AS')[0].rstrip(', ').rstrip().rstrip(',')}, v AS (SELECT cand_id, CAST(h.f % 64 AS BIGINT) AS place, sum(CASE WHEN h.f >= 9223372036854775808::HUGEINT THEN -1 ELSE 1 END) AS s FROM tok t JOIN h ON h.w = t.w GROUP BY ALL HAVING sum(CASE WHEN h.f >= 9223372036854775808::HUGEINT THEN -1 ELSE 1 END) <> 0)
SELECT cand_id, place, CAST(round(s / sqrt(sum(s * s) OVER (PARTITION BY cand_id)), 9) AS DOUBLE) AS value FROM v""")
def text_embedding(spark: SparkSession, root: str) -> DataFrame:
    """Cells of the hashed embedding of every text."""
    rows = table(spark, root, "ai_candidates").filter("text is not null").select("cand_id", "text")
    return H.hashed_embedding(rows, "cand_id", T.tokens(F.col("text"))).select("cand_id", F.col("place").cast("bigint").alias("place"), F.round("value", 9).alias("value"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) AS place FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, similarity, place FROM s WHERE place <= 10""")
def nearest_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Ten nearest vectors of every fiftieth one, against all, exactly."""
    found = D.nearest_vectors(table(spark, root, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("bigint").alias("place"))


@query("""SELECT discovery_id, url, title FROM discoveries WHERE url IS NOT NULL""")
def feed_items(spark: SparkSession, root: str) -> DataFrame:
    """Discoveries written as feeds and read again."""
    esc = lambda c: T.escape_html(F.coalesce(F.col(c), F.lit("")))
    rows = table(spark, root, "discoveries").filter("url is not null")
    title = F.when(F.col("title").isNull(), F.lit("")).otherwise(F.concat(F.lit("<title><![CDATA["), F.col("title"), F.lit("]]></title>")))
    item = F.concat(F.lit("<rss><item>"), title, F.lit("<link>"), esc("url"), F.lit("</link></item></rss>"))
    return feeds.read_feeds(rows.select("discovery_id", item.alias("xml"), F.lit("https://feeds.example/all").alias("feed_url")), keep=["discovery_id"]).select("discovery_id", "url", "title")


@query("""SELECT raw_id, url FROM raw_content WHERE url IS NOT NULL""")
def sitemap_urls(spark: SparkSession, root: str) -> DataFrame:
    """Addresses written as sitemaps and read again."""
    rows = table(spark, root, "raw_content").filter("url is not null").select("raw_id", F.concat(F.lit("<urlset><url><loc>"), T.escape_html(F.col("url")), F.lit("</loc></url></urlset>")).alias("xml"))
    return feeds.read_sitemaps(rows, keep=["raw_id"]).select("raw_id", "url")


# ------------------------------------------------------------------ time


@query("""WITH d AS (SELECT user_id, ts, value, lag(ts) OVER w AS ts0, lag(value) OVER w AS v0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value))
SELECT user_id, CAST(round(coalesce(avg((value - v0) / ((epoch_us(ts) - epoch_us(ts0)) / 3600000000.0::DOUBLE)) FILTER (epoch_us(ts) > epoch_us(ts0)), 0), 6) AS DOUBLE) AS per_hour FROM d GROUP BY user_id""")
def engagement_velocity(spark: SparkSession, root: str) -> DataFrame:
    """Mean growth an hour of each user's value."""
    rows = table(spark, root, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return O.velocity(rows, "user_id", "ts", "value").select("user_id", F.round("per_hour", 6).alias("per_hour"))


@query("""WITH w AS (SELECT user_id % 10 AS source_id, time_bucket(INTERVAL 15 MINUTES, ts) AS s, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS negatives FROM events GROUP BY ALL)
SELECT source_id, CAST(epoch_us(s) AS BIGINT) AS start_us, n, CAST(negatives AS BIGINT) AS negatives, CAST(CASE WHEN negatives >= 5 THEN 2 WHEN negatives >= 2 OR n >= 20 THEN 5 WHEN n >= 8 THEN 10 WHEN n >= 2 THEN 15 ELSE 30 END AS BIGINT) AS minutes FROM w""")
def adaptive_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Rates of a quarter of an hour and the interval that follows from them."""
    rows = table(spark, root, "events").select((F.col("user_id") % 10).alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    got = O.rates(rows, "ts", ["source_id"], negatives=F.when(F.col("event_type") == "error", 1).otherwise(0))
    return got.select("source_id", F.unix_micros("window_start").alias("start_us"), "n", F.col("negatives").cast("bigint").alias("negatives"), O.adaptive_interval(F.col("n"), F.col("negatives")).cast("bigint").alias("minutes"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES > ts THEN 0 ELSE 1 END AS fresh FROM events),
k AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS started_us, count(*) AS n FROM k GROUP BY user_id, k.k""")
def user_bursts(spark: SparkSession, root: str) -> DataFrame:
    """Runs of events without a pause of half an hour."""
    rows = table(spark, root, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return O.bursts(rows, "user_id", "ts").select("user_id", F.unix_micros("started").alias("started_us"), "n")


@query("""WITH d AS (SELECT source, CAST(received_at AS DATE) AS day, count(*) AS n FROM crawl_jobs WHERE received_at IS NOT NULL GROUP BY ALL),
w AS (SELECT *, avg(n) OVER b AS mean, stddev_pop(n) OVER b AS dev FROM d WINDOW b AS (PARTITION BY source ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT source, CAST(day AS VARCHAR) AS day, n FROM w WHERE round(n, 6) > round(mean + 2 * dev, 6)""")
def volume_spikes(spark: SparkSession, root: str) -> DataFrame:
    """Days on which a source delivered far more than in the week before."""
    daily = table(spark, root, "crawl_jobs").filter("received_at is not null").groupBy("source", F.to_date("received_at").alias("day")).agg(F.count("*").alias("n"))
    before = O.spikes(daily, "source", "day", "n", deviations=2.0)
    return before.filter(F.round("n", 6) > F.round(F.col("mean") + 2 * F.col("deviation"), 6)).select("source", F.col("day").cast("string").alias("day"), "n")


@query("""SELECT message_id FROM (SELECT message_id, created_at, lag(created_at) OVER (PARTITION BY monitor_id, severity ORDER BY created_at) AS before FROM (SELECT DISTINCT ON (monitor_id, severity, created_at) * FROM alert_messages WHERE created_at IS NOT NULL ORDER BY monitor_id, severity, created_at, message_id)) WHERE before IS NULL OR epoch_us(created_at) - epoch_us(before) >= 3600000000""")
def cooled_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Alerts that no alert of the same monitor and severity came before within an hour."""
    rows = table(spark, root, "alert_messages").filter("created_at is not null").withColumn("created_at", F.col("created_at").cast("timestamp"))
    once = D.first_wins(rows, [F.col("monitor_id"), F.col("severity"), F.col("created_at")], [F.col("message_id")])
    return O.cooled(once, ["monitor_id", "severity"], "created_at", 60).select("message_id")


@query("""WITH v AS (SELECT norm_id, content_id, lag(content_id) OVER (PARTITION BY canonical_url ORDER BY ingested_at NULLS FIRST, norm_id) AS before, row_number() OVER (PARTITION BY canonical_url ORDER BY ingested_at NULLS FIRST, norm_id) AS version FROM normalized_content WHERE canonical_url IS NOT NULL)
SELECT norm_id, version FROM v WHERE before IS NULL OR before <> content_id""")
def content_versions(spark: SparkSession, root: str) -> DataFrame:
    """Rows in which the content of an address changed."""
    order = Window.partitionBy("canonical_url").orderBy(ordered("ingested_at"), "norm_id")
    rows = table(spark, root, "normalized_content").filter("canonical_url is not null").select("norm_id", "content_id", F.lag("content_id").over(order).alias("before"), F.row_number().over(order).cast("bigint").alias("version"))
    return rows.filter(F.col("before").isNull() | (F.col("before") != F.col("content_id"))).select("norm_id", "version")


@query("""SELECT a.message_id, j.url AS last_url FROM alert_messages a ASOF LEFT JOIN (SELECT monitor_id, received_at, max(url) AS url FROM crawl_jobs WHERE received_at IS NOT NULL AND monitor_id IS NOT NULL GROUP BY ALL) j ON a.monitor_id = j.monitor_id AND a.created_at >= j.received_at WHERE a.monitor_id IS NOT NULL AND a.created_at IS NOT NULL""")
def last_job_of_alert(spark: SparkSession, root: str) -> DataFrame:
    """The job that each alert's monitor had last received when the alert was made: an as-of join."""
    jobs = table(spark, root, "crawl_jobs").filter("received_at is not null and monitor_id is not null").groupBy("monitor_id", F.col("received_at").alias("at")).agg(F.max("url").alias("last_url"))
    alerts = table(spark, root, "alert_messages").filter("monitor_id is not null and created_at is not null").select("message_id", "monitor_id", F.col("created_at").alias("at"))
    return O.as_of(alerts, jobs, ["monitor_id"], "at", ["last_url"]).select("message_id", "last_url")


@query("""WITH r AS (SELECT monitor_id, lower(url) AS url, source, row_number() OVER (PARTITION BY monitor_id, source ORDER BY discovered_at DESC NULLS LAST, discovery_id) AS k FROM discoveries WHERE url IS NOT NULL)
SELECT monitor_id, url, CAST(round(sum(1.0 / (60 + k)), 9) AS DOUBLE) AS score FROM r GROUP BY ALL""")
def fused_ranks(spark: SparkSession, root: str) -> DataFrame:
    """Reciprocal rank fusion of each monitor's sources."""
    k = F.row_number().over(Window.partitionBy("monitor_id", "source").orderBy(F.col("discovered_at").desc_nulls_last(), "discovery_id"))
    rows = table(spark, root, "discoveries").filter("url is not null").select("monitor_id", F.lower("url").alias("url"), k.alias("k"))
    return rows.groupBy("monitor_id", "url").agg(F.round(F.sum(1.0 / (60 + F.col("k"))), 9).alias("score"))


@query(f"""WITH c AS (SELECT *, CAST(('0x' || substr(sha256(tenant_id), 1, 8))::BIGINT % 64 AS BIGINT) AS shard FROM monitors WHERE status = 'active' AND created_at <= TIMESTAMP '{NOW}'),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY created_at, monitor_id) AS k FROM c)
SELECT monitor_id, shard, CAST(epoch_us(TIMESTAMP '{NOW}') + 120000000 AS BIGINT) AS lease_us, CAST(epoch_us(greatest(created_at, TIMESTAMP '{NOW}')) + greatest(1, scan_interval_sec) * 1000000 AS BIGINT) AS next_us FROM r WHERE k <= 50""")
def claimed_monitors(spark: SparkSession, root: str) -> DataFrame:
    """Due monitors with their leases and next times."""
    due = table(spark, root, "monitors").withColumns({"next_scan_at": F.col("created_at").cast("timestamp"), "claimed_until": F.lit(None).cast("timestamp")})
    got = O.claim(due, F.lit(NOW).cast("timestamp"))
    return got.select("monitor_id", F.col("shard").cast("bigint").alias("shard"), F.unix_micros("claimed_until").alias("lease_us"), F.unix_micros("next_scan_at").alias("next_us"))


@query("""SELECT source, CAST(CAST(discovered_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM discoveries WHERE discovered_at >= TIMESTAMP '2025-12-31' - INTERVAL 180 DAYS GROUP BY ALL""")
def retained_discoveries(spark: SparkSession, root: str) -> DataFrame:
    """Discoveries inside the retention of 180 days, by day."""
    rows = table(spark, root, "discoveries").filter(F.col("discovered_at") >= F.lit("2025-07-04").cast("timestamp"))
    return rows.groupBy("source", F.to_date("discovered_at").cast("string").alias("day")).agg(F.count("*").alias("n"))

# ------------------------------------------------------------------ further predicates, joins and windows


@query(r"""SELECT raw_id FROM raw_content WHERE (content_type IS NULL OR regexp_matches(lower(content_type), '^(text/|application/(xhtml\+xml|xml|json|rss\+xml|atom\+xml))')) AND octet_length(encode(coalesce(body, ''))) <= 5 * 1024 * 1024""")
def storable_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages of a textual type, or of none, of at most 5 MiB."""
    textual = F.col("content_type").isNull() | F.lower("content_type").rlike(r"^(text/|application/(xhtml\+xml|xml|json|rss\+xml|atom\+xml))")
    return table(spark, root, "raw_content").filter(textual & (F.octet_length(F.coalesce("body", F.lit(""))) <= 5 * 1024 * 1024)).select("raw_id")


@query("""SELECT alert_id, monitor_id, count(*) FILTER (priority <> 'normal') AS attempts, CAST(epoch_us(max(received_at)) AS BIGINT) AS updated_us, arg_max(severity, (received_at, message_id)) AS severity FROM alert_messages WHERE alert_id <> '' AND received_at IS NOT NULL GROUP BY ALL""")
def delivery_upserts(spark: SparkSession, root: str) -> DataFrame:
    """State that repeated upserts by alert and monitor leave: attempts add up, the rest is the last's."""
    rows = table(spark, root, "alert_messages").filter("alert_id <> '' and received_at is not null")
    return rows.groupBy("alert_id", "monitor_id").agg(F.count_if(F.col("priority") != "normal").alias("attempts"), F.unix_micros(F.max("received_at").cast("timestamp")).alias("updated_us"), F.max_by("severity", F.struct("received_at", "message_id")).alias("severity"))


@query("""WITH h AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS t, count(*) AS n FROM events GROUP BY ALL),
d AS (SELECT *, n - lag(n) OVER w AS growth FROM h WINDOW w AS (PARTITION BY event_type ORDER BY t)),
a AS (SELECT *, growth - lag(growth) OVER (PARTITION BY event_type ORDER BY t) AS acceleration FROM d)
SELECT event_type, CAST(epoch_us(t) AS BIGINT) AS hour_us, n, growth, acceleration, CAST(round(percent_rank() OVER (PARTITION BY event_type ORDER BY n), 9) AS DOUBLE) AS standing FROM a""")
def growth_and_acceleration(spark: SparkSession, root: str) -> DataFrame:
    """Hourly counts of each kind of event with growth, its change, and the standing among the kind's hours."""
    rows = table(spark, root, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    hourly, kind = O.rates(rows, "ts", ["event_type"], "1 hour"), Window.partitionBy("event_type")
    order = kind.orderBy("window_start")
    rows = hourly.withColumn("growth", F.col("n") - F.lag("n").over(order))
    rows = rows.withColumn("acceleration", F.col("growth") - F.lag("growth").over(order)).withColumn("standing", F.round(F.percent_rank().over(kind.orderBy("n")), 9))
    return rows.select("event_type", F.unix_micros("window_start").alias("hour_us"), "n", "growth", "acceleration", "standing")


@query(f"WITH {_MENTION_CTE} SELECT source, norm_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY severity DESC, discovered_at DESC NULLS LAST, norm_id) AS k FROM mentions WHERE sentiment = 'negative') WHERE k <= 4")
def worst_by_source(spark: SparkSession, root: str) -> DataFrame:
    """The four worst mentions of each source: a top-k report."""
    rows = mentions(spark, root).filter("sentiment = 'negative'")
    return D.top_per(rows, [F.col("source")], [F.desc("severity"), F.col("discovered_at").desc_nulls_last(), F.col("norm_id")], 4).select("source", "norm_id", "severity")


@query("""SELECT n.norm_id, r.raw_id FROM normalized_content n JOIN raw_content r ON lower(n.canonical_url) = lower(r.url) AND r.fetched_at <= n.ingested_at AND r.fetched_at >= n.ingested_at - INTERVAL 1 DAY""")
def fresh_fetches(spark: SparkSession, root: str) -> DataFrame:
    """Texts whose page was fetched in the day before: an equi-join with an interval."""
    texts = table(spark, root, "normalized_content").select("norm_id", F.lower("canonical_url").alias("url"), "ingested_at")
    pages = table(spark, root, "raw_content").select("raw_id", F.lower("url").alias("url"), "fetched_at")
    fresh = (F.col("fetched_at") <= F.col("ingested_at")) & (F.col("fetched_at") >= F.col("ingested_at") - F.expr("interval 1 day"))
    return texts.join(pages, "url").filter(fresh).select("norm_id", "raw_id")


@query(r"""SELECT discovery_id, CAST(epoch_us(coalesce(CASE WHEN regexp_matches(published_at, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$') THEN try_cast(replace(replace(published_at, 'T', ' '), 'Z', '') AS TIMESTAMP) END, discovered_at, ingested_at)) AS BIGINT) AS event_us FROM discoveries""")
def event_times(spark: SparkSession, root: str) -> DataFrame:
    """Time of each discovery: when published in the own form, else discovered, else ingested."""
    own = F.when(F.col("published_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"), F.try_to_timestamp("published_at"))
    at = F.coalesce(own, F.col("discovered_at").cast("timestamp"), F.col("ingested_at").cast("timestamp"))
    return table(spark, root, "discoveries").select("discovery_id", F.unix_micros(at).alias("event_us"))


@query(f"""WITH {_SIM_CTE}, n AS (SELECT q.cand_id AS query_id, s.cand_id, bit_count(xor(q.sim_hi, s.sim_hi)) + bit_count(xor(q.sim_lo, s.sim_lo)) AS distance FROM sim q JOIN sim s ON q.cand_id % 50 = 0 AND q.cand_id <> s.cand_id AND (q.sim_hi <> 0 OR q.sim_lo <> 0))
SELECT query_id, cand_id, CAST(distance AS BIGINT) AS distance FROM n WHERE distance <= 3""")
def near_texts_of_queries(spark: SparkSession, root: str) -> DataFrame:
    """Texts within three bits of every fiftieth one's, against all, by bands."""
    rows = D.band_rows(cut(text_sims(spark, root)), "cand_id")
    q = rows.filter("cand_id % 50 = 0").select(F.col("cand_id").alias("query_id"), F.col("sim_hi").alias("qh"), F.col("sim_lo").alias("ql"), "band", "value")
    met = q.join(rows, ["band", "value"]).filter("query_id <> cand_id").withColumn("distance", H.hamming(F.col("qh"), F.col("ql"), F.col("sim_hi"), F.col("sim_lo")).cast("bigint"))
    return met.filter("distance <= 3").select("query_id", "cand_id", "distance").distinct()


@query("""SELECT monitor_id, source, CAST(least(1000, 300 * CASE WHEN age <= 1 THEN 1.0 WHEN age <= 6 THEN 0.8 WHEN age <= 24 THEN 0.5 ELSE 0.1 END + 10 * least(n, 50)) AS BIGINT) AS priority FROM (
SELECT monitor_id, source, count(*) AS n, date_diff('hour', max(discovered_at), TIMESTAMP '2025-12-31') AS age FROM discoveries WHERE discovered_at IS NOT NULL GROUP BY ALL)""")
def candidate_priority(spark: SparkSession, root: str) -> DataFrame:
    """Priority of each monitor's sources by freshness in steps and by volume, 0 to 1000."""
    now = F.lit("2025-12-31").cast("timestamp")
    age = F.timestamp_diff("HOUR", F.date_trunc("hour", F.max("discovered_at").cast("timestamp")), now)
    rows = table(spark, root, "discoveries").filter("discovered_at is not null").groupBy("monitor_id", "source").agg(F.count("*").alias("n"), age.alias("age"))
    step = F.when(F.col("age") <= 1, 1.0).when(F.col("age") <= 6, 0.8).when(F.col("age") <= 24, 0.5).otherwise(0.1)
    return rows.select("monitor_id", "source", F.least(F.lit(1000.0), F.lit(300) * step + F.lit(10) * F.least("n", F.lit(50))).cast("bigint").alias("priority"))


@query(r"""WITH w AS (SELECT DISTINCT monitor_id, unnest(regexp_extract_all(lower(monitor_name), '[\p{L}\p{N}]+')) AS w FROM monitors),
t AS (SELECT DISTINCT discovery_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS w FROM discoveries)
SELECT t.discovery_id, w.monitor_id, count(*) AS words FROM t JOIN w ON w.w = t.w GROUP BY ALL""")
def monitor_index(spark: SparkSession, root: str) -> DataFrame:
    """Monitors that a title may concern, by an inverted index of the words of their names."""
    words = table(spark, root, "monitors").select("monitor_id", F.explode(F.array_distinct(T.tokens(F.col("monitor_name")))).alias("w"))
    titles = table(spark, root, "discoveries").filter("title is not null").select("discovery_id", F.explode(F.array_distinct(T.tokens(F.col("title")))).alias("w"))
    return titles.join(words, "w").groupBy("discovery_id", "monitor_id").agg(F.count("*").alias("words"))


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Latest severe mentions that match a Boolean query."""
    matched = query_matches(spark, root).select("norm_id").distinct()
    return mentions(spark, root).join(matched, "norm_id", "left_semi").filter("severity > 0").orderBy(F.desc("discovered_at"), "norm_id").limit(50).select("norm_id", "source", "title", "sentiment", "severity")
