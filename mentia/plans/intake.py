"""Queries of intake, storage and reading over whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from mentia.boolean.language import simplify_for_search, topic_tags
from mentia.functions import hashing as H, text as T, urls as U
from mentia.operators import dedupe as D, folds, timely as O
from mentia.plans import reference as R
from mentia.plans.reference import QUERIES, SQL, query
from mentia.session import cut
from mentia.sources import providers as P
from mentia.sources.tables import table

__all__ = ["QUERIES", "SQL"]

ASKED = '(errors OR refund) OR "long queues"'
_ASKED_SQL = "(contains(t, 'errors') OR contains(t, 'refund') OR contains(t, 'long queues'))"


@query(f"""WITH m AS (SELECT discovery_id, url, lower(coalesce(title, '') || ' ' || coalesce(snippet, '')) AS t FROM discoveries WHERE url IS NOT NULL)
SELECT discovery_id, lower(url) AS url FROM (SELECT *, row_number() OVER (PARTITION BY lower(url) ORDER BY discovery_id) AS k FROM m WHERE {_ASKED_SQL}) WHERE k = 1""")
def matching_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Candidates that match a query, each address once."""
    rows = table(spark, root, "discoveries").filter("url is not null").select("discovery_id", "url", "title", "snippet")
    return P.first_by_address(P.matching(rows, ASKED), ["discovery_id"]).select("discovery_id", F.lower("url").alias("url"))


@query("""SELECT discovery_id, 'https://www.reddit.com/r/brands/comments/' || native_id || '/x' AS url FROM discoveries WHERE source = 'reddit' AND regexp_matches(native_id, '^[a-zA-Z0-9]+') AND discovery_id % 2 = 0""")
def forum_posts(spark: SparkSession, root: str) -> DataFrame:
    """Canonical addresses of forum posts; other pages of the forum are none."""
    page = F.when(F.col("discovery_id") % 2 == 0, F.concat(F.lit("comments/"), "native_id", F.lit("/x#c"))).otherwise(F.lit("wiki"))
    rows = table(spark, root, "discoveries").filter("source = 'reddit'").select("discovery_id", U.post_permalink(F.concat(F.lit("https://old.reddit.com/r/brands/"), page)).alias("url"))
    return rows.filter("url is not null")


@query(r"""WITH h AS (SELECT discovery_id, regexp_extract(lower(regexp_extract(url, '(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^(?:[^@]*@)?([^:]*)', 1) AS h FROM discoveries WHERE url IS NOT NULL)
SELECT discovery_id, h = 'example.org' OR ends_with(h, '.example.org') OR h = 'invalid' OR ends_with(h, '.invalid') AS allowed FROM h""")
def allowed_hosts(spark: SparkSession, root: str) -> DataFrame:
    """Whether each candidate's host is one of a list or below one."""
    return table(spark, root, "discoveries").filter("url is not null").select("discovery_id", U.on_hosts(F.col("url"), ["example.org", "invalid"]).alias("allowed"))


_SLUG_SQL = "regexp_replace(lower(monitor_name), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH s AS (SELECT monitor_id, {_SLUG_SQL} AS s, monitor_type FROM monitors)
SELECT monitor_id, 'website' AS key, 'https://' || s || '.example/' AS url FROM s WHERE s <> '' UNION ALL SELECT monitor_id, 'x', 'http://x.com/' || s FROM s WHERE monitor_type = 'brand' UNION ALL SELECT monitor_id, 'reddit', 'https://reddit.com/r/' || s FROM s WHERE monitor_type = 'product'""")
def profile_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Addresses of the monitors' profiles; what is no address gives none."""
    s = F.regexp_replace(F.lower("monitor_name"), "[^a-z0-9]+", "")
    kind = F.col("monitor_type")
    profile = F.create_map(F.lit("website"), F.concat(F.lit(" "), s, F.lit(".Example ")), F.lit("x"), F.when(kind == "brand", F.concat(F.lit("http://X.com/"), s)), F.lit("reddit"), F.when(kind == "product", F.concat(F.lit("reddit.com/r/"), s)).otherwise(F.lit("ftp://reddit.com/")), F.lit("tiktok"), F.lit("nodots"))
    rows = P.profile_candidates(table(spark, root, "monitors").filter(s != "").select("monitor_id", profile.alias("profile")))
    return rows.select("monitor_id", F.col("metadata")["profileKey"].alias("key"), "url")


@query("""WITH g AS (SELECT 0 AS grp, feed_host AS h FROM feed_zones WHERE feed_host IS NOT NULL UNION ALL SELECT 1, upper(feed_host) FROM discoveries WHERE feed_host IS NOT NULL GROUP BY feed_host), u AS (SELECT grp, 'https://' || h || CASE WHEN grp = 0 THEN '/' ELSE '' END AS url FROM g)
SELECT url, CAST(grp AS BIGINT) AS grp FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(url), '/+$', '') ORDER BY grp, url) AS k FROM u) WHERE k = 1""")
def merged_feeds(spark: SparkSession, root: str) -> DataFrame:
    """Feeds of two groups, the first spelling of each."""
    own = table(spark, root, "feed_zones").filter("feed_host is not null").select(F.lit(0).alias("grp"), F.concat(F.lit("https://"), "feed_host", F.lit("/")).alias("url"))
    met = table(spark, root, "discoveries").filter("feed_host is not null").select("feed_host").distinct().select(F.lit(1).alias("grp"), F.concat(F.lit("https://"), F.upper("feed_host")).alias("url"))
    return P.merged_feeds(own.unionByName(met), order=("grp", "url")).select("url", F.col("grp").cast("bigint").alias("grp"))


@F.pandas_udf(StringType())
def _search_text(query):
    return query.map(lambda q: None if q is None else simplify_for_search(q))


@F.pandas_udf(StringType())
def _tags(query):
    return query.map(lambda q: None if q is None else ",".join(topic_tags(q)))


@query(r"""WITH p AS (SELECT monitor_id, regexp_extract_all(raw_query, '"([^"]{2,80})"', 1) AS p FROM monitors WHERE raw_query IS NOT NULL AND regexp_matches(raw_query, '^"[^"]{2,40}" AND NOT "[^"]{2,40}"$'))
SELECT monitor_id, '"' || p[1] || '" OR "' || p[2] || '"' AS search_text FROM p""")
def search_texts(spark: SparkSession, root: str) -> DataFrame:
    """What a search without the language is asked for monitors of two phrases."""
    rows = table(spark, root, "monitors").filter(F.col("raw_query").rlike(r'^"[^"]{2,40}" AND NOT "[^"]{2,40}"$'))
    return rows.select("monitor_id", _search_text("raw_query").alias("search_text"))


@query(r"""WITH p AS (SELECT monitor_id, regexp_extract_all(raw_query, '"([^"]+)"', 1) AS p FROM monitors WHERE raw_query IS NOT NULL AND regexp_matches(raw_query, '^"[A-Za-z0-9 -]{3,40}" AND NOT "[A-Za-z0-9 -]{3,40}"$'))
SELECT monitor_id, trim(regexp_replace(lower(p[1]), '[^a-z0-9]+', '-', 'g'), '-') || ',' || trim(regexp_replace(lower(p[2]), '[^a-z0-9]+', '-', 'g'), '-') AS tags FROM p WHERE p[1] <> p[2]""")
def monitor_tags(spark: SparkSession, root: str) -> DataFrame:
    """Topic tags of monitors of two phrases."""
    rows = table(spark, root, "monitors").filter(F.col("raw_query").rlike(r'^"[A-Za-z0-9 -]{3,40}" AND NOT "[A-Za-z0-9 -]{3,40}"$'))
    return rows.select("monitor_id", _tags("raw_query").alias("tags"))


# ------------------------------------------------------------------ texts, labels, answers


@query("""SELECT discovery_id, CASE lower(coalesce(nullif(source, ''), 'unknown')) WHEN 'web' THEN 'Article' WHEN 'rss' THEN 'Blog post' WHEN 'x' THEN 'X post' WHEN 'youtube' THEN 'YouTube video' WHEN 'tiktok' THEN 'TikTok video' WHEN 'telegram' THEN 'Telegram group' WHEN 'linkedin' THEN 'LinkedIn' WHEN 'discord' THEN 'Discord server' WHEN 'zalo' THEN 'Zalo group' WHEN 'facebook_group' THEN 'Facebook group' ELSE upper(substr(coalesce(nullif(source, ''), 'unknown'), 1, 1)) || lower(substr(coalesce(nullif(source, ''), 'unknown'), 2)) END AS kind,
 CASE lower(coalesce(nullif(source, ''), 'unknown')) WHEN 'rss' THEN 'Blogs / RSS' WHEN 'youtube' THEN 'YouTube' WHEN 'tiktok' THEN 'TikTok' WHEN 'linkedin' THEN 'LinkedIn' WHEN 'facebook_group' THEN 'Facebook groups' ELSE upper(substr(coalesce(nullif(source, ''), 'unknown'), 1, 1)) || lower(substr(coalesce(nullif(source, ''), 'unknown'), 2)) END AS channel FROM discoveries""")
def source_labels(spark: SparkSession, root: str) -> DataFrame:
    """What a source and its content are called."""
    return table(spark, root, "discoveries").select("discovery_id", T.label(F.col("source"), T.CONTENT_LABELS).alias("kind"), T.label(F.col("source"), T.CHANNEL_LABELS).alias("channel"))


@query("""SELECT cand_id, length(substr(text, 1, 16000)) AS chars, md5(substr(text, 1, 16000)) AS digest, substr(coalesce(title, 'unclassified'), 1, 40) AS topic, lower(trim(coalesce(monitor_name, '') || '@Mail.Example ')) AS email FROM ai_candidates WHERE text IS NOT NULL""")
def sent_texts(spark: SparkSession, root: str) -> DataFrame:
    """What is sent to classification, its length bounded as the feature is."""
    text = T.clamp(F.col("text"), 16_000)
    return table(spark, root, "ai_candidates").filter("text is not null").select("cand_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest"), T.clamp(F.col("title"), 40, "unclassified").alias("topic"), T.email(F.concat(F.coalesce("monitor_name", F.lit("")), F.lit("@Mail.Example "))).alias("email"))


_ANSWER_SQL = """j AS (SELECT class_id, CASE WHEN class_id % 11 = 0 THEN 'broken {' ELSE to_json(struct_pack(sentiment := CASE WHEN class_id % 13 = 0 THEN 'mixed' ELSE sentiment END, confidence := confidence * 3 - 0.5::DOUBLE, topic := repeat(topic, 40), "riskCategories" := risk_categories)) END AS answer, CASE WHEN class_id % 13 = 0 THEN 'mixed' ELSE sentiment END AS s, confidence * 3 - 0.5::DOUBLE AS c, repeat(topic, 40) AS topic, risk_categories FROM classifications)"""


@query(f"""WITH {_ANSWER_SQL} SELECT class_id, s AS sentiment, CAST(round(CASE WHEN c IS NULL THEN 0.5 ELSE greatest(0, least(1, c)) END, 9) AS DOUBLE) AS confidence, coalesce(substr(topic, 1, 120), 'unclassified') AS topic, 'No explanation' AS reason, 'unknown' AS language, CAST(least(10, coalesce(len(risk_categories), 0)) AS BIGINT) AS risks FROM j WHERE class_id % 11 <> 0 AND s IN ('positive', 'neutral', 'negative')""")
def checked_answers(spark: SparkSession, root: str) -> DataFrame:
    """Answers of a classifier, clamped; broken ones and unknown sentiments are refused."""
    k = F.col("class_id")
    made = F.to_json(F.struct(F.when(k % 13 == 0, "mixed").otherwise(F.col("sentiment")).alias("sentiment"), (F.col("confidence") * 3 - 0.5).alias("confidence"), F.repeat("topic", F.lit(40)).alias("topic"), F.col("risk_categories").alias("riskCategories")))
    rows = table(spark, root, "classifications").select("class_id", T.classification(F.when(k % 11 == 0, "broken {").otherwise(made)).alias("a")).filter("a is not null")
    return rows.select("class_id", "a.sentiment", F.round("a.confidence", 9).alias("confidence"), "a.topic", "a.reason", "a.language", F.size("a.risks").cast("bigint").alias("risks"))


@query("""SELECT norm_id, CAST(json_extract(CASE WHEN json_valid(metadata_json) AND json_type(metadata_json) = 'OBJECT' THEN metadata_json ELSE '{}' END, '$.words') AS BIGINT) AS words FROM normalized_content""")
def metadata_words(spark: SparkSession, root: str) -> DataFrame:
    """A value of the metadata, an empty object standing for what can't be read."""
    return table(spark, root, "normalized_content").select("norm_id", F.get_json_object(T.json_object(F.col("metadata_json")), "$.words").cast("bigint").alias("words"))


# ------------------------------------------------------------------ storage


@query("""SELECT digest, raw_id FROM (SELECT sha256(body) AS digest, raw_id, row_number() OVER (PARTITION BY sha256(body) ORDER BY raw_id) AS k FROM raw_content WHERE body IS NOT NULL AND octet_length(encode(body)) <= 5242880) WHERE k = 1""")
def new_blobs(spark: SparkSession, root: str) -> DataFrame:
    """Bodies to store by their digest, each once, those beyond the cap left out."""
    rows = table(spark, root, "raw_content").filter("body is not null and octet_length(body) <= 5242880").select(F.sha2("body", 256).alias("digest"), "raw_id")
    return rows.groupBy("digest").agg(F.min("raw_id").alias("raw_id"))


@query("""WITH r AS (SELECT raw_id, lower(url) AS u, fetched_at FROM raw_content WHERE url IS NOT NULL AND fetched_at IS NOT NULL),
a AS (SELECT n.norm_id, max(r.fetched_at) AS fetched FROM normalized_content n LEFT JOIN r ON r.u = lower(n.canonical_url) AND r.fetched_at <= n.ingested_at GROUP BY n.norm_id)
SELECT n.norm_id, a.fetched IS NOT NULL AND epoch_us(n.ingested_at) - epoch_us(a.fetched) < 3600000000 AS cached FROM normalized_content n JOIN a ON a.norm_id = n.norm_id WHERE n.canonical_url IS NOT NULL AND n.ingested_at IS NOT NULL""")
def cached_fetches(spark: SparkSession, root: str) -> DataFrame:
    """Whether a text's address had been fetched within the last hour: the latest fetch before, and its age."""
    left = table(spark, root, "normalized_content").filter("canonical_url is not null and ingested_at is not null").select("norm_id", F.lower("canonical_url").alias("u"), F.col("ingested_at").alias("at"))
    right = table(spark, root, "raw_content").filter("url is not null and fetched_at is not null").select(F.lower("url").alias("u"), F.col("fetched_at").alias("at"), F.col("fetched_at").alias("fetched"))
    rows = O.as_of(left, right, ["u"], "at", ["fetched"])
    age = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("fetched").cast("timestamp"))
    return rows.select("norm_id", F.coalesce(age < 3_600_000_000, F.lit(False)).alias("cached"))


@query("""WITH d AS (SELECT tenant_id, CAST(received_at AS DATE) AS day, count(*) AS alerts FROM alert_messages WHERE received_at IS NOT NULL AND tenant_id IS NOT NULL GROUP BY 1, 2)
SELECT sha256(tenant_id || chr(31) || CAST(day AS VARCHAR)) AS report_key, alerts FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.tenant_id = d.tenant_id AND e.day = d.day AND day < DATE '2024-07-01')""")
def reports_to_write(spark: SparkSession, root: str) -> DataFrame:
    """Daily reports that aren't written yet: all from the second half on."""
    rows = table(spark, root, "alert_messages").filter("received_at is not null and tenant_id is not null").groupBy("tenant_id", F.to_date("received_at").alias("day")).agg(F.count("*").alias("alerts"))
    keyed = rows.withColumn("report_key", H.idempotency_key(F.col("tenant_id"), F.col("day")))
    written = keyed.filter("day < date'2024-07-01'").select("report_key")
    return keyed.join(written, "report_key", "left_anti").select("report_key", "alerts")


@query("""SELECT message_id, CAST(floor(least(30000, 500 * pow(2, greatest(0, attempt)))) AS BIGINT) AS low_ms, true AS inside FROM crawl_jobs WHERE attempt IS NOT NULL""")
def retry_delays(spark: SparkSession, root: str) -> DataFrame:
    """Delay of each retry without its jitter, and whether the whole stays within a fifth above it."""
    low = F.least(F.lit(30_000.0), 500 * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("attempt")))).cast("bigint")
    delay = H.retry_delay(F.col("attempt"), F.col("message_id").cast("string"))
    return table(spark, root, "crawl_jobs").filter("attempt is not null").select("message_id", low.alias("low_ms"), ((delay >= low) & (delay <= low * 1.2)).alias("inside"))


@query("""SELECT discovery_id, rtrim(translate(to_base64(unhex(sha256(lower(trim(coalesce(author, '') || '@Mail.Example'))))), '+/', '-_'), '=') AS shard, CASE WHEN discovery_id % 2 = 0 THEN '/v1/x' ELSE '/' END AS path FROM discoveries""")
def author_shards(spark: SparkSession, root: str) -> DataFrame:
    """Shard names of authors' addresses, and paths without their prefix."""
    path = F.when(F.col("discovery_id") % 2 == 0, "/api/v1/x").otherwise("/api")
    return table(spark, root, "discoveries").select("discovery_id", H.user_shard(F.concat(F.coalesce("author", F.lit("")), F.lit("@Mail.Example"))).alias("shard"), U.strip_api_prefix(path).alias("path"))


# ------------------------------------------------------------------ near texts and stories by stored fingerprints

_STORED_CTE = """s AS (SELECT cand_id, monitor_id, received_at, CAST(('0x' || substr(simhash, 1, 8)) AS BIGINT) AS hi, CAST(('0x' || substr(simhash, 9, 8)) AS BIGINT) AS lo FROM ai_candidates WHERE regexp_matches(simhash, '^[0-9a-f]{16}$') AND simhash <> '0000000000000000'),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id ORDER BY received_at DESC NULLS LAST, cand_id DESC) AS k FROM s) WHERE k <= 200)"""


def stored_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    hi, lo = H.limbs(F.col("simhash"))
    rows = table(spark, root, "ai_candidates").filter(F.col("simhash").rlike("^[0-9a-f]{16}$") & (F.col("simhash") != "0" * 16))
    return rows.select("cand_id", "monitor_id", "title", "received_at", hi.alias("sim_hi"), lo.alias("sim_lo"))


@query(f"""WITH {_STORED_CTE}, n AS (SELECT q.cand_id AS query_id, t.cand_id, t.received_at, bit_count(xor(q.hi, t.hi)) + bit_count(xor(q.lo, t.lo)) AS distance FROM s q JOIN t ON t.monitor_id = q.monitor_id AND t.cand_id <> q.cand_id WHERE q.cand_id % 50 = 0)
SELECT query_id, cand_id, CAST(distance AS BIGINT) AS distance, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, received_at DESC NULLS LAST, cand_id) AS place FROM n WHERE distance <= 8) WHERE place <= 20""")
def near_of_latest(spark: SparkSession, root: str) -> DataFrame:
    """The twenty nearest of each monitor's latest two hundred candidates to every fiftieth one: both bounds are the feature."""
    rows = stored_fingerprints(spark, root)
    latest = D.top_per(rows, [F.col("monitor_id")], [F.col("received_at").desc_nulls_last(), F.desc("cand_id")], folds.NEAR_LOOK_BACK)
    asked = rows.filter("cand_id % 50 = 0").select(F.col("cand_id").alias("query_id"), "monitor_id", F.col("sim_hi").alias("qh"), F.col("sim_lo").alias("ql"))
    distance = H.hamming(F.col("qh"), F.col("ql"), F.col("sim_hi"), F.col("sim_lo"))
    met = asked.join(latest, "monitor_id").filter("query_id <> cand_id").withColumn("distance", distance.cast("bigint")).filter(F.col("distance") <= D.clamp_threshold(8))
    place = D.top_per(met, [F.col("query_id")], [F.col("distance"), F.col("received_at").desc_nulls_last(), F.col("cand_id")], 20, place="place")
    return place.select("query_id", "cand_id", "distance", "place")


@query()
def kept_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Candidates left when those near one of their monitor's last two hundred are dropped, in order of arrival."""
    return folds.drop_near(stored_fingerprints(spark, root).filter("monitor_id is not null"), "monitor_id", ["received_at", "cand_id"], "cand_id")


@query()
def candidate_stories(spark: SparkSession, root: str) -> DataFrame:
    """Story of each candidate among its monitor's last fifty, in order of arrival."""
    return folds.assign_stories(stored_fingerprints(spark, root).filter("monitor_id is not null"), "monitor_id", ["received_at", "cand_id"], "cand_id")


# ------------------------------------------------------------------ lists


@query("SELECT message_id, CAST(epoch_us(received_at) AS BIGINT) AS received_us FROM crawl_jobs ORDER BY received_at DESC NULLS LAST, message_id DESC LIMIT 200")
def audit_tail(spark: SparkSession, root: str) -> DataFrame:
    """The latest two hundred entries of a log: a top-k report."""
    rows = table(spark, root, "crawl_jobs").orderBy(F.col("received_at").desc_nulls_last(), F.desc("message_id")).limit(200)
    return rows.select("message_id", F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us"))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(source, 'unknown')) AS place FROM normalized_content GROUP BY 1")
def sources_by_count(spark: SparkSession, root: str) -> DataFrame:
    """Sources in order of their contents; there are few of them after the sum."""
    rows = table(spark, root, "normalized_content").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    return D.top_per(rows, [], [F.desc("n"), F.col("source")], 1 << 30, place="place").select("source", "n", "place")


@query("SELECT tenant_id, monitor_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC NULLS LAST, monitor_id) AS newest, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at NULLS LAST, monitor_id) AS oldest FROM monitors WHERE status = 'active' AND raw_query IS NOT NULL")
def ordered_monitors(spark: SparkSession, root: str) -> DataFrame:
    """Each tenant's monitors with a query that is on, in both orders."""
    rows = table(spark, root, "monitors").filter("status = 'active' and raw_query is not null").select("tenant_id", "monitor_id", "created_at")
    rows = D.top_per(rows, [F.col("tenant_id")], [F.col("created_at").desc_nulls_last(), F.col("monitor_id")], 1 << 30, place="newest")
    return D.top_per(rows, [F.col("tenant_id")], [F.col("created_at").asc_nulls_last(), F.col("monitor_id")], 1 << 30, place="oldest").select("tenant_id", "monitor_id", "newest", "oldest")


@query("""WITH h AS (SELECT source, CASE WHEN count(*) FILTER (http_status BETWEEN 200 AND 299) < 0.5 * count(*) THEN 'disabled' WHEN count(*) FILTER (http_status BETWEEN 200 AND 299) < 0.97 * count(*) THEN 'degraded' ELSE 'available' END AS state FROM raw_content GROUP BY source)
SELECT count(*) AS total, count(*) FILTER (state NOT IN ('degraded', 'disabled', 'contract_required')) AS available FROM h""")
def available_sources(spark: SparkSession, root: str) -> DataFrame:
    """How many sources are available: neither degraded nor disabled."""
    ok = F.count_if(F.col("http_status").between(200, 299))
    state = F.when(ok < 0.5 * F.count("*"), "disabled").when(ok < 0.97 * F.count("*"), "degraded").otherwise("available")
    return table(spark, root, "raw_content").groupBy("source").agg(state.alias("state")).agg(F.count("*").alias("total"), F.count_if(~F.col("state").isin("degraded", "disabled", "contract_required")).alias("available"))


@query("""SELECT c.norm_id, count(*) AS monitors FROM normalized_content c JOIN ai_candidates k ON k.content_id = c.content_id JOIN monitors m ON m.monitor_id = k.monitor_id JOIN raw_content r ON r.raw_id = c.raw_id WHERE m.status = 'active' GROUP BY c.norm_id""")
def monitored_contents(spark: SparkSession, root: str) -> DataFrame:
    """Contents with their page, joined to the active monitors that found them."""
    active = table(spark, root, "monitors").filter("status = 'active'").select("monitor_id")
    found = table(spark, root, "ai_candidates").select("content_id", "monitor_id").join(active, "monitor_id").groupBy("content_id").agg(F.count("*").alias("n"))
    pages = table(spark, root, "raw_content").select("raw_id")
    rows = table(spark, root, "normalized_content").select("norm_id", "raw_id", "content_id").join(pages, "raw_id").join(found, "content_id")
    return rows.groupBy("norm_id").agg(F.sum("n").alias("monitors"))


@query(f"""WITH t AS (SELECT cand_id, trim(regexp_replace({R._rules_sql('title', T.HIDDEN_RULES, T.TAG_RULES, T.ENTITY_RULES)}, '{R._SPACE_SQL}+', ' ', 'g')) AS line FROM (SELECT cand_id, '<b>' || coalesce(title, '') || '</b> &amp; more<script>x</script>' AS title FROM ai_candidates))
SELECT cand_id, CASE WHEN line = '' THEN NULL WHEN length(line) <= 40 THEN line ELSE rtrim(substr(line, 1, 39)) || '…' END AS shown FROM t""")
def display_titles(spark: SparkSession, root: str) -> DataFrame:
    """Titles as they are shown: on one line, without markup, of a bounded length."""
    title = F.concat(F.lit("<b>"), F.coalesce("title", F.lit("")), F.lit("</b> &amp; more<script>x</script>"))
    return table(spark, root, "ai_candidates").select("cand_id", T.display_title(title, 40).alias("shown"))


@query("SELECT DISTINCT tenant_id FROM monitors WHERE starts_with(tenant_id, 'tenant-t')")
def tenants_by_prefix(spark: SparkSession, root: str) -> DataFrame:
    """Tenants of a registry whose keys begin alike."""
    return table(spark, root, "monitors").filter(F.col("tenant_id").startswith("tenant-t")).select("tenant_id").distinct()
