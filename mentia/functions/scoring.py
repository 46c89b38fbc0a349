"""Lexical sentiment, severity, relevance and virality as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mentia.functions.text import contains_any, count_terms

# Terms of the lexical classifier and of the fast lane, added severity by risk category.
NEGATIVE_TERMS = ["scam", "fraud", "lừa đảo", "không hoàn tiền", "chưa hoàn tiền", "tố cáo", "khiếu nại", "data leak", "breach", "tẩy chay", "outage"]
POSITIVE_TERMS = ["tốt", "tuyệt vời", "excellent", "great", "recommend", "hài lòng", "cam on", "cảm ơn"]
RISK_TERMS = {
    "fraud": ["scam", "lừa đảo", "fraud"],
    "data_leak": ["data leak", "breach", "rò rỉ dữ liệu"],
    "refund": ["hoàn tiền", "refund"],
    "outage": ["outage", "sập"],
}
FAST_LANE_TERMS = [
    "scam", "fraud", "lừa đảo", "lua dao", "không hoàn tiền", "chưa hoàn tiền", "refund", "tố cáo", "bóc phốt", "boc phot", "khiếu nại",
    "khieu nai", "data leak", "rò rỉ dữ liệu", "breach", "boycott", "tẩy chay", "lawsuit", "khởi kiện", "sập", "outage",
]
RISK_BOOSTS = {
    "fraud": 25, "scam": 25, "legal": 20, "security_incident": 25, "data_leak": 30, "physical_safety": 30, "executive_misconduct": 20,
    "outage": 15, "boycott": 15, "media_investigation": 20, "refund": 10, "customer_service": 5,
}


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def between(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def fallback_sentiment(low: Column, negative: list[str] = NEGATIVE_TERMS, positive: list[str] = POSITIVE_TERMS) -> Column:
    """Sentiment of a lower-case text by the larger number of terms met; a tie is neutral."""
    n, p = count_terms(low, negative), count_terms(low, positive)
    return F.when(n > p, "negative").when(p > n, "positive").otherwise("neutral")


def fallback_confidence(sentiment: Column) -> Column:
    return F.when(sentiment == "neutral", 0.45).otherwise(0.62)


def risk_categories(low: Column, terms: dict[str, list[str]] = RISK_TERMS) -> Column:
    """Categories whose terms a lower-case text has, in the order of the table."""
    return F.array_compact(F.array(*(F.when(contains_any(low, words), F.lit(name)) for name, words in terms.items())))


def fast_lane(low: Column, priority: Column, terms: list[str] = FAST_LANE_TERMS) -> Column:
    """``priority`` where the text hints at harm, else the priority given."""
    return F.when(contains_any(low, terms), F.lit("priority")).otherwise(priority)


def relevance(low: Column, name: Column, matched: Column) -> Column:
    """85, 10 more where the monitor's name occurs, 5 more for several matching queries, at most 100."""
    named = F.coalesce(F.contains(low, F.lower(name)), F.lit(False))
    return F.least(F.lit(100), F.lit(85) + F.when(named, 10).otherwise(0) + F.when(matched > 1, 5).otherwise(0))


def severity(sentiment: Column, confidence: Column, relevance: Column, risks: Column, engagement: Column | None = None, virality: Column | None = None) -> Column:
    """0 to 100, 0 unless negative. Null risks are none; null engagement and virality add nothing."""
    boosts = F.create_map(*(F.lit(x) for pair in RISK_BOOSTS.items() for x in pair))
    risk = F.coalesce(F.aggregate(F.array_distinct(risks), F.lit(0), lambda acc, c: acc + F.coalesce(F.element_at(boosts, c), F.lit(0))), F.lit(0))
    score = 25 + between(confidence, 0.0, 1.0) * 25 + between(relevance, 0.0, 100.0) / 100 * 10 + risk
    if engagement is not None:
        score = score + F.coalesce(between(engagement / 10, 0.0, 10.0), F.lit(0.0))
    if virality is not None:
        score = score + F.coalesce(between(virality / 6.67, 0.0, 15.0), F.lit(0.0))
    return F.when(sentiment == "negative", round_half_up(between(score, 0.0, 100.0))).otherwise(F.lit(0).cast("bigint"))


def band(score: Column) -> Column:
    return F.when(score >= 76, "critical").when(score >= 51, "high").when(score >= 26, "medium").otherwise("low")


def virality(likes: Column, comments: Column, shares: Column, views: Column, age_minutes: Column) -> Column:
    """0 to 100 from weighted engagement an hour on a log scale. Null and negative metrics are missing; all missing is 0."""
    usable = lambda x: F.when((x >= 0) & ~F.isnan(x.cast("double")), x.cast("double"))
    weights = ((usable(likes), 1.0), (usable(comments), 3.0), (usable(shares), 5.0), (usable(views), 0.05))
    total = sum((F.coalesce(x, F.lit(0.0)) * w for x, w in weights), F.lit(0.0))
    met = sum((x.isNotNull().cast("int") for x, _ in weights), F.lit(0))
    hourly = total / F.greatest(F.lit(1.0), F.coalesce(age_minutes.cast("double"), F.lit(1.0))) * 60
    return F.when(met > 0, round_half_up(between(F.log10(1 + hourly) / F.log10(F.lit(2001.0)) * 100, 0.0, 100.0))).otherwise(F.lit(0).cast("bigint"))


def cluster_gate(severity: Column, virality: Column, members: Column) -> Column:
    """Whether a story of several mentions, or one that spreads, is material."""
    return (severity >= 50) & (((members >= 3) & (severity >= 60)) | ((virality >= 70) & (severity >= 55)) | ((members >= 2) & (virality >= 40) & (severity >= 60)))


def fetch_quality(content_type: Column, html: Column, title: Column, text: Column, ratio: Column) -> Column:
    """How well a page was read: 0 to 100 for HTML, 100 or 50 by length for other types."""
    points = F.when(F.coalesce(title, F.lit("")) != "", 20).otherwise(0) + F.when(F.length(text) >= 300, 40).otherwise(0) + F.when(F.length(text) >= 1000, 20).otherwise(0) + F.when(ratio < 0.35, 20).otherwise(0)
    return F.when(F.contains(F.lower(content_type), F.lit("html")), points).when(F.length(html) >= 100, 100).otherwise(50)
