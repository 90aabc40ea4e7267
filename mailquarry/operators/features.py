"""Numeric features per mail: links, headers, attachments and the full vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions import links as lk
from mailquarry.functions.text import mentions

CONTENT = [
    "text_length", "word_count", "sentence_count", "avg_word_length", "urgent_words_count",
    "suspicious_words_count", "financial_words_count", "brand_words_count", "spelling_errors",
    "grammar_errors", "html_tag_count", "hidden_text", "suspicious_css", "all_caps_ratio",
    "exclamation_count", "question_count", "positive_words", "negative_words",
]
URL = [
    "url_count", "avg_url_length", "max_url_length", "suspicious_domains", "url_shorteners",
    "ip_addresses", "suspicious_tlds", "url_redirects",
]
HEADER = [
    "spf_pass", "dkim_pass", "dmarc_pass", "sender_reputation", "hop_count",
    "suspicious_routing", "timestamp_anomalies", "high_risk_country",
]
ATTACHMENT = [
    "has_attachments", "attachment_count", "suspicious_extensions", "executable_attachments",
    "large_attachments", "total_attachment_size",
]
ALL = CONTENT + URL + HEADER + ATTACHMENT


def url_aggregates() -> list[Column]:
    """Feature aggregates over the links of a mail; needs only the url column."""
    url = F.col("url")
    host = lk.authority(url)
    return [
        F.count(F.lit(1)).alias("url_count"), F.avg(F.length(url)).alias("avg_url_length"),
        F.max(F.length(url)).alias("max_url_length"),
        F.count_if(lk.looks_suspicious(host)).alias("suspicious_domains"),
        F.count_if(mentions(host, lx.FEATURE_SHORTENERS)).alias("url_shorteners"),
        F.count_if(lk.is_ipv4(host)).alias("ip_addresses"),
        F.count_if(mentions(F.lower(url), lx.FEATURE_TLDS)).alias("suspicious_tlds"),
        F.lit(0).alias("url_redirects"),
    ]


def url_features(links: DataFrame) -> DataFrame:
    return links.groupBy("message_id").agg(*url_aggregates())


def header_features(scored: DataFrame) -> DataFrame:
    """From the header scores; results compare without regard to case."""
    def passed(column: str) -> Column:
        return (F.lower(column) == "pass").cast("int")

    return scored.select(
        "message_id", passed("spf_result").alias("spf_pass"), passed("dkim_result").alias("dkim_pass"),
        passed("dmarc_result").alias("dmarc_pass"), F.lit(0.5).alias("sender_reputation"), "hop_count",
        F.col("suspicious_routing").cast("int").alias("suspicious_routing"),
        F.col("timestamp_anomalies").cast("int").alias("timestamp_anomalies"),
        F.coalesce(F.col("sender_country").isin(lx.FEATURE_HIGH_RISK_COUNTRIES), F.lit(False)).cast("int")
        .alias("high_risk_country"))


def all_features(content: DataFrame, url: DataFrame, header: DataFrame, attachment: DataFrame) -> DataFrame:
    """The four parts side by side; parts a mail does not have count as 0."""
    joined = content.join(url, "message_id", "left").join(header, "message_id", "left").join(
        attachment, "message_id", "left")
    return joined.select("message_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ALL])
