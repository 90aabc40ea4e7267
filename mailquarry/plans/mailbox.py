"""The whole scoring plan: mails and verdict tables in, one judged row per mail out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions.text import mentions
from mailquarry.operators import attachments, content, ensemble, features, headers, urls
from mailquarry.sinks.facts import staged

KEPT = ["message_id", "sender", "recipients", "subject", "received_at"]
TEXT = ["urgent_words_count", "suspicious_words_count", "financial_words_count"]


def scan_mails(mails: DataFrame, as_of: Column) -> DataFrame:
    """One row-wise pass over bodies and headers: term counts, header parts, links, addresses."""
    passed = [*KEPT, urls.link_list().alias("links"), "headers"]
    read = content.with_content_features(mails, passed).select(*KEPT, "links", "headers", *TEXT)
    return headers.with_header_parts(read.withColumn("addresses", headers.address_list()), as_of)


def score_mailbox(mails: DataFrame, files: DataFrame, url_verdicts: DataFrame, file_verdicts: DataFrame,
                  geo: DataFrame, predictions: DataFrame, as_of: Column, stage: bool = False,
                  hot_urls: DataFrame | None = None, hot_files: DataFrame | None = None) -> DataFrame:
    """Judge every mail.

    Bodies, header arrays and file bytes stay in the scan stages; only scores, counts, links and
    addresses are shuffled, always by message id. The scan feeds three branches. Without ``stage``
    each branch reads the columns it needs; with ``stage`` the narrow scan result is written once
    to the shared folder, so a large mailbox is read a single time and a lost executor does not
    repeat the body scan. ``hot_urls`` and ``hot_files`` (see ``hot_keys``; the fact tables of
    earlier runs know them) spread very common links and files; without them the adaptive join does.
    """
    scan = scan_mails(mails, as_of)
    if stage:
        scan = staged(scan, "mail_scan")
    # outer forms: an inner explode makes the optimiser compute the arrays twice
    found = scan.select("message_id", F.explode_outer("links").alias("url")).filter("url is not null")
    addresses = scan.select("message_id", F.inline_outer("addresses")).filter("ip is not null")

    link_part = urls.score_links(found, url_verdicts, hot_urls).groupBy("message_id").agg(
        *features.url_aggregates(), F.avg("threat_score").alias("url_score"),
        F.count_if("is_malicious").alias("malicious_urls")
    ).select("message_id", "url_count", F.least("url_score", F.lit(1.0)).alias("url_score"),
             "malicious_urls", "suspicious_domains")

    suffix = F.lower(F.coalesce("filename", F.lit("")))
    file_part = attachments.score_files(files, file_verdicts, hot=hot_files).groupBy("message_id").agg(
        F.count(F.lit(1)).alias("attachment_count"),
        F.least(F.avg("threat_score"), F.lit(1.0)).alias("attachment_score"),
        F.count_if("is_malware").alias("malicious_files"),
        F.count_if(mentions(suffix, lx.FEATURE_SUSPICIOUS_EXTENSIONS)).alias("suspicious_extensions"))

    own = headers.finish_scores(scan.drop("links", "addresses"), addresses, geo).select(
        *KEPT, *TEXT, "header_score", "spf_result", "dkim_result", "dmarc_result", "sender_country",
        "return_path_mismatch", "warnings")

    joined = ensemble.join_components(own, link_part, file_part, ensemble.soft_average(predictions))
    counted = joined.withColumns({
        c: F.coalesce(c, F.lit(0)) for c in ("suspicious_domains", "suspicious_extensions")})
    judged = ensemble.verdict(counted)
    return judged.withColumns({
        "threat_category": ensemble.category(),
        "threats": ensemble.threat_types(),
        "recommendations": ensemble.recommendation_list(),
    })
