"""Links of mails: extraction, scoring, patterns, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions import links as lk
from mailquarry.functions.text import add, cap, flags, has, mentions, texts
from mailquarry.plans.skew import spread_join

STATIC_WEIGHTS = {"length_score": 0.2, "domain_score": 0.4, "path_score": 0.3, "parameter_score": 0.1}
MALICIOUS_ABOVE = 0.7


def extract_links(emails: DataFrame) -> DataFrame:
    """One row per (mail, url), first-seen order; trailing punctuation removed."""
    # the outer form keeps the optimiser from testing the array, and so extracting it, a second time
    return emails.select("message_id", F.posexplode_outer(link_list()).alias("pos", "url")).filter("url is not null")


def link_list():
    """The distinct links of a body as an array."""
    found = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(lk.LINK), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;!?]+$", "")))


def score_static(links: DataFrame) -> DataFrame:
    """Adds host and the structural scores; a pure row-wise projection."""
    url, host = F.col("url"), F.col("domain")
    parts = links.withColumns({"domain": lk.authority(url), "_path": lk.path(url), "_query": lk.query(url)})
    scored = parts.withColumn("_best", lk.brand_similarity(host)).withColumns({
        "unparsable": lk.unparsable(host),
        "length_score": lk.length_score(url),
        "domain_score": lk.domain_score(url, host, F.col("_best")),
        "path_score": lk.path_score(F.col("_path")),
        "parameter_score": F.when(F.col("_query") == "", F.lit(0.0)).otherwise(lk.query_score(F.col("_query"))),
    })
    return scored.withColumn(
        "static_score", add([F.col(c) * F.lit(w) for c, w in STATIC_WEIGHTS.items()])).drop("_path", "_query", "_best")


def typosquat_candidates(links: DataFrame) -> DataFrame:
    """Distinct hosts with the closest known domain, its similarity and the resulting score."""
    hosts = links.select(lk.authority(F.col("url")).alias("domain")).distinct()
    pairs = hosts.select("domain", F.explode(texts(lx.LEGITIMATE_DOMAINS)).alias("brand"))
    scored = pairs.withColumn("similarity", lk.similarity(
        lk.first_label(F.col("domain")), lk.first_label(F.col("brand"))))
    best = scored.groupBy("domain").agg(
        F.max("similarity").alias("best_similarity"),
        F.min_by("brand", F.struct(-F.col("similarity"), F.col("brand"))).alias("closest_brand"))
    return best.withColumn("typosquat_score", lk.typosquat_score(F.col("best_similarity")))


def merge_verdicts(verdicts: DataFrame, key: str) -> DataFrame:
    """Vendor verdicts (key, vendor, reputation_score, is_malicious, threat_types) to one row per key."""
    # one row per vendor first, so that repeated feeds cannot make a large group
    per_vendor = verdicts.groupBy(key, "vendor").agg(
        F.max(F.struct("reputation_score", "is_malicious", "threat_types")).alias("v")
    ).select(key, "vendor", "v.*")
    return per_vendor.groupBy(key).agg(
        F.count(F.lit(1)).alias("vendors"),
        F.avg(1 - F.col("reputation_score")).alias("vendor_score"),
        F.sum("reputation_score").alias("reputation_sum"),
        F.max(F.when(F.col("vendor") == "scan", 1 - F.col("reputation_score"))).alias("scan_score"),
        F.max(F.when(F.col("vendor") == "host", 1 - F.col("reputation_score"))).alias("host_score"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(
            F.when(F.col("is_malicious"), F.col("threat_types")))))).alias("threat_types"),
    )


def join_reputation(links: DataFrame, verdicts: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Links with the vendor verdicts of their URL; vendors may be missing.

    ``hot`` (see ``hot_keys``) spreads very frequent URLs over many tasks; without it the
    adaptive skew join splits them.
    """
    merged = merge_verdicts(verdicts, "url")
    joined = links.join(merged, "url", "left") if hot is None else spread_join(links, merged, ["url"], hot)
    return joined.withColumn("vendors", F.coalesce("vendors", F.lit(0))).withColumn(
        "threat_types", F.coalesce("threat_types", F.array().cast("array<string>")))


def score_links(links: DataFrame, verdicts: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Threat score per (mail, url): structure alone, or 40 % structure and 60 % reputation."""
    joined = join_reputation(score_static(links), verdicts, hot)
    combined = F.when(
        F.col("vendors") > 0, F.col("static_score") * 0.4 + F.col("vendor_score") * 0.6
    ).otherwise(F.col("static_score"))
    scored = joined.withColumn(
        "threat_score", F.when(F.col("unparsable"), F.lit(0.5)).otherwise(cap(combined)))
    malicious = ~F.col("unparsable") & (F.col("threat_score") > MALICIOUS_ABOVE)
    return scored.withColumn("is_malicious", malicious).withColumn(
        "reputation_category",
        F.when(F.col("is_malicious"), "MALICIOUS")
        .when(F.col("threat_score") < 0.3, "CLEAN").otherwise("SUSPICIOUS"))


def _pattern_flags():
    # fixed pattern names
    lowered = F.lower("url")
    return flags(
        (has(lowered, "secure") & has(lowered, "update"), "Fake security update URL"),
        (mentions(lowered, lx.URL_BRANDS) & ~F.col("domain").isin(lx.LEGITIMATE_DOMAINS),
         "Brand impersonation URL"),
        (F.col("domain_score") > 0.7, "Suspicious domain structure"),
        (F.size("threat_types") > 2, "Multiple threat indicators"),
    )


def link_patterns(scored: DataFrame) -> DataFrame:
    """Distinct (mail, pattern) rows."""
    return scored.select("message_id", F.explode(_pattern_flags()).alias("pattern")).distinct()


def rollup_links(scored: DataFrame) -> DataFrame:
    """One row per mail: counts, average score, set of patterns (at most four values)."""
    return scored.withColumn("patterns", _pattern_flags()).groupBy("message_id").agg(
        F.count(F.lit(1)).alias("url_count"),
        cap(F.avg("threat_score")).alias("url_score"),
        F.count_if("is_malicious").alias("malicious_urls"),
        F.max(F.size("threat_types")).alias("most_threat_types"),
        F.array_compact(F.array(*[
            F.when(F.max(F.array_contains("patterns", p).cast("int")) > 0, F.lit(p))
            for p in ("Brand impersonation URL", "Fake security update URL",
                      "Multiple threat indicators", "Suspicious domain structure")
        ])).alias("patterns"),
    )


def malicious_links(scored: DataFrame) -> DataFrame:
    """The malicious URLs of each mail, one row each."""
    return scored.filter("is_malicious").select("message_id", "url").distinct()


def reputation_summary(scored: DataFrame) -> DataFrame:
    """Counts of checked, malicious, clean and unknown links and the mean vendor reputation."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_checked"),
        F.count_if("is_malicious").alias("malicious_count"),
        F.count_if(~F.col("is_malicious") & (F.col("threat_score") < 0.3)).alias("clean_count"),
        F.count_if(~F.col("is_malicious") & (F.col("threat_score") >= 0.3)).alias("unknown_count"),
        F.coalesce(F.try_divide(F.sum("reputation_sum"), F.sum("vendors")), F.lit(0.0))
        .alias("avg_reputation_score"),
    )


def link_facts(scored: DataFrame, analyzed_at) -> DataFrame:
    """Rows of the URL fact table; vendor columns hold 1 - reputation."""
    return scored.select(
        F.col("message_id").alias("email_analysis_id"), "url", "domain",
        F.col("scan_score").alias("virustotal_score"), F.col("host_score").alias("urlvoid_score"),
        "is_malicious", "threat_types", "reputation_category", analyzed_at.alias("analyzed_at"))
