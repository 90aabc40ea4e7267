"""Classifier averaging, the combined verdict, categories, recommendations and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions.text import cap, flags
from mailquarry.plans.skew import small

COMPONENT_WEIGHTS = {"content_score": 0.25, "url_score": 0.30, "attachment_score": 0.25, "header_score": 0.20}
RULE_SHARE, MODEL_SHARE = 0.6, 0.4


def level(score: Column) -> Column:
    return (F.when(score >= 0.9, "CRITICAL").when(score >= 0.7, "HIGH")
            .when(score >= 0.5, "MEDIUM").otherwise("LOW"))


def soft_average(predictions: DataFrame, threshold: float = lx.CONFIDENCE_THRESHOLD,
                 weights: list[float] | None = None) -> DataFrame:
    """Per mail: the ensemble model's probability, else the weighted mean of the other models.

    Weights go by the rank of a model among those that answered. ``model_mean`` is the plain
    mean used by the verdict; an ensemble row that failed counts there as undecided.
    """
    weights = weights or lx.MODEL_WEIGHTS
    answered = F.col("error").isNull()

    def probability(model: str) -> Column:
        return F.max(F.when(answered & (F.col("model_name") == model), F.col("probability")))

    grouped = predictions.groupBy("message_id").agg(
        probability("ensemble").alias("ensemble"),
        F.max((F.col("model_name") == "ensemble").cast("int")).alias("has_ensemble"),
        F.avg(F.when(answered, F.col("probability"))).alias("plain_mean"),
        *[probability(m).alias(m) for m in lx.MODEL_PRIORITY])
    available = F.slice(F.array_compact(F.array(*lx.MODEL_PRIORITY)), 1, len(weights))
    used = F.slice(F.array(*[F.lit(w) for w in weights]), 1, F.size("available"))
    total = F.aggregate(F.zip_with("available", "used", lambda p, w: p * w), F.lit(0.0), lambda a, x: a + x)
    weight = F.aggregate("used", F.lit(0.0), lambda a, x: a + x)
    averaged = grouped.withColumn("available", available).withColumn("used", used).withColumn(
        "probability", F.coalesce("ensemble", F.try_divide(total, weight), F.lit(0.5)))
    decided = F.col("ensemble").isNotNull()
    nothing = ~decided & (F.size("available") == 0)
    return averaged.select(
        "message_id", "probability",
        F.when(decided, F.col("probability") > 0.5).when(nothing, F.lit(False))
        .otherwise(F.col("probability") > threshold).alias("prediction"),
        F.when(nothing, F.lit(0.0)).otherwise(F.abs(F.col("probability") - 0.5) * 2).alias("confidence"),
        F.when(decided, "ensemble_model").when(nothing, "none").otherwise("weighted_average").alias("method"),
        F.when(F.col("has_ensemble") == 1, F.coalesce("ensemble", F.lit(0.5)))
        .otherwise(F.coalesce("plain_mean", F.lit(0.5))).alias("model_mean"))


def join_components(mails: DataFrame, links: DataFrame, files: DataFrame, models: DataFrame) -> DataFrame:
    """Roll-ups side by side per mail, which already carries its header score.

    A missing link or file part scores 0, a missing classifier .5.
    """
    joined = (
        mails.join(links, "message_id", "left").join(files, "message_id", "left")
        .join(models.select("message_id", F.col("probability").alias("content_score"), "model_mean"), "message_id", "left")
    )
    return joined.withColumns({
        "has_classifier": F.col("model_mean").isNotNull(),
        "content_score": F.coalesce("content_score", F.lit(0.5)),
        "model_mean": F.coalesce("model_mean", F.lit(0.5)),
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("url_score", "attachment_score", "header_score")},
        **{c: F.coalesce(c, F.lit(0)) for c in ("url_count", "malicious_urls", "attachment_count", "malicious_files")},
    })


def verdict(components: DataFrame, threshold: float = lx.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Adds the combined score, the phishing flag and the level."""
    rules = sum((F.col(c) * F.lit(w) for c, w in COMPONENT_WEIGHTS.items()), F.lit(0.0))
    scored = components.withColumn("threat_score", cap(rules * RULE_SHARE + F.col("model_mean") * MODEL_SHARE))
    return scored.withColumn("is_phishing", F.col("threat_score") > threshold).withColumn(
        "threat_level", level(F.col("threat_score")))


def category() -> Column:
    """Category of a mail from its features when a classifier answered, else from its parts."""
    with_model = (
        F.when(F.col("content_score") < 0.5, "LEGITIMATE")
        .when(F.col("financial_words_count") > 2, "FINANCIAL_SCAM")
        .when(F.col("urgent_words_count") > 3, "PHISHING")
        .when(F.col("suspicious_extensions") > 0, "MALWARE")
        .when(F.col("suspicious_domains") > 0, "PHISHING").otherwise("SPAM"))
    without = (
        F.when(F.col("malicious_files") > 0, "MALWARE").when(F.col("malicious_urls") > 0, "PHISHING")
        .when(F.col("url_score") > 0.7, "PHISHING").when(F.col("content_score") > 0.5, "PHISHING")
        .otherwise("LEGITIMATE"))
    return F.when(F.col("has_classifier"), with_model).otherwise(without)


def recommendation_list() -> Column:
    """Advice texts in order; needs the verdict columns."""
    phishing, score = F.col("is_phishing"), F.col("threat_score")
    bad_url, bad_file = F.col("malicious_urls") > 0, F.col("malicious_files") > 0
    bad_header, high = F.col("header_score") > 0.7, score > 0.8
    medium = ~high & (score > 0.5)
    # fixed texts
    return flags(
        (phishing, "QUARANTINE: Move email to quarantine folder immediately"),
        (phishing, "ALERT: Notify recipient about potential phishing attempt"),
        (bad_url, "BLOCK: Block access to malicious URLs"),
        (bad_url, "SCAN: Perform additional URL reputation checks"),
        (bad_file, "ISOLATE: Quarantine malicious attachments"),
        (bad_file, "SCAN: Perform deep malware analysis"),
        (bad_header, "VERIFY: Verify sender authenticity through alternative channels"),
        (bad_header, "INVESTIGATE: Review email routing and authentication failures"),
        (high, "ESCALATE: Report to security team for investigation"),
        (high, "EDUCATE: Provide phishing awareness training to recipient"),
        (medium, "MONITOR: Increase monitoring for similar threats"),
        (medium, "CAUTION: Advise recipient to exercise caution"),
    )


def recommendations(judged: DataFrame) -> DataFrame:
    """(mail, position, text) rows."""
    return judged.select("message_id", F.posexplode(recommendation_list()).alias("position", "text"))


def sender_domain(address: Column) -> Column:
    """Part after the last @, in lower case."""
    return F.lower(F.substring_index(address, "@", -1))


def whitelist_table(spark, domains: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(d,) for d in (domains or lx.WHITELIST_DOMAINS)], "domain string")


def mark_whitelisted(mails: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Adds ``whitelisted``; the list is broadcast while it is counted small."""
    listed = small(whitelist.select(F.col("domain").alias("_domain"), F.lit(True).alias("_listed")).distinct())
    return mails.join(listed, sender_domain(F.col("sender")) == F.col("_domain"), "left").withColumn(
        "whitelisted", F.coalesce("_listed", F.lit(False))).drop("_domain", "_listed")


def not_whitelisted(mails: DataFrame, whitelist: DataFrame) -> DataFrame:
    """The mails that still need scoring."""
    listed = small(whitelist.select(F.col("domain").alias("_domain")).distinct())
    return mails.join(listed, sender_domain(F.col("sender")) == F.col("_domain"), "left_anti")


def threat_types() -> Column:
    """Kinds of threat found in a mail."""
    return flags(
        (F.col("is_phishing"), "phishing_attempt"),
        (F.col("malicious_urls") > 0, "malicious_url"),
        (F.col("malicious_files") > 0, "malicious_attachment"),
        (F.coalesce("return_path_mismatch", F.lit(False)), "spoofed_sender"),
        ((F.col("urgent_words_count") > 0) | (F.col("financial_words_count") > 2), "social_engineering"),
    )


def workflow_action(mails: DataFrame) -> DataFrame:
    """Risk level and final action; needs whitelisted, threat_score and threats."""
    score = F.col("threat_score")
    found = F.when(score >= 0.7, "high").when(score >= 0.3, "medium").otherwise("low")
    many = F.size("threats") > 2
    return mails.withColumns({
        "risk_score": F.when(F.col("whitelisted"), F.lit(0.0)).otherwise(score),
        "risk_level": F.when(F.col("whitelisted"), "low").otherwise(found),
        "action": F.when(F.col("whitelisted"), "release").when(score >= 0.7, "quarantine")
        .when(many, "quarantine").otherwise("release"),
    })


def workflow_summary(decided: DataFrame) -> DataFrame:
    """Counts by outcome and the rates in percent of all mails."""
    open_ = ~F.col("whitelisted")
    counted = decided.agg(
        F.count(F.lit(1)).alias("total_emails"), F.count_if("whitelisted").alias("whitelisted"),
        *[F.count_if(open_ & (F.col("risk_level") == r)).alias(f"{r}_risk") for r in ("low", "medium", "high")],
        F.count_if(F.col("action") == "quarantine").alias("quarantined"),
        F.count_if(F.col("action") == "manual_review").alias("manual_review"),
        F.count_if(F.col("threat_score").isNull()).alias("processing_errors"))

    def rate(part: Column) -> Column:
        return F.coalesce(F.try_divide(part, F.col("total_emails")) * 100, F.lit(0.0))

    return counted.withColumns({
        "whitelist_rate": rate(F.col("whitelisted")),
        "threat_detection_rate": rate(F.col("medium_risk") + F.col("high_risk")),
        "quarantine_rate": rate(F.col("quarantined")),
        "manual_review_rate": rate(F.col("manual_review")),
        "error_rate": rate(F.col("processing_errors")),
    })


def workflow_threat_types(decided: DataFrame) -> DataFrame:
    """Threats of scored mails by the first kind their name contains."""
    kind = F.lower("threat")
    named = (F.when(kind.contains("phishing"), "phishing_attempts").when(kind.contains("url"), "malicious_urls")
             .when(kind.contains("attachment"), "suspicious_attachments").when(kind.contains("spoof"), "spoofed_senders")
             .when(kind.contains("social"), "social_engineering"))
    return (
        decided.filter(~F.col("whitelisted")).select(F.explode("threats").alias("threat"))
        .select(named.alias("threat_type")).filter("threat_type is not null")
        .groupBy("threat_type").agg(F.count(F.lit(1)).alias("count"))
    )
