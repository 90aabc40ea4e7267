"""Verdict jobs and the flagship plan."""

from pyspark.sql import functions as F

from catalog import attachments as at
from catalog import urls as ur
from catalog.headers import as_of
from catalog.registry import plain, register
from datasets.mails import attachments as files_of
from datasets.mails import full_mails, geo_ranges
from datasets.views import view
from mailquarry.operators import ensemble
from mailquarry.plans import mailbox
from mailquarry.plans.skew import hot_keys
from oracles.ensemble import MAILBOX, MODELS


def judged_mails(spark, sf, stage=False, hot_urls=None):
    return mailbox.score_mailbox(
        full_mails(spark, sf), files_of(spark, sf), ur.url_verdicts(spark, sf), at.file_verdicts(spark, sf),
        geo_ranges(spark, sf), view(spark, sf, "v_predictions"), as_of(), stage, hot_urls)


def decided_mails(spark, sf):
    marked = ensemble.mark_whitelisted(judged_mails(spark, sf), ensemble.whitelist_table(spark))
    return ensemble.workflow_action(marked)


_COMPONENTS = "message_id, round(content_score, 8) AS content_score, round(url_score, 8) AS url_score, " \
    "round(attachment_score, 8) AS attachment_score, round(header_score, 8) AS header_score, round(model_mean, 8) AS model_mean, has_classifier"


@register("join_components", f"SELECT {_COMPONENTS} FROM b_parts", MAILBOX)
def join_components(spark, sf):
    return plain(judged_mails(spark, sf).select(
        "message_id", "content_score", "url_score", "attachment_score", "header_score", "model_mean", "has_classifier"))


@register("ml_soft_average", """
    SELECT message_id, round(probability, 8) AS probability, prediction, round(confidence, 8) AS confidence, method, round(model_mean, 8) AS model_mean
    FROM p_final""", MODELS)
def ml_soft_average(spark, sf):
    return plain(ensemble.soft_average(view(spark, sf, "v_predictions")))


@register("ensemble_verdict", "SELECT message_id, round(threat_score, 8) AS threat_score, is_phishing, threat_level FROM b_judged", MAILBOX)
def ensemble_verdict(spark, sf):
    return plain(judged_mails(spark, sf).select("message_id", "threat_score", "is_phishing", "threat_level"))


@register("ensemble_category", "SELECT message_id, has_classifier, threat_category FROM b_judged", MAILBOX)
def ensemble_category(spark, sf):
    return judged_mails(spark, sf).select("message_id", "has_classifier", "threat_category")


@register("recommendations", """
    SELECT message_id, unnest(range(len(recommendations))) AS position, unnest(recommendations) AS text FROM b_threats""", MAILBOX)
def recommendations(spark, sf):
    return plain(ensemble.recommendations(judged_mails(spark, sf)))


@register("join_whitelist", """
    SELECT message_id, whitelisted FROM b_judged""", MAILBOX)
def join_whitelist(spark, sf):
    mails = view(spark, sf, "v_emails").select("message_id", "sender")
    whitelist = ensemble.whitelist_table(spark)
    rest = ensemble.not_whitelisted(mails, whitelist).select("message_id", F.lit(False).alias("whitelisted"))
    listed = ensemble.mark_whitelisted(mails, whitelist).filter("whitelisted").select("message_id", "whitelisted")
    return rest.unionByName(listed)


@register("workflow_action", """
    SELECT message_id, whitelisted, round(risk_score, 8) AS risk_score, risk_level, action, array_to_string(threats, '|') AS threats FROM b_decided""", MAILBOX)
def workflow_action(spark, sf):
    return plain(decided_mails(spark, sf).select("message_id", "whitelisted", "risk_score", "risk_level", "action", "threats"))


@register("workflow_summary", """
    SELECT *, round(whitelisted * 100e0 / total_emails, 8) AS whitelist_rate, round((medium_risk + high_risk) * 100e0 / total_emails, 8) AS threat_detection_rate,
           round(quarantined * 100e0 / total_emails, 8) AS quarantine_rate, 0e0 AS manual_review_rate, 0e0 AS error_rate
    FROM (SELECT count(*) AS total_emails, count_if(whitelisted) AS whitelisted, count_if(NOT whitelisted AND risk_level = 'low') AS low_risk,
                 count_if(NOT whitelisted AND risk_level = 'medium') AS medium_risk, count_if(NOT whitelisted AND risk_level = 'high') AS high_risk,
                 count_if(action = 'quarantine') AS quarantined, 0::BIGINT AS manual_review, 0::BIGINT AS processing_errors FROM b_decided) x""", MAILBOX)
def workflow_summary(spark, sf):
    return plain(ensemble.workflow_summary(decided_mails(spark, sf)))


@register("workflow_threat_types", """
    SELECT threat_type, count(*) AS count FROM (
        SELECT CASE t WHEN 'phishing_attempt' THEN 'phishing_attempts' WHEN 'malicious_url' THEN 'malicious_urls'
                    WHEN 'malicious_attachment' THEN 'suspicious_attachments' WHEN 'spoofed_sender' THEN 'spoofed_senders'
                    WHEN 'social_engineering' THEN 'social_engineering' END AS threat_type
        FROM (SELECT unnest(threats) AS t FROM b_decided WHERE NOT whitelisted) x) y GROUP BY threat_type""", MAILBOX)
def workflow_threat_types(spark, sf):
    return plain(ensemble.workflow_threat_types(decided_mails(spark, sf)))


@register("score_mailbox", """
    SELECT message_id, sender, round(content_score, 8) AS content_score, round(url_score, 8) AS url_score, round(attachment_score, 8) AS attachment_score,
           round(header_score, 8) AS header_score, round(threat_score, 8) AS threat_score, is_phishing, threat_level, threat_category,
           array_to_string(threats, '|') AS threats, array_to_string(recommendations, '|') AS recommendations FROM b_threats""", MAILBOX)
def score_mailbox(spark, sf):
    # bodies are read once; the heavy URLs come from the narrow link table
    judged = judged_mails(spark, sf, stage=True, hot_urls=hot_keys(view(spark, sf, "v_urls"), ["url"]))
    return plain(judged.select(
        "message_id", "sender", "content_score", "url_score", "attachment_score", "header_score", "threat_score",
        "is_phishing", "threat_level", "threat_category", "threats", "recommendations"))
