"""Daily, weekly and thirty-day reports."""

from catalog.facts import LEVELS, facts, recent
from catalog.registry import plain, register
from datasets.views import AS_OF, view
from mailquarry.plans import reports

DAY = "2024-01-20"
IS_HIGH = "threat_level IN ('HIGH', 'CRITICAL')"
_ON_DAY = f"created_at >= TIMESTAMP '{DAY} 00:00:00' AND created_at < TIMESTAMP '{DAY} 00:00:00' + INTERVAL 1 DAY"
_TOP = f"""
    SELECT sender_email, count(*) AS threat_count, avg(threat_score) AS avg_score FROM v_analyses
    WHERE {_ON_DAY} AND ({IS_HIGH} OR threat_level = 'MEDIUM') GROUP BY sender_email
    ORDER BY threat_count DESC, avg_score DESC, sender_email LIMIT 10"""
_ACTIVE = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY training_date DESC, version DESC) AS rn
                   FROM v_models WHERE is_active) x WHERE rn = 1"""


@register("report_daily_summary", f"""
    SELECT count(*) AS total_emails, {LEVELS}, count_if(is_quarantined) AS quarantined,
           round(coalesce(avg(threat_score), 0e0), 8) AS average_threat_score FROM v_analyses WHERE {_ON_DAY}""")
def report_daily_summary(spark, sf):
    return plain(reports.daily_summary(facts(spark, sf), DAY))


@register("top_threat_senders", f"SELECT sender_email, threat_count, round(avg_score, 8) AS avg_score FROM ({_TOP}) t")
def top_threat_senders(spark, sf):
    return plain(reports.top_senders(facts(spark, sf), DAY))


# the document is compared by its parts: number formats inside JSON differ between engines
@register("report_daily_doc", f"""
    SELECT '{DAY}' AS report_date, (SELECT count(*) FROM v_analyses WHERE {_ON_DAY}) AS total_emails,
           (SELECT round(coalesce(avg(threat_score), 0e0), 6) FROM v_analyses WHERE {_ON_DAY}) AS average_threat_score,
           (SELECT string_agg(sender_email || ':' || threat_count, '|' ORDER BY threat_count DESC, avg_score DESC, sender_email) FROM ({_TOP}) t) AS senders,
           (SELECT string_agg(model_name, '|' ORDER BY model_name) FROM ({_ACTIVE}) m) AS models,
           (SELECT round(sum(f1_score), 6) FROM ({_ACTIVE}) m) AS f1_sum""")
def report_daily_doc(spark, sf):
    from pyspark.sql import functions as F

    doc = reports.daily_document(facts(spark, sf), view(spark, sf, "v_models"), DAY)
    parsed = doc.select("report_date", F.from_json("report_data", """
        summary struct<total_emails: bigint, average_threat_score: double>,
        top_threat_senders array<struct<sender: string, threat_count: bigint>>,
        model_performance array<struct<model: string, f1_score: double>>""").alias("d"))
    return plain(parsed.select(
        "report_date", "d.summary.total_emails", "d.summary.average_threat_score",
        F.array_join(F.transform("d.top_threat_senders", lambda s: F.concat_ws(":", s["sender"], s["threat_count"])), "|").alias("senders"),
        F.array_join("d.model_performance.model", "|").alias("models"),
        F.aggregate("d.model_performance.f1_score", F.lit(0.0), lambda a, x: a + x).alias("f1_sum")))


_DAYS = f"""
    SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS total_emails, count_if({IS_HIGH}) AS high_threats, avg(threat_score) AS avg_score
    FROM v_analyses WHERE {recent('created_at', "'7 days'")} GROUP BY 1"""


@register("report_weekly_by_day", f"SELECT date, total_emails, high_threats, round(avg_score, 8) AS avg_score FROM ({_DAYS}) d")
def report_weekly_by_day(spark, sf):
    return plain(reports.weekly_by_day(facts(spark, sf), AS_OF))


@register("report_weekly_totals", f"""
    SELECT coalesce(sum(total_emails), 0)::BIGINT AS total_emails, coalesce(sum(high_threats), 0)::BIGINT AS total_high_threats,
           round(coalesce(sum(high_threats) * 100e0 / nullif(sum(total_emails), 0), 0e0), 2) AS threat_rate_percent FROM ({_DAYS}) d""")
def report_weekly_totals(spark, sf):
    return plain(reports.weekly_totals(facts(spark, sf), AS_OF))


@register("report_threat_trends", f"""
    SELECT strftime(created_at, '%Y-%m-%d') AS date, count_if({IS_HIGH}) AS "HIGH", count_if(threat_level = 'MEDIUM') AS "MEDIUM",
           count_if(threat_level = 'LOW') AS "LOW" FROM v_analyses WHERE {recent('created_at', "'30 days'")} GROUP BY 1""")
def report_threat_trends(spark, sf):
    return plain(reports.threat_trends(facts(spark, sf), AS_OF))


@register("report_user_risk", f"""
    SELECT recipient_email, count(*) AS total_emails, count_if({IS_HIGH}) AS high_threat_emails, round(avg(threat_score), 8) AS average_threat_score,
           strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_threat_date,
           CASE WHEN count_if({IS_HIGH}) > 5 THEN 'HIGH' WHEN count_if({IS_HIGH}) > 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
    FROM v_analyses WHERE {recent('created_at', "'30 days'")} GROUP BY recipient_email""")
def report_user_risk(spark, sf):
    return plain(reports.user_risk(facts(spark, sf), AS_OF))


@register("report_indicator_effect", f"""
    SELECT threat_type, count(*) AS detections, round(avg(confidence), 8) AS avg_confidence, sum(verified_threat::INT)::BIGINT AS true_positives
    FROM v_analyses WHERE {recent('created_at', "'30 days'")} GROUP BY threat_type""")
def report_indicator_effect(spark, sf):
    return plain(reports.indicator_effect(facts(spark, sf), AS_OF))


@register("report_lang_distribution", f"""
    SELECT lang, threat_level, count(*) AS count, round(avg(manipulation_score), 8) AS avg_manipulation
    FROM v_analyses WHERE {recent('created_at', "'7 days'")} GROUP BY lang, threat_level""")
def report_lang_distribution(spark, sf):
    return plain(reports.language_distribution(facts(spark, sf), AS_OF))


_MODELS_AT = "2024-01-05 00:00:00"


@register("report_model_latency", f"""
    SELECT model_name, round(avg(inference_ms), 8) AS avg_inference_time, round(avg(abs(probability - 0.5e0) * 2), 8) AS avg_confidence, count(*) AS predictions_made
    FROM v_predictions WHERE {recent('created_at', "'24 hours'", _MODELS_AT)} GROUP BY model_name""")
def report_model_latency(spark, sf):
    return plain(reports.model_latency(view(spark, sf, "v_predictions"), _MODELS_AT))


@register("report_attack_vectors", """
    SELECT coalesce(threat_category, '*') AS threat_category, coalesce(lang, '*') AS lang, coalesce(threat_level, '*') AS threat_level,
           count(*) AS count, (grouping(threat_category) * 4 + grouping(lang) * 2 + grouping(threat_level))::BIGINT AS grouping
    FROM v_analyses GROUP BY CUBE (threat_category, lang, threat_level)""")
def report_attack_vectors(spark, sf):
    return plain(reports.attack_vectors(facts(spark, sf)))


@register("win_trend_delta", """
    SELECT threat_level, date, n AS count, n - lag(n) OVER w AS change,
           round(avg(n) OVER (PARTITION BY threat_level ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 8) AS moving_average
    FROM (SELECT threat_level, strftime(created_at, '%Y-%m-%d') AS date, count(*) AS n FROM v_analyses GROUP BY 1, 2) d
    WINDOW w AS (PARTITION BY threat_level ORDER BY date)""")
def win_trend_delta(spark, sf):
    return plain(reports.trend_delta(facts(spark, sf)))


_ROW = "email_id, sender_email, subject, threat_level, round(threat_score, 8) AS threat_score, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"


@register("recent_activity", f"""
    SELECT {_ROW} FROM (SELECT * FROM v_analyses ORDER BY created_at DESC, email_id LIMIT 10) a""")
def recent_activity(spark, sf):
    return plain(reports.recent_activity(facts(spark, sf)))


@register("quarantine_page", f"""
    SELECT {_ROW} FROM (SELECT * FROM v_analyses WHERE is_quarantined ORDER BY created_at DESC, email_id LIMIT 50 OFFSET 50) a""")
def quarantine_page(spark, sf):
    return plain(reports.quarantine_page(facts(spark, sf), page=2))


