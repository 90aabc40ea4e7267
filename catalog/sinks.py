"""Sink and maintenance jobs; each writes and is compared on what reads back."""

from pyspark.sql import functions as F

from catalog.facts import facts
from catalog.registry import plain, register
from datasets.views import AS_OF, view
from mailquarry import schemas
from mailquarry.plans import reports
from mailquarry.sinks import maintenance, protect
from mailquarry.sinks.facts import append, append_and_read, new_table_path

_FACT = ["email_id", "sender_email", "recipient_email", "subject", "threat_level", "threat_score", "is_phishing",
         "confidence", "is_quarantined", "content_score", "url_score", "attachment_score", "header_score",
         "threat_category", "duration_ms", "lang", "created_at"]
_SHOW = {"threat_score", "confidence", "content_score", "url_score", "attachment_score", "header_score"}


def _sql(columns):
    return ", ".join(f"round({c}, 8) AS {c}" if c in _SHOW else
                     f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" if c.endswith("_at") else c for c in columns)


@register("sink_analysis_append", f"SELECT {_sql(_FACT)} FROM v_analyses")
def sink_analysis_append(spark, sf):
    return plain(append_and_read(facts(spark, sf).select(_FACT), "email_analyses", "created_at"))


def current_facts(spark, sf):
    return facts(spark, sf).select(
        "email_id", "sender_email", "recipient_email", "subject", "threat_level", "threat_score", "is_phishing", "confidence",
        F.lit("first scan").alias("analysis_details"), "is_quarantined", "created_at",
        F.lit(None).cast("timestamp_ntz").alias("updated_at"))


_UPSERT = """
    SELECT email_id, sender_email, recipient_email, subject, threat_level, round(threat_score, 8) AS threat_score, is_phishing, round(confidence, 8) AS confidence,
           analysis_details, is_quarantined, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM u_merged"""
_UPSERT_CTES = {
    "u_last": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY received_at DESC, seq DESC) AS rn, count(*) OVER (PARTITION BY email_id) AS times FROM v_incoming) x WHERE rn = 1",
    "u_first": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY received_at, seq) AS rn FROM v_incoming) x WHERE rn = 1",
    "u_merged": """
        SELECT coalesce(c.email_id, l.email_id) AS email_id, coalesce(c.sender_email, f.sender_email) AS sender_email,
               coalesce(c.recipient_email, f.recipient_email) AS recipient_email, coalesce(c.subject, f.subject) AS subject,
               coalesce(l.threat_level, c.threat_level) AS threat_level, coalesce(l.threat_score, c.threat_score) AS threat_score,
               coalesce(l.is_phishing, c.is_phishing) AS is_phishing, coalesce(l.confidence, c.confidence) AS confidence,
               coalesce(l.analysis_details, 'first scan') AS analysis_details,
               CASE WHEN l.email_id IS NOT NULL THEN l.threat_level IN ('HIGH', 'CRITICAL') ELSE c.is_quarantined END AS is_quarantined,
               coalesce(c.created_at, f.received_at) AS created_at,
               CASE WHEN l.email_id IS NOT NULL AND (c.email_id IS NOT NULL OR l.times > 1) THEN l.received_at END AS updated_at
        FROM v_analyses c FULL OUTER JOIN u_last l ON l.email_id = c.email_id LEFT JOIN u_first f ON f.email_id = l.email_id""",
}


@register("sink_upsert_analysis", _UPSERT, _UPSERT_CTES)
def sink_upsert_analysis(spark, sf):
    path = new_table_path(spark, "email_analyses")
    append(current_facts(spark, sf), path, "created_at")
    maintenance.upsert_table(spark, path, view(spark, sf, "v_incoming"))
    return plain(spark.read.parquet(path).drop("day"))


@register("sink_report_json", f"""
    SELECT strftime(created_at, '%Y-%m-%d') AS report_date, count(*) AS emails, count_if(threat_level IN ('HIGH', 'CRITICAL')) AS threats
    FROM v_analyses WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND created_at <= TIMESTAMP '{AS_OF}' GROUP BY 1""")
def sink_report_json(spark, sf):
    rows = reports.weekly_by_day(facts(spark, sf), AS_OF).select(
        "date", F.to_json(F.struct(F.col("total_emails").alias("emails"), F.col("high_threats").alias("threats"))).alias("summary_data"))
    written = append_and_read(rows, "weekly_summaries")
    parsed = written.select("date", F.from_json("summary_data", "emails bigint, threats bigint").alias("d"))
    return plain(parsed.select(F.col("date").alias("report_date"), "d.emails", "d.threats"))


@register("sink_audit", """
    SELECT event_type, user_id, resource_id, action, json_extract_string(details, '$.k')::BIGINT AS k, success, strftime(created_at, '%Y-%m-%d') AS day
    FROM v_audit""")
def sink_audit(spark, sf):
    audit = view(spark, sf, "v_audit")
    records = audit.select("created_at", F.to_json(F.struct(
        "event_type", "user_id", "user_email", "resource_id", "action", "details", "ip_address", "user_agent", "success",
        F.col("created_at").cast("timestamp").alias("created_at"))).alias("record"))
    written = append_and_read(records, "audit_logs", "created_at")
    parsed = written.select(F.from_json("record", schemas.AUDIT).alias("r")).select("r.*")
    return plain(parsed.select("event_type", "user_id", "resource_id", "action",
                               F.get_json_object("details", "$.k").cast("bigint").alias("k"), "success",
                               F.to_date("created_at").alias("day")))


@register("sink_encrypted_cols", "SELECT message_id, true AS hidden, md5(content) AS body_md5, subject FROM v_emails")
def sink_encrypted_cols(spark, sf):
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    mails = view(spark, sf, "v_emails").select("message_id", "subject", F.col("content").alias("email_body"))
    stored = append_and_read(protect.encrypt(mails, key), "protected")
    back = protect.decrypt(stored.withColumn("cipher", F.col("email_body")), key)
    return back.select("message_id", (F.col("cipher") != F.col("email_body")).alias("hidden"),
                       F.md5("email_body").alias("body_md5"), "subject")


@register("maint_retention", f"""
    SELECT 'analyses' AS kept, email_id FROM v_analyses WHERE created_at >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY OR is_quarantined
    UNION ALL SELECT 'metrics' AS kept, email_id FROM v_analyses WHERE created_at >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY""")
def maint_retention(spark, sf):
    at = "2024-04-10 00:00:00"
    kept = maintenance.retain(facts(spark, sf), at).select(F.lit("analyses").alias("kept"), "email_id")
    return kept.unionByName(maintenance.retain_metrics(facts(spark, sf), at).select(F.lit("metrics").alias("kept"), "email_id"))


@register("maint_cascade_delete", """
    SELECT message_id AS email_analysis_id, url FROM v_urls WHERE message_id IN (SELECT email_id FROM v_analyses WHERE is_quarantined)""")
def maint_cascade_delete(spark, sf):
    children = view(spark, sf, "v_urls").select(F.col("message_id").alias("email_analysis_id"), "url")
    parents = facts(spark, sf).filter("is_quarantined").select(F.col("email_id").alias("email_analysis_id"))
    return maintenance.without_orphans(children, parents)


@register("maint_release", """
    SELECT a.email_id, a.is_quarantined AND r.email_id IS NULL AS is_quarantined, strftime(r.at, '%Y-%m-%d %H:%M:%S') AS released_at, r.by AS released_by
    FROM v_analyses a LEFT JOIN (SELECT email_id, max(released_at) AS at, max_by(released_by, (released_at, released_by)) AS by FROM v_releases
                                 WHERE released_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY email_id) r ON r.email_id = a.email_id""")
def maint_release(spark, sf):
    released = maintenance.release(facts(spark, sf), view(spark, sf, "v_releases"), "2024-01-20 12:00:00")
    return plain(released.select("email_id", "is_quarantined", "released_at", "released_by"))


@register("maint_model_deactivate", f"""
    SELECT model_name, version, strftime(training_date, '%Y-%m-%d %H:%M:%S') AS training_date,
           CASE WHEN training_date < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN false ELSE is_active END AS is_active FROM v_models
    UNION ALL SELECT DISTINCT model_name, 1000000 AS version, '{AS_OF}' AS training_date, true AS is_active FROM v_models""")
def maint_model_deactivate(spark, sf):
    models = view(spark, sf, "v_models").select("model_name", "version", "training_date", "is_active")
    new = models.select("model_name").distinct().select(
        "model_name", F.lit(1000000).cast("bigint").alias("version"), F.lit(AS_OF).cast("timestamp_ntz").alias("training_date"),
        F.lit(True).alias("is_active"))
    return plain(maintenance.deactivate_old(models.unionByName(new), AS_OF))


@register("maint_subscriptions", f"""
    SELECT user_email, subscription_id, expires_at - TIMESTAMP '{AS_OF}' < INTERVAL 12 HOUR AS renewed,
           strftime(CASE WHEN expires_at - TIMESTAMP '{AS_OF}' < INTERVAL 12 HOUR THEN TIMESTAMP '{AS_OF}' + INTERVAL 3 DAY ELSE expires_at END, '%Y-%m-%d %H:%M:%S') AS expires_at
    FROM v_subscriptions WHERE expires_at >= TIMESTAMP '{AS_OF}'""")
def maint_subscriptions(spark, sf):
    return plain(maintenance.renew_subscriptions(view(spark, sf, "v_subscriptions"), AS_OF))


