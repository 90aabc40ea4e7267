"""Thirty-day statistics over the fact tables."""

from catalog import attachments, headers, urls
from catalog.registry import plain, register
from datasets.views import AS_OF, HOUR_AS_OF, view
from mailquarry.plans import reports
from oracles.attachments import FILES
from oracles.headers import HEADERS
from oracles.sql import URL_CTES


def facts(spark, sf):
    return view(spark, sf, "v_analyses")


def recent(column, interval, as_of=AS_OF):
    return f"{column} >= TIMESTAMP '{as_of}' - INTERVAL {interval} AND {column} <= TIMESTAMP '{as_of}'"


LEVELS = """count_if(threat_level IN ('HIGH', 'CRITICAL')) AS high_threats, count_if(threat_level = 'MEDIUM') AS medium_threats,
           count_if(threat_level = 'LOW') AS low_threats"""


@register("stats_overall_30d", f"""
    SELECT count(*) AS total_analyses, count_if(is_phishing) AS phishing_detected, round(avg(threat_score), 8) AS avg_threat_score,
           round(avg(duration_ms), 8) AS avg_processing_time, count_if(threat_level = 'CRITICAL') AS critical_threats,
           count_if(threat_level = 'HIGH') AS high_threats, count_if(threat_level = 'MEDIUM') AS medium_threats,
           count_if(threat_level = 'LOW') AS low_threats FROM v_analyses
    WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL '30 days' AND created_at <= TIMESTAMP '{AS_OF}'""")
def stats_overall_30d(spark, sf):
    return plain(reports.overall(facts(spark, sf), AS_OF))


@register("stats_url_30d", f"""
    SELECT count(*) AS total_urls, count_if(is_malicious) AS malicious_urls, round(avg(scan_score), 8) AS avg_vt_score,
           round(avg(host_score), 8) AS avg_uv_score, count(DISTINCT domain) AS unique_domains
    FROM s_judged WHERE page_id % 50 < 30""", URL_CTES)
def stats_url_30d(spark, sf):
    return plain(reports.link_stats(urls.link_facts(spark, sf), AS_OF))


@register("stats_attachment_30d", """
    SELECT count(*) AS total_attachments, count_if(is_malware) AS malware_count, round(avg(rule_score), 8) AS avg_yara_score,
           count(DISTINCT malware_family) FILTER (WHERE malware_family <> '') AS malware_families, count_if(rules <> '') AS yara_detections
    FROM a_scored WHERE p_partkey % 50 < 30""", FILES)
def stats_attachment_30d(spark, sf):
    return plain(reports.attachment_stats(attachments.file_facts(spark, sf), AS_OF))


@register("stats_header_30d", """
    SELECT count(*) AS total_analyses, count_if(spf_result = 'pass') AS spf_pass_count, count_if(dkim_result = 'pass') AS dkim_pass_count,
           count_if(dmarc_result = 'pass') AS dmarc_pass_count, count_if(suspicious_routing) AS suspicious_routing_count,
           count_if(timestamp_anomalies) AS timestamp_anomaly_count, round(avg(header_score), 8) AS avg_header_score
    FROM h_all WHERE substr(message_id, 2)::INT % 50 < 30""", HEADERS)
def stats_header_30d(spark, sf):
    return plain(reports.header_stats(headers.header_facts(spark, sf), AS_OF))


@register("stats_system_24h", f"""
    SELECT count(*) AS total_emails, {LEVELS}, count_if(is_quarantined) AS quarantined
    FROM v_analyses WHERE {recent('created_at', "'24 hours'", HOUR_AS_OF)}""")
def stats_system_24h(spark, sf):
    return plain(reports.system_stats(facts(spark, sf), HOUR_AS_OF))


@register("rollup_monitoring", """
    SELECT recipient_email, count(*) AS emails_processed, count_if(is_phishing) AS threats_detected,
           count_if(coalesce(false_positive, false)) AS false_positives, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_activity
    FROM v_analyses GROUP BY recipient_email""")
def rollup_monitoring(spark, sf):
    return plain(reports.monitoring_rollup(facts(spark, sf)))
