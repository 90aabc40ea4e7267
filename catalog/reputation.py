"""Vendor reports and indicator feeds."""

from pyspark.sql import functions as F

from catalog.registry import plain, register
from datasets.views import view
from mailquarry import lexicon as lx
from mailquarry.operators import reputation
from oracles.sql import host_verdicts, q, scan_verdicts

FEEDS = {
    "f_scores": """
        SELECT ioc, ioc_type, source, error, CASE WHEN error IS NULL THEN
                 CASE source WHEN 'urlhaus' THEN CASE WHEN query_status = 'ok' THEN 0.8e0 ELSE 0e0 END
                      WHEN 'phishtank' THEN CASE WHEN verified THEN 0.9e0 ELSE 0e0 END
                      WHEN 'abuseipdb' THEN abuse_pct / 100e0 WHEN 'hybrid_analysis' THEN coalesce(sandbox_score, 0) / 100e0
                      WHEN 'custom_feeds' THEN 0e0 ELSE (malicious + suspicious) / greatest(malicious + suspicious + harmless, 1)::DOUBLE END END AS threat_score,
               error IS NULL AND coalesce(query_status = 'ok' OR in_database OR malicious > 0, false) AS detected,
               threat, verdict, query_status FROM v_feeds""",
    "f_verdicts": """
        SELECT ioc, ioc_type, source, error, threat_score, detected,
               CASE WHEN detected THEN CASE WHEN source = 'urlhaus' THEN threat ELSE coalesce(verdict, 'unknown') END END AS threat_type FROM f_scores""",
}
_SOURCES = ", ".join(f"({q(t)}, {q(s)})" for t, names in lx.IOC_SOURCES.items() for s in names)


def verdicts(spark, sf):
    return reputation.normalise_feeds(view(spark, sf, "v_feeds"))


@register("src_reputation_vt", f"""
    SELECT 'url' AS kind, url AS resource, positives, total, round(reputation_score, 8) AS reputation_score, is_malicious,
           array_to_string(threat_types, '|') AS threat_types FROM ({scan_verdicts('v_url_reports_a', 'url')}) a
    UNION ALL
    SELECT 'file' AS kind, file_hash AS resource, positives, total, round(reputation_score, 8) AS reputation_score, is_malicious,
           array_to_string(threat_types, '|') AS threat_types FROM ({scan_verdicts('v_file_reports', 'file_hash')}) b""")
def src_reputation_vt(spark, sf):
    def shaped(name, key, kind):
        return reputation.scan_verdicts(view(spark, sf, name), key).select(
            F.lit(kind).alias("kind"), F.col(key).alias("resource"), "positives", "total", "reputation_score",
            "is_malicious", F.sort_array("threat_types").alias("threat_types"))
    return plain(shaped("v_url_reports_a", "url", "url").unionByName(shaped("v_file_reports", "file_hash", "file")))


@register("src_reputation_uv", f"""
    SELECT url, detections, engines_count, round(reputation_score, 8) AS reputation_score, is_malicious,
           array_to_string(threat_types, '|') AS threat_types FROM ({host_verdicts('v_url_reports_b', 'url')}) a""")
def src_reputation_uv(spark, sf):
    return plain(reputation.host_verdicts(view(spark, sf, "v_url_reports_b"), "url").select(
        "url", "detections", "engines_count", "reputation_score", "is_malicious",
        F.sort_array("threat_types").alias("threat_types")))


@register("src_ioc_feeds", """
    SELECT ioc, ioc_type, source, error, round(threat_score, 8) AS threat_score, detected, threat_type FROM f_verdicts""", FEEDS)
def src_ioc_feeds(spark, sf):
    return plain(verdicts(spark, sf))


@register("join_ioc_sources", f"""
    SELECT i.ioc, i.ioc_type, s.source, round(v.threat_score, 8) AS threat_score, v.error
    FROM (SELECT DISTINCT ioc, ioc_type FROM v_feeds) i JOIN (VALUES {_SOURCES}) s(ioc_type, source) USING (ioc_type)
    LEFT JOIN f_verdicts v ON v.ioc = i.ioc AND v.ioc_type = i.ioc_type AND v.source = s.source""", FEEDS)
def join_ioc_sources(spark, sf):
    rows = verdicts(spark, sf)
    return plain(reputation.applicable_sources(rows, rows).select("ioc", "ioc_type", "source", "threat_score", "error"))


@register("agg_ioc_verdict", """
    SELECT ioc, ioc_type, count(*) AS sources_checked, count(threat_score) AS sources_responded,
           round(coalesce(avg(threat_score), 0e0), 8) AS threat_score,
           CASE WHEN count(threat_score) = 0 THEN 'UNKNOWN' WHEN avg(threat_score) > 0.7e0 THEN 'MALICIOUS'
                WHEN avg(threat_score) > 0.4e0 THEN 'SUSPICIOUS' WHEN avg(threat_score) > 0.1e0 THEN 'QUESTIONABLE' ELSE 'CLEAN' END AS verdict,
           coalesce(string_agg(source || ':' || threat_type, '|' ORDER BY source || ':' || threat_type) FILTER (WHERE detected), '') AS threat_context
    FROM f_verdicts GROUP BY ioc, ioc_type""", FEEDS)
def agg_ioc_verdict(spark, sf):
    return plain(reputation.aggregate_verdicts(verdicts(spark, sf)))
