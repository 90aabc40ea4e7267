"""Header jobs."""

from pyspark.sql import functions as F

from catalog.registry import plain, register
from datasets.mails import geo_ranges, mails_with_headers
from datasets.views import AS_OF, view
from mailquarry import lexicon as lx
from mailquarry.operators import headers
from mailquarry.sinks.facts import append_and_read
from oracles.headers import HEADERS, RISK
from oracles.sql import isin


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def scored_headers(spark, sf):
    return headers.score_headers(mails_with_headers(spark, sf), geo_ranges(spark, sf), as_of())


@register("extract_headers", " UNION ALL ".join(
    f"SELECT message_id, '{name}' AS name, {col} AS value FROM v_headers WHERE {col} IS NOT NULL" for name, col in [
        ("from", "from_h"), ("return-path", "return_path"), ("received-spf", "spf"), ("dkim-signature", "dkim"),
        ("authentication-results", "auth"), ("date", "date_h"), ("received", "hops[len(hops)]")]))
def extract_headers(spark, sf):
    return headers.header_rows(mails_with_headers(spark, sf))


@register("extract_ips", "SELECT message_id, hop_pos AS hop, pos, ip FROM h_public", HEADERS)
def extract_ips(spark, sf):
    return plain(headers.hop_addresses(mails_with_headers(spark, sf)))


@register("extract_sender_ip", "SELECT v.message_id, sender_ip FROM v_headers v LEFT JOIN h_ip USING (message_id)", HEADERS)
def extract_sender_ip(spark, sf):
    return headers.sender_ip(mails_with_headers(spark, sf))


@register("join_geoip", "SELECT message_id, hop_pos AS hop, pos, ip, country FROM h_geo", HEADERS)
def join_geoip(spark, sf):
    return plain(headers.geo_join(headers.hop_addresses(mails_with_headers(spark, sf)), geo_ranges(spark, sf)))


@register("join_high_risk_country", f"""
    SELECT DISTINCT message_id, country, {isin('country', lx.FEATURE_HIGH_RISK_COUNTRIES)} AS in_feature_list
    FROM h_geo WHERE {RISK}""", HEADERS)
def join_high_risk_country(spark, sf):
    located = headers.geo_join(headers.hop_addresses(mails_with_headers(spark, sf)), geo_ranges(spark, sf))
    listed = F.broadcast(spark.createDataFrame([(c,) for c in lx.HIGH_RISK_COUNTRIES], "country string"))
    return located.join(listed, "country", "left_semi").select(
        "message_id", "country", F.col("country").isin(lx.FEATURE_HIGH_RISK_COUNTRIES).alias("in_feature_list")).distinct()


@register("score_headers_auth", """
    SELECT message_id, spf_result, dkim_result, dmarc_result, spf_score, dkim_score, dmarc_score,
           round(authentication_score, 8) AS authentication_score FROM h_auth""", HEADERS)
def score_headers_auth(spark, sf):
    return plain(headers.authentication(mails_with_headers(spark, sf)))


@register("score_headers_routing", """
    SELECT message_id, hop_count, disposable_hops, unknown_hops, high_risk_ips, countries, high_risk_evidence, suspicious_hops,
           round(routing_score, 8) AS routing_score FROM h_routing""", HEADERS)
def score_headers_routing(spark, sf):
    routed = headers.routing(mails_with_headers(spark, sf), geo_ranges(spark, sf))
    return plain(routed.select(
        "message_id", "hop_count", "disposable_hops", "unknown_hops", F.coalesce("high_risk_ips", F.lit(0)).alias("high_risk_ips"),
        F.coalesce("countries", F.array().cast("array<string>")).alias("countries"),
        F.coalesce("high_risk_evidence", F.array().cast("array<string>")).alias("high_risk_evidence"),
        "suspicious_hops", "routing_score"))


@register("score_headers_time", """
    SELECT message_id, stamps, backward_steps, long_gaps, zone_changes, timestamp_anomalies, timezone_inconsistencies,
           round(timestamp_score, 8) AS timestamp_score FROM h_time""", HEADERS)
def score_headers_time(spark, sf):
    return plain(headers.timestamps(mails_with_headers(spark, sf), as_of()))


@register("score_headers_sender", """
    SELECT message_id, sender_ip, sender_country, return_path_mismatch, disposable_from, round(sender_score, 8) AS sender_score
    FROM h_sent""", HEADERS)
def score_headers_sender(spark, sf):
    return plain(headers.sender(mails_with_headers(spark, sf), geo_ranges(spark, sf)))


@register("score_headers", """
    SELECT message_id, round(header_score, 8) AS header_score, round(authentication_score, 8) AS authentication_score,
           round(routing_score, 8) AS routing_score, round(timestamp_score, 8) AS timestamp_score, round(sender_score, 8) AS sender_score,
           spf_result, dkim_result, dmarc_result, sender_ip, sender_country, hop_count, suspicious_routing, timestamp_anomalies,
           return_path_mismatch, warnings FROM h_all""", HEADERS)
def score_headers(spark, sf):
    return plain(scored_headers(spark, sf))


def header_facts(spark, sf):
    at = F.expr(f"cast('{AS_OF}' as timestamp_ntz) - cast(substr(message_id, 2) as int) % 50 * interval '1' day")
    return headers.header_facts(scored_headers(spark, sf), at)


@register("sink_header_rows", f"""
    SELECT message_id AS email_analysis_id, spf_result, dkim_result, dmarc_result, sender_ip, sender_country,
           0.5e0 AS sender_reputation_score, hop_count, suspicious_routing, timestamp_anomalies,
           round(header_score, 8) AS header_authenticity_score,
           strftime(TIMESTAMP '{AS_OF}' - (substr(message_id, 2)::INT % 50) * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS analyzed_at
    FROM h_all""", HEADERS)
def sink_header_rows(spark, sf):
    return plain(append_and_read(header_facts(spark, sf), "header_analyses", "analyzed_at"))


@register("report_geo_sources", """
    SELECT sender_country, count(*) AS mails, count(DISTINCT sender_email) AS senders, count_if(threat_level IN ('HIGH', 'CRITICAL')) AS threats
    FROM v_analyses GROUP BY sender_country""")
def report_geo_sources(spark, sf):
    from mailquarry.plans import reports

    return plain(reports.geo_sources(view(spark, sf, "v_analyses")))
