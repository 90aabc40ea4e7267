"""Attachment jobs."""

from pyspark.sql import functions as F

from catalog.registry import plain, register
from datasets.mails import attachments as files_of
from datasets.views import AS_OF, view
from mailquarry.operators import attachments, reputation
from mailquarry.sinks.facts import append_and_read
from oracles.attachments import FILES


def file_verdicts(spark, sf):
    return reputation.scan_verdicts(view(spark, sf, "v_file_reports"), "file_hash")


def scored_files(spark, sf):
    return attachments.score_files(files_of(spark, sf), file_verdicts(spark, sf))


@register("extract_attachments", """
    SELECT message_id, p_partkey, filename, file_size, mime_type, md5(data) AS data_md5
    FROM v_attachments""")
def extract_attachments(spark, sf):
    # nest first, as the landing files have it; the key travels as the position
    nested = files_of(spark, sf).select("message_id", "p_partkey", F.lit(True).alias("hasAttachments"), F.array(F.struct(
        F.col("filename").alias("name"), F.col("file_size").alias("size"), F.col("mime_type").alias("contentType"),
        F.col("file_data").alias("contentBytes"))).alias("attachments"))
    out = attachments.extract_attachments(nested.withColumn("message_id", F.concat_ws("/", "message_id", "p_partkey")))
    parts = F.split("message_id", "/")
    return plain(out.select(
        parts[0].alias("message_id"), parts[1].cast("bigint").alias("p_partkey"), "filename", "file_size", "mime_type",
        F.md5(attachments.file_bytes()).alias("data_md5")))


@register("join_mime_guess", """
    SELECT message_id, p_partkey, filename, ext AS extension, mime_type, expected_mime, coalesce(expected_mime <> mime_type, false) AS mismatch FROM a_scores""", FILES)
def join_mime_guess(spark, sf):
    return plain(attachments.guess_mime(files_of(spark, sf)).drop("file_data", "file_size"))


@register("score_files_static", """
    SELECT message_id, p_partkey, filename, ext AS extension, extension_score, size_score, mime_score, round(name_score, 8) AS name_score,
           round(static_score, 8) AS static_score FROM a_static""", FILES)
def score_files_static(spark, sf):
    return plain(attachments.score_static(files_of(spark, sf)).drop("file_data", "file_size", "mime_type"))


@register("rule_scan_files", """
    SELECT v.message_id, p_partkey, coalesce(rule_score, 0e0) AS rule_score, coalesce(rules, '') AS rules
    FROM v_attachments v LEFT JOIN a_matched USING (p_partkey)""", FILES)
def rule_scan_files(spark, sf):
    scanned = attachments.scan(files_of(spark, sf))
    return plain(scanned.select("message_id", "p_partkey", "rule_score", F.col("matches.rule_name").alias("rules")))


@register("join_file_hash", """
    SELECT message_id, p_partkey, file_hash, round(vendor_reputation, 8) AS vendor_reputation, vendor_malicious,
           array_to_string(vendor_types, '|') AS vendor_types FROM a_joined""", FILES)
def join_file_hash(spark, sf):
    joined = attachments.join_verdicts(attachments.file_hashes(files_of(spark, sf)), file_verdicts(spark, sf))
    return plain(joined.select("message_id", "p_partkey", "file_hash", "vendor_reputation", "vendor_malicious",
                               F.sort_array("vendor_types").alias("vendor_types")))


@register("score_files", """
    SELECT message_id, p_partkey, filename, round(static_score, 8) AS static_score, rule_score, round(threat_score, 8) AS threat_score,
           is_malware, malware_family FROM a_scored""", FILES)
def score_files(spark, sf):
    return plain(scored_files(spark, sf).select(
        "message_id", "p_partkey", "filename", "static_score", "rule_score", "threat_score", "is_malware", "malware_family"))


@register("rollup_attachments", """
    SELECT message_id, attachment_count, round(attachment_score, 8) AS attachment_score, malicious_files, suspicious_files FROM a_rollup""", FILES)
def rollup_attachments(spark, sf):
    return plain(attachments.rollup_files(scored_files(spark, sf)))


@register("rollup_attachments_files", """
    SELECT message_id, filename, CASE WHEN is_malware THEN 'malicious' ELSE 'suspicious' END AS verdict
    FROM a_scored WHERE is_malware OR threat_score > 0.5e0""", FILES)
def rollup_attachments_files(spark, sf):
    return attachments.flagged_files(scored_files(spark, sf))


@register("summary_attachments", """
    SELECT 'extension' AS kind, ext AS name, count(*)::DOUBLE AS value FROM a_scored GROUP BY ext
    UNION ALL SELECT 'total' AS kind, name, value FROM (
        UNPIVOT (SELECT count(*)::DOUBLE AS total_files, count_if(is_malware)::DOUBLE AS malware_detected,
                        count_if(threat_score > 0.5e0 AND NOT is_malware)::DOUBLE AS suspicious_files,
                        count_if(threat_score <= 0.5e0)::DOUBLE AS clean_files, round(avg(threat_score), 8) AS avg_threat_score,
                        count_if(rules <> '')::DOUBLE AS rule_detections, count_if(coalesce(vendor_malicious, false))::DOUBLE AS vendor_detections FROM a_scored)
        ON COLUMNS(*) INTO NAME name VALUE value)""", FILES)
def summary_attachments(spark, sf):
    return plain(attachments.summary(scored_files(spark, sf)))


def file_facts(spark, sf):
    at = F.expr(f"cast('{AS_OF}' as timestamp_ntz) - cast(p_partkey % 50 as int) * interval '1' day")
    return attachments.file_facts(scored_files(spark, sf), at)


@register("sink_attachment_rows", f"""
    SELECT message_id AS email_analysis_id, filename, file_size, mime_type, coalesce(file_hash, '') AS file_hash, rules AS yara_matches,
           rule_score AS yara_threat_score, is_malware, malware_family,
           strftime(TIMESTAMP '{AS_OF}' - (p_partkey % 50) * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS analyzed_at FROM a_scored""", FILES)
def sink_attachment_rows(spark, sf):
    return plain(append_and_read(file_facts(spark, sf), "attachment_analyses", "analyzed_at"))


@register("attachment_features", "SELECT * REPLACE (has_attachments::BIGINT AS has_attachments) FROM a_features", FILES)
def attachment_features(spark, sf):
    return plain(attachments.attachment_features(files_of(spark, sf)))
