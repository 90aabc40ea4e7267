"""Explicit schemas of the landing files and feeds; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

HEADER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])

ATTACHMENT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("contentType", T.StringType()),
    T.StructField("contentBytes", T.StringType()),
])

EMAIL = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("user_email", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("recipients", T.ArrayType(T.StringType())),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("subject", T.StringType()),
    T.StructField("body", T.StructType([
        T.StructField("contentType", T.StringType()),
        T.StructField("content", T.StringType()),
    ])),
    T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("hasAttachments", T.BooleanType()),
    T.StructField("attachments", T.ArrayType(ATTACHMENT)),
    T.StructField("conv_id", T.StringType()),
    T.StructField("lang", T.StringType()),
])

NOTIFICATION = T.StructType([
    T.StructField("value", T.ArrayType(T.StructType([
        T.StructField("changeType", T.StringType()),
        T.StructField("resource", T.StringType()),
    ]))),
])

# Scan report of a URL or file: {positives, total, scans: {engine: {detected, result}}}
SCAN_REPORT = T.StructType([
    T.StructField("positives", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("scans", T.MapType(T.StringType(), T.StructType([
        T.StructField("detected", T.BooleanType()),
        T.StructField("result", T.StringType()),
    ]))),
])

# Host report: {detections: {count, engines: {engine: {detected, category}}}}
HOST_REPORT = T.StructType([
    T.StructField("detections", T.StructType([
        T.StructField("count", T.LongType()),
        T.StructField("engines", T.MapType(T.StringType(), T.StructType([
            T.StructField("detected", T.BooleanType()),
            T.StructField("category", T.StringType()),
        ]))),
    ])),
])

TRAINING_FEATURES = [
    "urgent_words_count", "suspicious_links_count", "spelling_errors", "url_length",
    "suspicious_domains", "url_shorteners", "spf_pass", "dkim_pass", "sender_reputation",
    "has_attachments", "suspicious_extensions",
]

TRAINING = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in TRAINING_FEATURES]
    + [T.StructField("is_phishing", T.IntegerType())]
)

AUDIT = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("user_email", T.StringType()),
    T.StructField("resource_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
])

ANALYSIS_FACT = T.StructType([
    T.StructField("email_id", T.StringType()),
    T.StructField("sender_email", T.StringType()),
    T.StructField("recipient_email", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("threat_level", T.StringType()),
    T.StructField("threat_score", T.DoubleType()),
    T.StructField("is_phishing", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("analysis_details", T.StringType()),
    T.StructField("is_quarantined", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])
