"""Mails and attachments in the library's input shape, built on the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datasets.views import view


def _headers():
    def one(name: str, column: str):
        return F.struct(F.lit(name).alias("name"), F.col(column).alias("value"))

    single = F.array(
        one("From", "from_h"), one("Return-Path", "return_path"), one("Received-SPF", "spf"),
        one("DKIM-Signature", "dkim"), one("Authentication-Results", "auth"), one("Date", "date_h"))
    received = F.transform("hops", lambda v: F.struct(F.lit("Received").alias("name"), v.alias("value")))
    return F.concat(received, F.filter(single, lambda h: h["value"].isNotNull())).alias("headers")


def mails_with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id and headers array<struct<name, value>>."""
    return view(spark, sf_dir, "v_headers").select("message_id", "doc_id", _headers())


def full_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails with body and headers, the input of the whole scoring plan."""
    return view(spark, sf_dir, "v_mails").select(
        "message_id", "doc_id", "user_email", "sender", "recipients", "received_at", "subject",
        "content_type", "content", "lang", _headers())


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachment rows with base64 data; every fiftieth cannot be decoded."""
    return view(spark, sf_dir, "v_attachments").select(
        "message_id", "p_partkey", "filename", "file_size", "mime_type",
        F.coalesce(F.base64(F.encode("data", "UTF-8")), F.lit("*not base64*")).alias("file_data"))


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_geo_ranges")
