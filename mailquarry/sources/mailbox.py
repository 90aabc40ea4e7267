"""Reading mails, notifications and training rows from landing files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry import schemas


def read_mails(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landing files with the fixed mail schema."""
    return spark.read.schema(schemas.EMAIL).format(fmt).load(path)


def read_mailbox(mails: DataFrame, user: str, folder: str = "inbox", limit: int = 50,
                 condition: Column | None = None) -> DataFrame:
    """Newest mails of one user's folder."""
    found = mails.filter((F.col("user_email") == user) & (F.col("folder") == folder))
    if condition is not None:
        found = found.filter(condition)
    return found.orderBy(F.desc("received_at"), "message_id").limit(limit)


def mail_details(mails: DataFrame, ids: DataFrame) -> DataFrame:
    """Full records of the wanted message ids."""
    return mails.join(ids.select("message_id").distinct(), "message_id", "left_semi")


def inbox_lookback(mails: DataFrame, user: str, as_of: Column, days_back: int = 7, limit: int = 100) -> DataFrame:
    """Inbox mails of the last days, newest first."""
    start = as_of - F.expr(f"interval {int(days_back)} days")
    return read_mailbox(mails, user, "inbox", limit, (F.col("received_at") >= start) & (F.col("received_at") <= as_of))


def attachment_records(mails: DataFrame) -> DataFrame:
    """Attachment records with the decoded size of their content."""
    return mails.select("message_id", F.posexplode("attachments").alias("pos", "a")).select(
        "message_id", "pos", F.col("a.name").alias("name"), F.col("a.size").alias("size"),
        F.col("a.contentType").alias("content_type"), F.length(F.try_to_binary("a.contentBytes", F.lit("base64"))).alias("bytes"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Attachment files of a folder as (path, length, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def new_message_ids(notifications: DataFrame) -> DataFrame:
    """Message ids of 'created' notifications about messages; works on a batch and on a stream."""
    parts = F.split("n.resource", "/")
    return (
        notifications.select(F.explode("value").alias("n"))
        .filter((F.col("n.changeType") == "created") & F.contains("n.resource", F.lit("messages")))
        .filter(F.get(parts, F.lit(3)) == "messages")
        .select(F.get(parts, F.lit(4)).alias("message_id")).filter("message_id is not null")
    )


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    """Stream of notification files."""
    return spark.readStream.schema(schemas.NOTIFICATION).json(path)


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows from CSV with a header; types are fixed, not inferred."""
    return spark.read.schema(schemas.TRAINING).option("header", True).option("mode", "PERMISSIVE").csv(path)
