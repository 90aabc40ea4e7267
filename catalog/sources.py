"""Source jobs: each writes the given tables as landing files and reads them back."""

import uuid

from pyspark.sql import functions as F

from catalog.registry import plain, register
from datasets.mails import attachments as files_of
from datasets.views import view
from mailquarry.session import shared_dir
from mailquarry.sources import mailbox

USER = "user7@corp.example.com"


def landed_mails(spark, sf):
    """Mails as JSON landing files in the mail schema."""
    mails = view(spark, sf, "v_emails").select(
        "message_id", "user_email", "folder", "sender", "recipients", F.col("received_at").cast("timestamp").alias("received_at"),
        "subject", F.struct(F.col("content_type").alias("contentType"), "content").alias("body"), "lang")
    path = f"{shared_dir(spark)}/mails-{uuid.uuid4().hex}"
    mails.write.json(path)
    return mailbox.read_mails(spark, path)


_FULL = "message_id, sender, subject, md5(content) AS content_md5, array_to_string(recipients, '|') AS recipients, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at"


def _shown(df):
    return plain(df.select("message_id", "sender", "subject", F.md5("body.content").alias("content_md5"), "recipients", "received_at"))


@register("src_mailbox", f"""
    SELECT {_FULL} FROM (SELECT * FROM v_emails WHERE user_email = '{USER}' AND folder = 'inbox' AND subject <> 'Team lunch'
                         ORDER BY received_at DESC, message_id LIMIT 50) x""")
def src_mailbox(spark, sf):
    return _shown(mailbox.read_mailbox(landed_mails(spark, sf), USER, "inbox", 50, F.col("subject") != "Team lunch"))


@register("src_mail_detail", f"SELECT {_FULL} FROM v_emails WHERE message_id IN (SELECT message_id FROM v_urls)")
def src_mail_detail(spark, sf):
    return _shown(mailbox.mail_details(landed_mails(spark, sf), view(spark, sf, "v_urls")))


@register("src_attachments", """
    SELECT message_id, p_partkey, filename AS name, file_size AS size, mime_type AS content_type, octet_length(encode(data)) AS bytes FROM v_attachments""")
def src_attachments(spark, sf):
    nested = files_of(spark, sf).select(F.concat_ws("/", "message_id", "p_partkey").alias("message_id"), F.array(F.struct(
        F.col("filename").alias("name"), F.col("file_size").alias("size"), F.col("mime_type").alias("contentType"),
        F.col("file_data").alias("contentBytes"))).alias("attachments"))
    path = f"{shared_dir(spark)}/attached-{uuid.uuid4().hex}"
    nested.write.json(path)
    found = mailbox.attachment_records(mailbox.read_mails(spark, path))
    parts = F.split("message_id", "/")
    return plain(found.select(parts[0].alias("message_id"), parts[1].cast("bigint").alias("p_partkey"),
                              "name", "size", "content_type", "bytes"))


@register("src_inbox_lookback", f"""
    SELECT {_FULL} FROM (SELECT * FROM v_emails WHERE user_email = '{USER}' AND folder = 'inbox'
        AND received_at >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY AND received_at <= TIMESTAMP '2024-01-25 00:00:00'
        ORDER BY received_at DESC, message_id LIMIT 100) x""")
def src_inbox_lookback(spark, sf):
    return _shown(mailbox.inbox_lookback(
        landed_mails(spark, sf), USER, F.lit("2024-01-25 00:00:00").cast("timestamp")))


def write_notifications(spark, sf):
    """Notifications as JSON files: two per event, some of other kinds."""
    made = view(spark, sf, "events").select(F.array(
        F.struct(F.when(F.col("event_id") % 4 == 0, "updated").otherwise("created").alias("changeType"),
                 F.concat(F.lit("/users/u"), F.col("user_id").cast("string"), F.lit("/messages/m"), F.col("event_id").cast("string")).alias("resource")),
        F.struct(F.lit("created").alias("changeType"),
                 F.concat(F.lit("/users/u"), F.col("user_id").cast("string"), F.lit("/events/e"), F.col("event_id").cast("string")).alias("resource")),
    ).alias("value"))
    path = f"{shared_dir(spark)}/notifications-{uuid.uuid4().hex}"
    made.write.json(path)
    return path


@register("src_notifications", "SELECT 'm' || event_id AS message_id FROM events WHERE event_id % 4 <> 0")
def src_notifications(spark, sf):
    from mailquarry.streaming.jobs import drain

    ids = mailbox.new_message_ids(mailbox.read_notifications(spark, write_notifications(spark, sf)))
    return drain(ids, "notifications")


@register("src_training_csv", """
    SELECT count(*) AS total, is_phishing::BIGINT AS is_phishing, sum(urgent_words_count)::DOUBLE AS urgent, sum(spelling_errors)::DOUBLE AS spelling,
           round(sum(url_length), 4) AS url_length
    FROM (SELECT doc_id % 6 AS urgent_words_count, doc_id % 5 AS spelling_errors, n_chars / 10e0 AS url_length, (doc_id % 4 = 0)::INT AS is_phishing FROM documents) x
    GROUP BY is_phishing""")
def src_training_csv(spark, sf):
    d = F.col("doc_id")
    rows = view(spark, sf, "documents").select(
        (d % 6).alias("urgent_words_count"), (d % 3).alias("suspicious_links_count"), (d % 5).alias("spelling_errors"),
        (F.col("n_chars") / 10).alias("url_length"), (d % 2).alias("suspicious_domains"), (d % 7).alias("url_shorteners"),
        (d % 2).alias("spf_pass"), (d % 3 % 2).alias("dkim_pass"), ((d % 10) / 10).alias("sender_reputation"),
        (d % 2).alias("has_attachments"), (d % 4).alias("suspicious_extensions"), (d % 4 == 0).cast("int").alias("is_phishing"))
    path = f"{shared_dir(spark)}/training-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    read = mailbox.read_training_csv(spark, path)
    return plain(read.groupBy("is_phishing").agg(
        F.count(F.lit(1)).alias("total"), F.round(F.sum("urgent_words_count"), 6).alias("urgent"),
        F.round(F.sum("spelling_errors"), 6).alias("spelling"), F.round(F.sum("url_length"), 4).alias("url_length")))


