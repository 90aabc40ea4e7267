"""Sender behaviour and the communication graph.

History rows: message_id, sender, recipients array, sent_at, body_length, subject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.functions.text import flags
from mailquarry.plans.skew import top_per_key

MIN_HISTORY = 10
RECENT_DAYS = 7
COMMON_RECIPIENTS = 5
COMMON_SUBJECTS = 10
VOLUME_FACTOR = 3


def edges(history: DataFrame) -> DataFrame:
    """(sender, recipient, sent_at, weight) rows."""
    return history.select("sender", F.explode("recipients").alias("recipient"), "sent_at", F.lit(1).alias("weight"))


def nodes(history: DataFrame) -> DataFrame:
    """Distinct senders and recipients."""
    return history.select(F.col("sender").alias("node")).union(
        history.select(F.explode("recipients").alias("node"))).distinct()


def sender_volumes(history: DataFrame) -> DataFrame:
    return history.groupBy("sender").agg(F.sum(F.size("recipients")).alias("email_count")).filter("email_count > 0")


def high_volume_senders(history: DataFrame) -> DataFrame:
    """Senders above three times the mean number of edges per sender."""
    volumes = sender_volumes(history)
    mean = volumes.agg(F.avg("email_count")).scalar()
    return volumes.filter(F.col("email_count") > mean * VOLUME_FACTOR).select(
        F.lit("high_volume_sender").alias("type"), "sender", "email_count", F.lit("medium").alias("severity"))


def graph_stats(history: DataFrame) -> DataFrame:
    """Node, edge and anomaly counts and the score."""
    counted = (
        nodes(history).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("k"), "n")
        .unionByName(history.agg(F.sum(F.size("recipients")).alias("n")).select(F.lit("edges").alias("k"), "n"))
        .unionByName(high_volume_senders(history).agg(F.count(F.lit(1)).alias("n")).select(F.lit("anomalies").alias("k"), "n"))
    )
    return counted.agg(
        F.sum(F.when(F.col("k") == "nodes", F.col("n"))).alias("total_nodes"),
        F.sum(F.when(F.col("k") == "edges", F.col("n"))).alias("total_edges"),
        F.sum(F.when(F.col("k") == "anomalies", F.col("n"))).alias("anomalies_detected"),
    ).withColumn("threat_score", F.col("anomalies_detected") * F.lit(0.2))


def top_recipients(history: DataFrame, n: int = COMMON_RECIPIENTS) -> DataFrame:
    """Most frequent recipients per sender; equal counts go by first appearance.

    Counted per (sender, recipient) first, then cut to ``n`` per task before the ranking shuffle.
    """
    sent = history.select("sender", "sent_at", "message_id", F.posexplode("recipients").alias("pos", "recipient"))
    counted = sent.groupBy("sender", "recipient").agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct("sent_at", "message_id", "pos")).alias("first_seen"))
    return top_per_key(counted, ["sender"], [F.desc("count"), F.asc("first_seen")], n).select(
        "sender", "recipient", "count", "rank")


def first_subjects(history: DataFrame, n: int = COMMON_SUBJECTS) -> DataFrame:
    """The first distinct subjects of each sender."""
    seen = history.groupBy("sender", "subject").agg(F.min(F.struct("sent_at", "message_id")).alias("first_seen"))
    return top_per_key(seen, ["sender"], [F.asc("first_seen")], n).select("sender", "subject", "rank")


def _profile(history: DataFrame) -> DataFrame:
    figures = history.groupBy("sender").agg(
        F.count(F.lit(1)).alias("mails"), F.avg("body_length").alias("avg_length"))
    common = top_recipients(history).groupBy("sender").agg(F.sort_array(F.collect_list("recipient")).alias("recipients"))
    return figures.join(common, "sender", "left").withColumn(
        "recipients", F.coalesce("recipients", F.array().cast("array<string>")))


def baseline(history: DataFrame) -> DataFrame:
    """Normal behaviour of senders with at least ten mails."""
    subjects = first_subjects(history).groupBy("sender").agg(F.sort_array(F.collect_list("subject")).alias("subjects"))
    return _profile(history).filter(F.col("mails") >= MIN_HISTORY).join(subjects, "sender", "left")


def recent(history: DataFrame, as_of: str) -> DataFrame:
    end = F.lit(as_of).cast("timestamp_ntz")
    start = F.expr(f"cast('{as_of}' as timestamp_ntz) - interval {RECENT_DAYS} days")
    return history.filter((F.col("sent_at") >= start) & (F.col("sent_at") <= end))


def current(history: DataFrame, as_of: str) -> DataFrame:
    """The same figures over the last seven days."""
    return _profile(recent(history, as_of))


def _compared(history: DataFrame, as_of: str) -> DataFrame:
    now = current(history, as_of).select(
        "sender", F.col("avg_length").alias("recent_length"), F.col("recipients").alias("recent_recipients"))
    return _profile(history).join(now, "sender", "left").withColumn(
        "recent_recipients", F.coalesce("recent_recipients", F.array().cast("array<string>")))


def anomaly(history: DataFrame, as_of: str) -> DataFrame:
    """Behaviour score per sender: change of length and of usual recipients."""
    both = _compared(history, as_of)
    change = F.abs(F.col("avg_length") - F.col("recent_length"))
    # least() skips nulls, so a sender without recent mail is taken out first
    length_part = F.when(F.col("recent_length").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.least(F.try_divide(change, F.col("avg_length")), F.lit(1.0)), F.lit(0.0)))
    overlap = F.size(F.array_intersect("recipients", "recent_recipients"))
    recipient_part = F.when(F.size("recipients") > 0, 1 - overlap / F.size("recipients")).otherwise(F.lit(0.0))
    established = F.col("mails") >= MIN_HISTORY
    scored = both.withColumn("behavioral_anomaly_score", F.when(
        established, F.least(length_part * 0.3 + recipient_part * 0.4, F.lit(1.0))).otherwise(F.lit(0.0)))
    score = F.col("behavioral_anomaly_score")
    return scored.select(
        "sender", established.alias("baseline_established"), "behavioral_anomaly_score",
        F.when(score > 0.7, "HIGH").when(score > 0.4, "MEDIUM").otherwise("LOW").alias("compromise_likelihood"))


def anomaly_flags(history: DataFrame, as_of: str) -> DataFrame:
    """(sender, flag) rows of established senders."""
    both = _compared(history, as_of).filter(F.col("mails") >= MIN_HISTORY)
    new = F.size(F.array_except("recent_recipients", "recipients"))
    # fixed flag texts
    return both.select("sender", F.explode(flags(
        (F.col("recent_length") > F.col("avg_length") * 2, "Unusually long emails"),
        (F.col("recent_length") < F.col("avg_length") * 0.5, "Unusually short emails"),
        (new > F.size("recipients") * 0.5, "Many new recipients"))).alias("flag"))


def send_hours(history: DataFrame) -> DataFrame:
    """Mails per sender and hour, with the sender's share in that hour."""
    hourly = history.groupBy("sender", F.hour("sent_at").alias("hour")).agg(F.count(F.lit(1)).alias("mails"))
    totals = hourly.groupBy("sender").agg(F.sum("mails").alias("total"))
    return hourly.join(totals, "sender").select("sender", "hour", "mails", (F.col("mails") / F.col("total")).alias("share"))
