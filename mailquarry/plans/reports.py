"""Reports over the analysis facts. ``as_of`` replaces the wall clock in every window.

Levels: the fact table has four; reports with three levels count CRITICAL as HIGH.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.sinks.facts import staged


def since(as_of: str, column: str, interval: str, open_start: bool = False) -> Column:
    """From ``as_of`` minus the interval (left out with ``open_start``) up to ``as_of``.

    A literal range on the time column, so date partitions and Parquet statistics prune the scan.
    """
    end = F.lit(as_of).cast("timestamp_ntz")
    start = F.expr(f"cast('{as_of}' as timestamp_ntz) - interval {interval}")
    begun = F.col(column) > start if open_start else F.col(column) >= start
    return begun & (F.col(column) <= end)



def within(facts: DataFrame, as_of: str, column: str, interval: str, open_start: bool = False) -> DataFrame:
    """Rows of the period. A table partitioned by ``day`` is cut to the days of the period as well,
    which the optimiser cannot derive from the time column."""
    found = facts.filter(since(as_of, column, interval, open_start))
    if "day" not in facts.columns:
        return found
    first = F.to_date(F.expr(f"cast('{as_of}' as timestamp_ntz) - interval {interval}"))
    return found.filter(F.col("day").between(first, F.to_date(F.lit(as_of))))


def of_day(facts: DataFrame, day: str) -> DataFrame:
    """Rows of one calendar day."""
    found = facts.filter(on_day(day))
    return found.filter(F.col("day") == F.to_date(F.lit(day))) if "day" in facts.columns else found


def is_high() -> Column:
    return F.col("threat_level").isin("HIGH", "CRITICAL")


def geo_sources(facts: DataFrame) -> DataFrame:
    """Mails, senders and threats per country of origin."""
    return facts.groupBy("sender_country").agg(
        F.count(F.lit(1)).alias("mails"), F.countDistinct("sender_email").alias("senders"),
        F.count_if(is_high()).alias("threats"))


def _count_level(level: str) -> Column:
    return is_high() if level == "HIGH" else F.col("threat_level") == level


def overall(facts: DataFrame, as_of: str) -> DataFrame:
    """Thirty days: totals, phishing, means and counts per confidence level, in one scan."""
    return within(facts, as_of, "created_at", "30 days", open_start=True).agg(
        F.count(F.lit(1)).alias("total_analyses"), F.count_if("is_phishing").alias("phishing_detected"),
        F.avg("threat_score").alias("avg_threat_score"), F.avg("duration_ms").alias("avg_processing_time"),
        *[F.count_if(F.col("threat_level") == level).alias(f"{level.lower()}_threats")
          for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])


def link_stats(facts: DataFrame, as_of: str) -> DataFrame:
    return within(facts, as_of, "analyzed_at", "30 days", open_start=True).agg(
        F.count(F.lit(1)).alias("total_urls"), F.count_if("is_malicious").alias("malicious_urls"),
        F.avg("virustotal_score").alias("avg_vt_score"), F.avg("urlvoid_score").alias("avg_uv_score"),
        F.countDistinct("domain").alias("unique_domains"))


def attachment_stats(facts: DataFrame, as_of: str) -> DataFrame:
    return within(facts, as_of, "analyzed_at", "30 days", open_start=True).agg(
        F.count(F.lit(1)).alias("total_attachments"), F.count_if("is_malware").alias("malware_count"),
        F.avg("yara_threat_score").alias("avg_yara_score"),
        F.countDistinct(F.when(F.col("malware_family") != "", F.col("malware_family"))).alias("malware_families"),
        F.count_if(F.size("yara_matches") > 0).alias("yara_detections"))


def header_stats(facts: DataFrame, as_of: str) -> DataFrame:
    return within(facts, as_of, "analyzed_at", "30 days", open_start=True).agg(
        F.count(F.lit(1)).alias("total_analyses"),
        F.count_if(F.col("spf_result") == "pass").alias("spf_pass_count"),
        F.count_if(F.col("dkim_result") == "pass").alias("dkim_pass_count"),
        F.count_if(F.col("dmarc_result") == "pass").alias("dmarc_pass_count"),
        F.count_if("suspicious_routing").alias("suspicious_routing_count"),
        F.count_if("timestamp_anomalies").alias("timestamp_anomaly_count"),
        F.avg("header_authenticity_score").alias("avg_header_score"))


def system_stats(facts: DataFrame, as_of: str) -> DataFrame:
    """Twenty-four hours: total, per level, quarantined."""
    return within(facts, as_of, "created_at", "24 hours").agg(
        F.count(F.lit(1)).alias("total_emails"),
        *[F.count_if(_count_level(level)).alias(f"{level.lower()}_threats") for level in ("HIGH", "MEDIUM", "LOW")],
        F.count_if("is_quarantined").alias("quarantined"))


def on_day(day: str, column: str = "created_at") -> Column:
    """A range on the time column, so that partitions and statistics can prune."""
    start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    return (F.col(column) >= start) & (F.col(column) < start + F.expr("interval 1 day"))


def daily_summary(facts: DataFrame, day: str) -> DataFrame:
    return of_day(facts, day).agg(
        F.count(F.lit(1)).alias("total_emails"),
        *[F.count_if(_count_level(level)).alias(f"{level.lower()}_threats") for level in ("HIGH", "MEDIUM", "LOW")],
        F.count_if("is_quarantined").alias("quarantined"),
        F.coalesce(F.avg("threat_score"), F.lit(0.0)).alias("average_threat_score"))


def top_senders(facts: DataFrame, day: str, n: int = 10) -> DataFrame:
    """Senders with most HIGH or MEDIUM mails of a day."""
    return (
        of_day(facts, day).filter(is_high() | (F.col("threat_level") == "MEDIUM"))
        .groupBy("sender_email")
        .agg(F.count(F.lit(1)).alias("threat_count"), F.avg("threat_score").alias("avg_score"))
        .orderBy(F.desc("threat_count"), F.desc("avg_score"), "sender_email").limit(n)
    )


def newest_active_models(models: DataFrame) -> DataFrame:
    """The newest active version of each model."""
    newest = models.filter("is_active").groupBy("model_name").agg(F.max_by(
        F.struct("version", "accuracy", "precision_score", "recall", "f1_score", "training_date"),
        F.struct("training_date", "version")).alias("m"))
    return newest.select("model_name", "m.*")


def daily_document(facts: DataFrame, models: DataFrame, day: str) -> DataFrame:
    """Summary, ten top senders and active models of a day as one JSON document.

    Each part is at most a handful of rows when it is nested.
    """
    summary = daily_summary(facts, day).select(F.struct(
        "total_emails", "high_threats", "medium_threats", "low_threats", "quarantined",
        F.round("average_threat_score", 6).alias("average_threat_score")).alias("summary"))
    senders = top_senders(facts, day).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("threat_count")).alias("o1"), (-F.col("avg_score")).alias("o2"), F.col("sender_email").alias("sender"),
        F.col("threat_count"), F.round("avg_score", 6).alias("average_score")))).alias("s")).select(
        F.transform("s", lambda x: F.struct(x["sender"].alias("sender"), x["threat_count"].alias("threat_count"),
                                            x["average_score"].alias("average_score"))).alias("top_threat_senders"))
    active = newest_active_models(models).agg(F.array_sort(F.collect_list(F.struct(
        F.col("model_name").alias("model"), F.round("accuracy", 6).alias("accuracy"),
        F.round("precision_score", 6).alias("precision"), F.round("recall", 6).alias("recall"),
        F.round("f1_score", 6).alias("f1_score")))).alias("model_performance"))
    # three one-row frames meet on the report date
    keyed = [p.withColumn("date", F.lit(day)) for p in (summary, senders, active)]
    joined = keyed[0].join(keyed[1], "date").join(keyed[2], "date")
    return joined.select(F.col("date").alias("report_date"), F.to_json(F.struct(
        "date", "summary", "top_threat_senders", "model_performance")).alias("report_data"))


def weekly_by_day(facts: DataFrame, as_of: str) -> DataFrame:
    return (
        within(facts, as_of, "created_at", "7 days").groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("total_emails"), F.count_if(is_high()).alias("high_threats"),
             F.avg("threat_score").alias("avg_score"))
    )


def weekly_totals(facts: DataFrame, as_of: str) -> DataFrame:
    """Sums over the days and the share of HIGH mails in percent."""
    totals = weekly_by_day(facts, as_of).agg(
        F.coalesce(F.sum("total_emails"), F.lit(0)).alias("total_emails"),
        F.coalesce(F.sum("high_threats"), F.lit(0)).alias("total_high_threats"))
    rate = F.round(F.coalesce(F.try_divide(F.col("total_high_threats"), F.col("total_emails")) * 100, F.lit(0.0)), 2)
    return totals.select("total_emails", "total_high_threats", rate.alias("threat_rate_percent"))


def threat_trends(facts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Counts per date and level, zero where a level is missing."""
    level = F.when(is_high(), "HIGH").otherwise(F.col("threat_level"))
    return (
        within(facts, as_of, "created_at", f"{int(days)} days")
        .select(F.to_date("created_at").alias("date"), level.alias("level"))
        .groupBy("date").pivot("level", ["HIGH", "MEDIUM", "LOW"]).count().na.fill(0)
    )


def user_risk(facts: DataFrame, as_of: str) -> DataFrame:
    """Risk profile of every recipient over thirty days."""
    profile = within(facts, as_of, "created_at", "30 days").groupBy("recipient_email").agg(
        F.count(F.lit(1)).alias("total_emails"), F.count_if(is_high()).alias("high_threat_emails"),
        F.avg("threat_score").alias("average_threat_score"), F.max("created_at").alias("last_threat_date"))
    return profile.withColumn(
        "risk_level", F.when(F.col("high_threat_emails") > 5, "HIGH")
        .when(F.col("high_threat_emails") > 1, "MEDIUM").otherwise("LOW"))


def indicator_effect(facts: DataFrame, as_of: str) -> DataFrame:
    return within(facts, as_of, "created_at", "30 days").groupBy("threat_type").agg(
        F.count(F.lit(1)).alias("detections"), F.avg("confidence").alias("avg_confidence"),
        F.sum(F.col("verified_threat").cast("int")).alias("true_positives"))


def language_distribution(facts: DataFrame, as_of: str) -> DataFrame:
    return within(facts, as_of, "created_at", "7 days").groupBy("lang", "threat_level").agg(
        F.count(F.lit(1)).alias("count"), F.avg("manipulation_score").alias("avg_manipulation"))


def model_latency(predictions: DataFrame, as_of: str) -> DataFrame:
    return within(predictions, as_of, "created_at", "24 hours").groupBy("model_name").agg(
        F.avg("inference_ms").alias("avg_inference_time"),
        F.avg(F.abs(F.col("probability") - 0.5) * 2).alias("avg_confidence"),
        F.count(F.lit(1)).alias("predictions_made"))


def attack_vectors(facts: DataFrame) -> DataFrame:
    """Counts by category, language and level with all sub-totals."""
    cubed = facts.cube("threat_category", "lang", "threat_level").agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("grouping"))
    return cubed.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in ("threat_category", "lang", "threat_level")],
                        "count", "grouping")


def trend_delta(facts: DataFrame) -> DataFrame:
    """Per level and day: count, change to the previous day and seven-day moving average.

    The windows run over one row per level and day.
    """
    daily = facts.groupBy("threat_level", F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("threat_level").orderBy("date")
    return daily.select(
        "threat_level", "date", "count", (F.col("count") - F.lag("count").over(w)).alias("change"),
        F.avg("count").over(w.rowsBetween(-6, 0)).alias("moving_average"))


def recent_activity(facts: DataFrame, n: int = 10) -> DataFrame:
    return facts.select("email_id", "sender_email", "subject", "threat_level", "threat_score", "created_at").orderBy(
        F.desc("created_at"), "email_id").limit(n)


def quarantine_index(facts: DataFrame) -> DataFrame:
    """(second, n): mails in quarantine by second of ``created_at`` as text, empty for those without a time."""
    second = F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return facts.filter("is_quarantined").groupBy(second.alias("second")).agg(F.count(F.lit(1)).alias("n"))


def _holding(counts: DataFrame, skip: int, limit: int) -> tuple[str, str, int] | None:
    """Of (part, n): the newest and the oldest part with rows from ``skip`` to ``skip + limit``, and the rows before the first."""
    newest, oldest, before, seen = None, None, 0, 0
    for part, n in sorted(counts.collect(), reverse=True):
        if newest is None and seen + n > skip:
            newest, before = part, seen
        oldest, seen = part, seen + n
        if seen >= skip + limit:
            break
    return None if newest is None else (newest, oldest, before)


def quarantine_page(facts: DataFrame, page: int = 1, limit: int = 50, index: DataFrame | None = None) -> DataFrame:
    """One page of the quarantine, newest first; mails without a time come last.

    The counts of ``index`` (see ``quarantine_index``; made here if not given, written once for many pages) lead to the days and
    then to the seconds that hold the page. Only that range of ``created_at`` is read and sorted, however far back it lies. The
    driver sees one number for each day, and for each second of the page's days.
    """
    found = facts.filter("is_quarantined").select("email_id", "sender_email", "subject", "threat_level", "threat_score", "created_at")
    index = staged(quarantine_index(facts), "quarantine-index") if index is None else index
    skip = (page - 1) * limit
    day = F.substring("second", 1, 10)
    days = _holding(index.groupBy(day.alias("part")).agg(F.sum("n").alias("n")), skip, limit)
    if days is None:
        return found.limit(0)
    newest, oldest, before = days
    skip -= before
    newest, oldest, before = _holding(index.filter(day.between(oldest, newest)).select(F.col("second").alias("part"), "n"), skip, limit)
    at = F.col("created_at")
    time = facts.schema["created_at"].dataType
    inside = at.isNull()
    if newest:
        inside = at < F.lit(newest).cast(time) + F.expr("interval 1 second")
        inside = (inside & (at >= F.lit(oldest).cast(time))) if oldest else (inside | at.isNull())
    return found.filter(inside).orderBy(F.desc("created_at"), "email_id").offset(skip - before).limit(limit)


def monitoring_rollup(facts: DataFrame) -> DataFrame:
    """Per user: processed mails, threats, false positives, last activity."""
    return facts.groupBy("recipient_email").agg(
        F.count(F.lit(1)).alias("emails_processed"), F.count_if("is_phishing").alias("threats_detected"),
        F.count_if(F.coalesce("false_positive", F.lit(False))).alias("false_positives"),
        F.max("created_at").alias("last_activity"))
