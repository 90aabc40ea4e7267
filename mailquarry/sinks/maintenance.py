"""Table maintenance without MERGE: upsert, retention, cascade, release, model and subscription care."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.sinks.facts import new_table_path, staged, write_days

# replaced when a mail is analysed again; sender, recipient, subject and created_at stay
REPLACED = ["threat_level", "threat_score", "is_phishing", "confidence", "analysis_details"]
KEPT = ["sender_email", "recipient_email", "subject"]


def quarantined(level: Column) -> Column:
    return level.isin("HIGH", "CRITICAL")


def latest_results(incoming: DataFrame) -> DataFrame:
    """One row per email_id: the newest result, the first one's identity columns.

    Aggregates instead of a window, so repeats of one mail are reduced before the shuffle.
    """
    order = F.struct("received_at", "seq")
    return incoming.groupBy("email_id").agg(
        F.max_by(F.struct(*REPLACED), order).alias("last"), F.min_by(F.struct(*KEPT), order).alias("first"),
        F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"),
        F.count(F.lit(1)).alias("times"))


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Current facts with new results applied by email_id."""
    new = latest_results(incoming).withColumnRenamed("email_id", "_id")
    joined = current.join(new, F.col("email_id") == F.col("_id"), "full_outer")
    hit = F.col("_id").isNotNull()
    known = F.col("email_id").isNotNull()
    # the result that made the row, delivered again
    same = (F.col("times") == 1) & F.col("created_at").eqNullSafe(F.col("first_at"))
    for c in REPLACED:
        same = same & F.col(c).eqNullSafe(F.col(f"last.{c}"))
    columns = [F.coalesce("email_id", "_id").alias("email_id")]
    columns += [F.when(known, F.col(c)).otherwise(F.col(f"first.{c}")).alias(c) for c in KEPT]
    columns += [F.when(hit, F.col(f"last.{c}")).otherwise(F.col(c)).alias(c) for c in REPLACED]
    columns += [
        F.when(hit, quarantined(F.col("last.threat_level"))).otherwise(F.col("is_quarantined")).alias("is_quarantined"),
        F.when(known, F.col("created_at")).otherwise(F.col("first_at")).alias("created_at"),
        F.when(hit & ((known & ~same) | (F.col("times") > 1)), F.col("last_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    ]
    return joined.select(columns)


def upsert_table(spark, path: str, incoming: DataFrame, facts: DataFrame | None = None) -> None:
    """Apply results to a fact table partitioned by ``day``, rewriting only the days they touch.

    The days of known mails are found by reading two columns. They are a table of their own, which prunes the partitions to read: a long
    history has very many days, too many for a list in the plan. The merged rows are written to a staging folder first, then the
    touched partitions are replaced; a repeat gives the same rows. ``facts`` is the table where it has been opened already: its folders
    are listed only once then.
    """
    new = latest_results(incoming).select("email_id", "first_at")
    facts = spark.read.parquet(path) if facts is None else facts
    touched = facts.select("email_id", "day").join(new.select("email_id"), "email_id", "left_semi").select("day").union(
        new.select(F.to_date("first_at").alias("day"))).distinct()
    # one row per calendar day
    touched = staged(touched, "touched-days")
    if touched.isEmpty():
        return
    merged = upsert(facts.join(F.broadcast(touched), "day", "left_semi").drop("day"), incoming).withColumn("day", F.to_date("created_at"))
    staging = new_table_path(spark, "upsert")
    merged.write.parquet(staging)
    write_days(spark.read.parquet(staging), path, "overwrite")


def retain(facts: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Rows that aren't both older than the cutoff and out of quarantine; a null time or flag keeps a row."""
    cutoff = F.expr(f"cast('{as_of}' as timestamp_ntz) - interval {int(days)} days")
    return facts.filter(~F.coalesce((F.col("created_at") < cutoff) & ~F.col("is_quarantined"), F.lit(False)))


def retain_metrics(metrics: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Rows that aren't older than the cutoff; a row without a time stays."""
    cutoff = F.expr(f"cast('{as_of}' as timestamp_ntz) - interval {int(days)} days")
    return metrics.filter(~F.coalesce(F.col("created_at") < cutoff, F.lit(False)))


def without_orphans(children: DataFrame, parents: DataFrame, key: str = "email_analysis_id") -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def release(facts: DataFrame, releases: DataFrame, as_of: str) -> DataFrame:
    """Apply the latest release event of each mail up to ``as_of``."""
    latest = releases.filter(F.col("released_at") <= F.lit(as_of).cast("timestamp_ntz")).groupBy("email_id").agg(
        F.max("released_at").alias("released_at"), F.max_by("released_by", F.struct("released_at", "released_by")).alias("released_by"))
    return facts.join(latest, "email_id", "left").withColumn(
        "is_quarantined", F.col("is_quarantined") & F.col("released_at").isNull())


def deactivate_old(models: DataFrame, as_of: str) -> DataFrame:
    """Switch off versions trained more than a day before; the rest keep their state."""
    cutoff = F.expr(f"cast('{as_of}' as timestamp_ntz) - interval 1 day")
    return models.withColumn("is_active", F.when(F.col("training_date") < cutoff, F.lit(False)).otherwise(F.col("is_active")))


def renew_subscriptions(subscriptions: DataFrame, as_of: str) -> DataFrame:
    """Drop expired subscriptions and extend those that end within twelve hours by three days."""
    now = F.lit(as_of).cast("timestamp_ntz")
    due = F.col("expires_at") - now < F.expr("interval 12 hours")
    return subscriptions.filter(F.col("expires_at") >= now).select(
        "user_email", "subscription_id", due.alias("renewed"),
        F.when(due, now + F.expr("interval 3 days")).otherwise(F.col("expires_at")).alias("expires_at"))
