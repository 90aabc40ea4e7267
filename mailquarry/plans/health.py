"""Health figures over the fact and metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.plans.reports import within

STATUS_RANK = {"healthy": 0, "warning": 1, "critical": 2}


def status(critical: Column, warning: Column) -> Column:
    return F.when(critical, "critical").when(warning, "warning").otherwise("healthy")


def recent(facts: DataFrame, as_of: str) -> DataFrame:
    """Analyses in the last hour."""
    return within(facts, as_of, "created_at", "1 hour").agg(F.count(F.lit(1)).alias("recent_analyses"))


def performance(facts: DataFrame, as_of: str) -> DataFrame:
    """Mean time and error share of the last hour with their status."""
    measured = within(facts, as_of, "created_at", "1 hour").agg(
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("mean_ms"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "error").alias("errors"))
    rate = F.coalesce(F.try_divide(F.col("errors"), F.col("n")) * 100, F.lit(0.0))
    rated = measured.withColumn("rate", rate)
    mean, share = F.col("mean_ms"), F.col("rate")
    return rated.select(
        status((mean > 10000) | (share > 15), (mean > 5000) | (share > 5)).alias("status"),
        F.round("mean_ms", 2).alias("avg_processing_time_ms"), F.col("n").alias("emails_processed_hour"),
        F.round("rate", 2).alias("error_rate_percent"))


def models(registry: DataFrame, as_of: str) -> DataFrame:
    """Active models: count, mean accuracy, age of the oldest and status."""
    at = F.lit(as_of).cast("timestamp_ntz")
    active = registry.filter("is_active").agg(
        F.count(F.lit(1)).alias("active_models"), F.round(F.avg("accuracy"), 3).alias("average_accuracy"),
        F.min("training_date").alias("oldest"))
    age = F.floor((F.unix_timestamp(at.cast("timestamp")) - F.unix_timestamp(F.col("oldest").cast("timestamp"))) / 86400)
    aged = active.withColumn("oldest_model_days", age)
    days = F.col("oldest_model_days")
    return aged.select(
        status((F.col("active_models") == 0) | (days > 30), days > 7).alias("status"),
        "active_models", "average_accuracy", "oldest_model_days")


def overall(components: dict[str, DataFrame]) -> DataFrame:
    """Worst status over the components."""
    rank = F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])
    rows = reduce(DataFrame.unionByName, [
        c.select(F.lit(name).alias("component"), "status") for name, c in components.items()])
    return rows.agg(
        F.max_by("status", rank[F.col("status")]).alias("overall_status"),
        F.count(F.lit(1)).alias("components"),
        F.count_if(F.col("status") != "healthy").alias("unhealthy_components"))
