"""Structured Streaming forms of the jobs.

Every query has its own checkpoint in the shared folder. Batches that are written with
``foreachBatch`` go to a folder named after the batch and replace it on a repeat, so a restarted
query writes nothing twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailquarry import lexicon as lx
from mailquarry.operators import access
from mailquarry.plans.health import status
from mailquarry.session import shared_dir
from mailquarry.sinks import maintenance
from mailquarry.sinks.facts import append, staged
from mailquarry.streaming import keyed


def new_base(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_landing(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream of Parquet landing files with an explicit schema."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(stream: DataFrame, base: str) -> DataFrame:
    """Run an append stream over everything that has arrived and return all that it has written under ``base``."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint").start(f"{base}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def each_batch(stream: DataFrame, base: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run ``handle(batch, batch_id)`` over everything that has arrived."""
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint").start())
    query.awaitTermination()


def drain_latest(stream: DataFrame, base: str, keys: list[str]) -> DataFrame:
    """Run an updating aggregate over everything that has arrived and return the last state of every key."""
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    each_batch(stream, base, handle, "update")
    others = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(f"{base}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("s")).select(*keys, "s.*")


# ------------------------------------------------------------------ windowed aggregates

def tumbling_levels(facts: DataFrame, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Counts per level in tumbling windows."""
    return facts.withWatermark("created_at", lateness).groupBy(F.window("created_at", width)).agg(
        *[F.count_if(F.col("threat_level") == level).alias(level.lower()) for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.count(F.lit(1)).alias("total")).select(F.col("window.start").alias("start"), "critical", "high", "medium", "low", "total")


def sliding_stats(facts: DataFrame, width: str = "24 hours", step: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Rolling totals refreshed every step."""
    return facts.withWatermark("created_at", lateness).groupBy(F.window("created_at", width, step)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("threat_level").isin("HIGH", "CRITICAL")).alias("high"),
        F.count_if("is_quarantined").alias("quarantined")).select(
        F.col("window.start").alias("start"), "total", "high", "quarantined")


def rolling_health(facts: DataFrame, step: str = "15 minutes", lateness: str = "1 day") -> DataFrame:
    """Mean time, error share and status over a rolling hour."""
    windows = facts.withWatermark("created_at", lateness).groupBy(F.window("created_at", "1 hour", step)).agg(
        F.avg("duration_ms").alias("mean_ms"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count(F.lit(1)).alias("n"))
    share = F.col("errors") / F.col("n") * 100
    return windows.select(
        F.col("window.start").alias("start"), "n", "mean_ms", share.alias("error_rate"),
        status((F.col("mean_ms") > 10000) | (share > 15), (F.col("mean_ms") > 5000) | (share > 5)).alias("status"))


def sender_sessions(facts: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Bursts per sender: mails less than ``gap`` apart; a session is written once it is closed, and is in the state until then."""
    return facts.withWatermark("created_at", lateness).groupBy(
        F.session_window("created_at", gap), "sender_email").agg(F.count(F.lit(1)).alias("mails")).select(
        "sender_email", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "mails")


def open_sessions(spark: SparkSession, base: str) -> DataFrame:
    """(sender_email, start, end, mails) of the sessions that the last batch of a session query left open, from its state store."""
    held = spark.read.format("statestore").load(f"{base}/checkpoint").select("value.*")
    window, count = "session_window", [c for c in held.columns if c.startswith("count")][0]
    return held.select("sender_email", F.col(f"{window}.start").alias("start"), F.col(f"{window}.end").alias("end"), F.col(count).alias("mails"))


def drain_sessions(facts: DataFrame, base: str) -> DataFrame:
    """All sessions, closed ones as written and open ones as the state has them, with ``is_open``."""
    closed = drain(sender_sessions(facts), base).withColumn("is_open", F.lit(False))
    return closed.unionByName(open_sessions(facts.sparkSession, base).withColumn("is_open", F.lit(True)))


# ------------------------------------------------------------------ row streams

def alert_rows(facts: DataFrame) -> DataFrame:
    """HIGH mails of priority high."""
    return facts.filter(F.col("threat_level").isin("HIGH", "CRITICAL") & (F.col("priority") == "high")).select(
        "email_id", "threat_level", "threat_score", F.col("created_at").alias("alert_sent_at"))


def dedup(notifications: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Repeated notifications of a message within the lateness are dropped."""
    return notifications.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["message_id"])


def upsert_or_create(spark: SparkSession, path: str, results: DataFrame) -> None:
    """Apply results to the fact table, creating it with the first batch."""
    try:
        facts = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = spark.createDataFrame([], results.schema).select(
            "email_id", *maintenance.KEPT, *maintenance.REPLACED, F.lit(False).alias("is_quarantined"),
            F.col("received_at").alias("created_at"), F.col("received_at").alias("updated_at"))
        append(maintenance.upsert(empty, results), path, "created_at")
        return
    maintenance.upsert_table(spark, path, results, facts)


def score_stream(mails: DataFrame, score: Callable[[DataFrame], DataFrame], base: str) -> str:
    """Score each micro-batch with the batch plan and upsert it; returns the table path.

    ``score`` returns email_id, the identity and result columns, received_at and seq.
    """
    table = f"{base}/email_analyses"

    def handle(batch: DataFrame, batch_id: int) -> None:
        # scored once and written; the upsert reads the results several times
        upsert_or_create(batch.sparkSession, table, staged(score(batch), "scored"))

    each_batch(mails, base, handle)
    return table


def split_late(facts: DataFrame, base: str, lateness: str = "1 hour") -> tuple[str, str]:
    """Write rows older than the watermark of the earlier batches to a side table.

    The watermark is the highest time of the batches before, less the lateness. Returns the two
    folders (kept, late).
    """
    kept, late, marks = f"{base}/kept", f"{base}/late", f"{base}/marks"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        limit = F.lit("1000-01-01 00:00:00").cast("timestamp")
        if batch_id > 0:
            mark = spark.read.parquet(f"{marks}/{batch_id - 1:08d}").first()[0]
            if mark is not None:
                limit = F.lit(mark) - F.expr(f"interval {lateness}")
        # a row without a time isn't late
        is_late = F.coalesce(F.col("created_at") < limit, F.lit(False))
        batch.filter(~is_late).write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")
        batch.filter(is_late).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        newest = batch.agg(F.max("created_at").alias("mark"))
        if batch_id > 0:
            newest = newest.union(spark.read.parquet(f"{marks}/{batch_id - 1:08d}")).agg(F.max("mark").alias("mark"))
        newest.write.mode("overwrite").parquet(f"{marks}/{batch_id:08d}")

    each_batch(facts, base, handle)
    return kept, late


# ------------------------------------------------------------------ keyed windows

def rate_limit_stream(requests: DataFrame, base: str, window: int = lx.RATE_WINDOW_SECONDS, limits: dict[str, int] | None = None,
                      lateness: str = "1 day") -> DataFrame:
    """Rate-limit decisions per request (request_id, class, key, start, allowed); the open window of a key is keyed state."""
    named = requests.withColumn("class", access.request_class()).withColumn("ip", access.client_ip())
    allowance = keyed.by_class(F.col("class"), limits or lx.RATE_LIMITS)
    events = named.select(F.col("request_id").alias("id"), F.concat_ws(":", "class", "ip").alias("key"), allowance.alias("allowance"), "ts")
    decided = keyed.drained(keyed.admitted(events, window, lateness), base)
    kind = requests.schema["request_id"].dataType
    return decided.select(F.col("id").cast(kind).alias("request_id"), F.substring_index("key", ":", 1).alias("class"), "key", "start", F.col("admitted").alias("allowed"))


def lookup_cache_stream(lookups: DataFrame, base: str, ttl: int = lx.IOC_TTL_SECONDS, lateness: str = "1 day") -> DataFrame:
    """Cache decisions per lookup (lookup_id, key, start, refreshed): the first lookup of a key after expiry asks the sources."""
    events = lookups.select(F.col("lookup_id").alias("id"), "key", F.lit(1).alias("allowance"), "ts")
    decided = keyed.drained(keyed.admitted(events, ttl, lateness), base)
    kind = lookups.schema["lookup_id"].dataType
    return decided.select(F.col("id").cast(kind).alias("lookup_id"), "key", "start", F.col("admitted").alias("refreshed"))


def as_instant(column: str) -> Column:
    """Watermarks need an instant; the landing files hold zoneless times."""
    return F.col(column).cast("timestamp").alias(column)
