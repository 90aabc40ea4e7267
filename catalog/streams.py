"""Streaming jobs over landing files made from the given tables, compared with batch SQL."""

from pyspark.sql import functions as F

from catalog import attachments as at
from catalog import urls as ur
from catalog.access import CACHE_SQL, RATE_SQL, lookups, requests
from catalog.facts import facts
from catalog.headers import as_of
from catalog.registry import plain, register
from datasets.mails import attachments as files_of
from datasets.mails import full_mails, geo_ranges
from datasets.views import view
from mailquarry.plans import mailbox
from mailquarry.streaming import jobs
from oracles.ensemble import MAILBOX

IS_HIGH = "threat_level IN ('HIGH', 'CRITICAL')"


def arriving(rows, name, parts, run):
    """Lands the rows of each condition, written by the table's own tasks, and lets the query take them: ``run(stream, base)`` goes on
    from its checkpoint after each arrival, which is one batch. Returns what the last run gives."""
    spark, path, base, found = rows.sparkSession, jobs.new_base(rows.sparkSession, f"{name}-in"), jobs.new_base(rows.sparkSession, name), None
    for part in parts:
        rows.filter(part).write.mode("append").parquet(path)
        found = run(jobs.read_landing(spark, path, rows.schema), base)
    return found


def halves(df, column):
    """Two conditions that cut the rows at the middle of an ordered key; rows without it come first."""
    middle = df.agg((F.max(column) / 2).alias("m")).first()[0]
    first = F.coalesce(F.col(column) <= middle, F.lit(True))
    return [first, ~first]


def arriving_facts(spark, sf, name, run):
    rows = facts(spark, sf).withColumn("event_id", F.substring("email_id", 2, 20).cast("bigint")).withColumn(
        "created_at", jobs.as_instant("created_at")).withColumn(
        "priority", F.when(F.col("event_id") % 2 == 0, "high").otherwise("normal"))
    return arriving(rows, name, halves(rows, "event_id"), run)


_FMT = "'%Y-%m-%d %H:%M:%S'"


@register("stream_tumbling_levels", f"""
    SELECT strftime(date_trunc('hour', created_at), {_FMT}) AS start, count_if(threat_level = 'CRITICAL') AS critical, count_if(threat_level = 'HIGH') AS high,
           count_if(threat_level = 'MEDIUM') AS medium, count_if(threat_level = 'LOW') AS low, count(*) AS total FROM v_analyses GROUP BY 1""")
def stream_tumbling_levels(spark, sf):
    return plain(arriving_facts(spark, sf, "tumbling", lambda rows, base: jobs.drain_latest(jobs.tumbling_levels(rows), base, ["start"])))


@register("stream_sliding_24h", f"""
    SELECT strftime(start, {_FMT}) AS start, count(*) AS total, count_if({IS_HIGH}) AS high, count_if(is_quarantined) AS quarantined
    FROM (SELECT *, unnest(range(24)) AS k FROM v_analyses) x, LATERAL (SELECT date_trunc('hour', created_at) - k * INTERVAL 1 HOUR AS start) s GROUP BY 1""")
def stream_sliding_24h(spark, sf):
    return plain(arriving_facts(spark, sf, "sliding", lambda rows, base: jobs.drain_latest(jobs.sliding_stats(rows), base, ["start"])))


@register("stream_health_1h", f"""
    SELECT strftime(start, {_FMT}) AS start, count(*) AS n, round(avg(duration_ms), 8) AS mean_ms, round(count_if(status = 'error') / count(*)::DOUBLE * 100, 8) AS error_rate,
           CASE WHEN avg(duration_ms) > 10000 OR count_if(status = 'error') / count(*)::DOUBLE * 100 > 15 THEN 'critical'
                WHEN avg(duration_ms) > 5000 OR count_if(status = 'error') / count(*)::DOUBLE * 100 > 5 THEN 'warning' ELSE 'healthy' END AS status
    FROM (SELECT duration_ms, status, to_timestamp_ntz_(created_at) - k * INTERVAL 15 MINUTE AS start FROM (SELECT *, unnest(range(4)) AS k FROM v_analyses) y) x GROUP BY 1""".replace(
    "to_timestamp_ntz_(created_at)", "time_bucket(INTERVAL 15 MINUTE, created_at)"))
def stream_health_1h(spark, sf):
    return plain(arriving_facts(spark, sf, "health", lambda rows, base: jobs.drain_latest(jobs.rolling_health(rows), base, ["start"])))


@register("stream_sessions", f"""
    SELECT sender_email, strftime(s, {_FMT}) AS start, strftime(e, {_FMT}) AS "end", mails, e > (SELECT max(created_at) FROM v_analyses) - INTERVAL 1 HOUR AS is_open FROM (
        SELECT sender_email, min(created_at) AS s, max(created_at) + INTERVAL 30 MINUTE AS e, count(*) AS mails FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY sender_email ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS session FROM (
                SELECT *, (coalesce(created_at - lag(created_at) OVER (PARTITION BY sender_email ORDER BY created_at) >= INTERVAL 30 MINUTE, true))::INT AS fresh FROM v_analyses) a) b
        GROUP BY sender_email, session) c""")
def stream_sessions(spark, sf):
    return plain(arriving_facts(spark, sf, "sessions", jobs.drain_sessions))


@register("stream_alerts", f"""
    SELECT email_id, threat_level, round(threat_score, 8) AS threat_score, strftime(created_at, {_FMT}) AS alert_sent_at
    FROM v_analyses WHERE {IS_HIGH} AND substr(email_id, 2)::BIGINT % 2 = 0""")
def stream_alerts(spark, sf):
    return plain(arriving_facts(spark, sf, "alerts", lambda rows, base: jobs.drain(jobs.alert_rows(rows), base)))


@register("stream_audit", f"""
    SELECT event_id, event_type, user_id, action, success, strftime(created_at, {_FMT}) AS created_at FROM v_audit""")
def stream_audit(spark, sf):
    rows = view(spark, sf, "v_audit").withColumn("created_at", jobs.as_instant("created_at"))
    columns = ["event_id", "event_type", "user_id", "action", "success", "created_at"]
    return plain(arriving(rows, "audit", halves(rows, "event_id"), lambda stream, base: jobs.drain(stream.select(columns), base)))


@register("stream_dedup", "SELECT DISTINCT email_id AS message_id FROM v_releases")
def stream_dedup(spark, sf):
    rows = view(spark, sf, "v_releases").select(
        F.col("email_id").alias("message_id"), F.col("released_at").cast("timestamp").alias("received_at"))
    # the two notices of a message are an hour apart, well within the lateness
    return arriving(rows, "dedup", [F.lit(True)], lambda stream, base: jobs.drain(jobs.dedup(stream), base)).select("message_id")


@register("stream_late_data", """
    SELECT CASE WHEN second AND created_at < mark - INTERVAL 1 HOUR THEN 'late' ELSE 'kept' END AS kind, count(*) AS rows
    FROM (SELECT created_at, substr(email_id, 2)::BIGINT % 5 = 0 AS second, max(CASE WHEN substr(email_id, 2)::BIGINT % 5 <> 0 THEN created_at END) OVER () AS mark
          FROM v_analyses) x GROUP BY 1""")
def stream_late_data(spark, sf):
    rows = facts(spark, sf).select(
        "email_id", jobs.as_instant("created_at"), F.substring("email_id", 2, 20).cast("bigint").alias("n"))
    fifth = F.coalesce(F.col("n") % 5 == 0, F.lit(False))  # every fifth mail arrives after all others
    kept, late = arriving(rows, "split", [~fifth, fifth], jobs.split_late)
    counts = [spark.read.schema(rows.schema).parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("kind"), "rows")
              for k, p in (("kept", kept), ("late", late))]
    return counts[0].unionByName(counts[1])


@register("rate_limit_stream", RATE_SQL)
def rate_limit_stream(spark, sf):
    rows = requests(spark, sf)
    decided = arriving(rows, "rate", halves(rows, "request_id"), jobs.rate_limit_stream)
    return plain(decided.select("request_id", "key", "start", "allowed"))


@register("ioc_ttl_stream", CACHE_SQL)
def ioc_ttl_stream(spark, sf):
    rows = lookups(spark, sf)
    return plain(arriving(rows, "ttl", halves(rows, "lookup_id"), jobs.lookup_cache_stream))


@register("stream_score", """
    SELECT message_id AS email_id, sender AS sender_email, subject, threat_level, round(threat_score, 8) AS threat_score, is_phishing,
           threat_level IN ('HIGH', 'CRITICAL') AS is_quarantined FROM b_judged""", MAILBOX)
def stream_score(spark, sf):
    mails = full_mails(spark, sf).withColumn("received_at", jobs.as_instant("received_at"))
    files, links, hashes = files_of(spark, sf), ur.url_verdicts(spark, sf), at.file_verdicts(spark, sf)
    geo, predictions = geo_ranges(spark, sf), view(spark, sf, "v_predictions")

    def score(batch):
        ids = batch.select("message_id")
        judged = mailbox.score_mailbox(batch, files.join(ids, "message_id", "left_semi"), links, hashes, geo,
                                       predictions.join(ids, "message_id", "left_semi"), as_of())
        return judged.select(
            F.col("message_id").alias("email_id"), F.col("sender").alias("sender_email"), F.col("recipients")[0].alias("recipient_email"),
            "subject", "threat_level", "threat_score", "is_phishing", (F.abs(F.col("threat_score") - 0.5) * 2).alias("confidence"),
            F.to_json(F.struct("threat_category", "threats")).alias("analysis_details"), "received_at", F.lit(1).alias("seq"))

    table = arriving(mails, "score", halves(mails, "doc_id"), lambda stream, base: jobs.score_stream(stream, score, base))
    return plain(spark.read.parquet(table).select(
        "email_id", "sender_email", "subject", "threat_level", "threat_score", "is_phishing", "is_quarantined"))
