"""Request and audit jobs."""

from pyspark.sql import functions as F

from catalog.registry import plain, register
from datasets.views import view
from mailquarry import lexicon as lx
from mailquarry.operators import access
from oracles.sql import any_of

IP = """CASE WHEN forwarded_for <> '' THEN trim(split_part(forwarded_for, ',', 1)) ELSE coalesce(real_ip, peer_ip, 'unknown') END"""
CLASS = "CASE WHEN starts_with(path, '/api/analyze-email') THEN 'analyze' WHEN starts_with(path, '/api/') THEN 'api' ELSE 'web' END"


def anchored(source: str, seconds: int) -> dict[str, str]:
    """Recursive walk over the numbered events of each key (DuckDB)."""
    return {
        "q_numbered": f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS rn, floor(epoch(ts))::BIGINT AS s FROM ({source}) z",
        "q_walk": f"""SELECT key, id, rn, s, s AS start FROM q_numbered WHERE rn = 1
            UNION ALL SELECT n.key, n.id, n.rn, n.s, CASE WHEN n.s < w.start + {seconds} THEN w.start ELSE n.s END AS start
            FROM q_walk w JOIN q_numbered n ON n.key = w.key AND n.rn = w.rn + 1""",
    }


def recursive(body: str, ctes: dict[str, str]) -> str:
    """DuckDB text with the walk as a recursive CTE."""
    from datasets.views import with_views

    text = with_views("duckdb", body, ctes)
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


RATE_SOURCE = f"SELECT request_id AS id, {CLASS} AS class, {CLASS} || ':' || {IP} AS key, ts FROM v_requests"
RATE_SQL = recursive("""
    SELECT id AS request_id, key, start, row_number() OVER (PARTITION BY key, start ORDER BY rn) <= CASE split_part(key, ':', 1) WHEN 'analyze' THEN 10 WHEN 'api' THEN 100 ELSE 200 END AS allowed
    FROM q_walk""", anchored(RATE_SOURCE, lx.RATE_WINDOW_SECONDS))
CACHE_SQL = recursive("""
    SELECT id AS lookup_id, key, start, row_number() OVER (PARTITION BY key, start ORDER BY rn) = 1 AS refreshed FROM q_walk""",
    anchored("SELECT event_id AS id, 'user' || user_id AS key, ts FROM events", lx.IOC_TTL_SECONDS))


def requests(spark, sf):
    return view(spark, sf, "v_requests")


def lookups(spark, sf):
    return view(spark, sf, "events").select(
        F.col("event_id").alias("lookup_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("key"), "ts")


@register("derive_client_ip", f"SELECT request_id, {IP} AS ip FROM v_requests")
def derive_client_ip(spark, sf):
    return plain(access.with_client_ip(requests(spark, sf)).select("request_id", "ip"))


@register("filter_suspicious_agents", f"SELECT request_id, user_agent FROM v_requests WHERE {any_of('lower(user_agent)', lx.SUSPICIOUS_AGENTS)}")
def filter_suspicious_agents(spark, sf):
    return plain(access.suspicious_agents(requests(spark, sf)).select("request_id", "user_agent"))


@register("filter_ip_whitelist", f"""
    SELECT request_id, path, {IP} AS ip FROM v_requests WHERE starts_with(path, '/admin/') AND {IP} NOT IN (SELECT '10.0.0.' || n_nationkey FROM nation WHERE n_nationkey > 0)""")
def filter_ip_whitelist(spark, sf):
    allowed = view(spark, sf, "nation").filter("n_nationkey > 0").select(
        F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")).alias("ip"))
    return plain(access.whitelist_violations(requests(spark, sf), allowed).select("request_id", "path", "ip"))


@register("filter_audit_trail", """
    SELECT event_id, event_type, user_id, resource_id, action, ip_address, success, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM v_audit WHERE event_type = 'email_analyzed' AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-25 00:00:00'
    ORDER BY v_audit.created_at DESC, event_id DESC LIMIT 100""")
def filter_audit_trail(spark, sf):
    found = access.audit_trail(view(spark, sf, "v_audit"), event_type="email_analyzed",
                               start="2024-01-05 00:00:00", end="2024-01-25 00:00:00")
    return plain(found.select("event_id", "event_type", "user_id", "resource_id", "action", "ip_address", "success", "created_at"))


@register("rate_limit_batch", RATE_SQL)
def rate_limit_batch(spark, sf):
    decisions = access.rate_limit(requests(spark, sf))
    return plain(decisions.select("request_id", "key", "start", "allowed"))


@register("ioc_ttl_batch", CACHE_SQL)
def ioc_ttl_batch(spark, sf):
    return plain(access.lookup_cache(lookups(spark, sf)))
