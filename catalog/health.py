"""Health jobs."""

from catalog.facts import facts, recent
from catalog.registry import plain, register
from datasets.views import AS_OF, HOUR_AS_OF, view
from mailquarry.plans import health

_HOUR = recent("created_at", "'1 hour'", HOUR_AS_OF)
_PERF = f"""
    SELECT CASE WHEN m > 10000 OR r > 15 THEN 'critical' WHEN m > 5000 OR r > 5 THEN 'warning' ELSE 'healthy' END AS status,
           round(m, 2) AS avg_processing_time_ms, n AS emails_processed_hour, round(r, 2) AS error_rate_percent
    FROM (SELECT coalesce(avg(duration_ms), 0e0) AS m, count(*) AS n,
                 coalesce(count_if(status = 'error') * 100e0 / nullif(count(*), 0), 0e0) AS r FROM v_analyses WHERE {_HOUR}) x"""
_MODELS = f"""
    SELECT CASE WHEN n = 0 OR days > 30 THEN 'critical' WHEN days > 7 THEN 'warning' ELSE 'healthy' END AS status,
           n AS active_models, round(a, 3) AS average_accuracy, days AS oldest_model_days
    FROM (SELECT count(*) AS n, avg(accuracy) AS a, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(min(training_date))) / 86400)::BIGINT AS days
          FROM v_models WHERE is_active) x"""


@register("health_recent_activity", f"SELECT count(*) AS recent_analyses FROM v_analyses WHERE {_HOUR}")
def health_recent_activity(spark, sf):
    return plain(health.recent(facts(spark, sf), HOUR_AS_OF))


@register("health_performance", _PERF)
def health_performance(spark, sf):
    return plain(health.performance(facts(spark, sf), HOUR_AS_OF))


@register("health_models", _MODELS)
def health_models(spark, sf):
    return plain(health.models(view(spark, sf, "v_models"), AS_OF))


@register("health_overall", f"""
    SELECT CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'healthy' END AS overall_status,
           count(*) AS components, count_if(status <> 'healthy') AS unhealthy_components
    FROM (SELECT status FROM ({_PERF}) p UNION ALL SELECT status FROM ({_MODELS}) m) s""")
def health_overall(spark, sf):
    return plain(health.overall({
        "performance": health.performance(facts(spark, sf), HOUR_AS_OF),
        "models": health.models(view(spark, sf, "v_models"), AS_OF)}))
