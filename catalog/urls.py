"""Link jobs."""

from pyspark.sql import functions as F

from catalog.registry import plain, register
from datasets.views import AS_OF, view
from mailquarry.operators import reputation, urls
from mailquarry.plans.skew import hot_keys
from oracles import sql
from oracles.sql import URL_CTES


def url_verdicts(spark, sf):
    return reputation.verdict_table(
        reputation.scan_verdicts(view(spark, sf, "v_url_reports_a"), "url"),
        reputation.host_verdicts(view(spark, sf, "v_url_reports_b"), "url"), "url")


def scored_links(spark, sf):
    links = view(spark, sf, "v_urls")
    return urls.score_links(links, url_verdicts(spark, sf), hot_keys(links, ["url"]))


@register("extract_urls", r"""
    SELECT message_id, url, row_number() OVER (PARTITION BY message_id ORDER BY min(i)) - 1 AS pos FROM (
        SELECT message_id, regexp_replace(found[i], '[.,;!?]+$', '') AS url, i FROM (
            SELECT message_id, found, unnest(range(1, len(found) + 1)) AS i FROM (
                SELECT message_id, regexp_extract_all(content, 'https?://[^\s<>"{}|\\^`\[\]]+') AS found FROM v_emails) a) b) c
    GROUP BY message_id, url""")
def extract_urls(spark, sf):
    return plain(urls.extract_links(view(spark, sf, "v_emails")))


@register("join_typosquat", f"""
    SELECT domain, round(max(sim), 8) AS best_similarity, min_by(brand, (-sim, brand)) AS closest_brand,
           CASE WHEN max(sim) > 0.7e0 AND max(sim) < 1e0 THEN 0.8e0 WHEN max(sim) > 0.5e0 AND max(sim) <= 0.7e0 THEN 0.4e0 ELSE 0e0 END AS typosquat_score
    FROM (SELECT domain, brand, {sql.similarity("split_part(domain, '.', 1)", "split_part(brand, '.', 1)")} AS sim
          FROM (SELECT DISTINCT domain, unnest({sql.items(urls.lx.LEGITIMATE_DOMAINS)}) AS brand FROM s_parts) a) b
    GROUP BY domain""", URL_CTES)
def join_typosquat(spark, sf):
    return plain(urls.typosquat_candidates(view(spark, sf, "v_urls")))


_STATIC = ["message_id", "page_id", "url", "domain", "length_score", "domain_score", "path_score",
           "parameter_score", "static_score"]


@register("score_urls_static", f"""
    SELECT {', '.join(f'round({c}, 8) AS {c}' if c.endswith('_score') else c for c in _STATIC)} FROM s_static""", URL_CTES)
def score_urls_static(spark, sf):
    return plain(urls.score_static(view(spark, sf, "v_urls")).select(_STATIC))


@register("join_reputation", """
    SELECT message_id, page_id, url, vendors::BIGINT AS vendors, round(scan_score, 8) AS scan_score, round(host_score, 8) AS host_score,
           array_to_string(threat_types, '|') AS threat_types FROM s_urls""", URL_CTES)
def join_reputation(spark, sf):
    links = view(spark, sf, "v_urls")
    joined = urls.join_reputation(links, url_verdicts(spark, sf), hot_keys(links, ["url"]))
    return plain(joined.select("message_id", "page_id", "url", "vendors", "scan_score", "host_score", "threat_types"))


@register("score_urls", """
    SELECT message_id, page_id, url, round(threat_score, 8) AS threat_score, is_malicious, reputation_category,
           array_to_string(threat_types, '|') AS threat_types FROM s_judged""", URL_CTES)
def score_urls(spark, sf):
    return plain(scored_links(spark, sf).select(
        "message_id", "page_id", "url", "threat_score", "is_malicious", "reputation_category", "threat_types"))


@register("url_patterns", "SELECT message_id, pattern FROM s_patterns", URL_CTES)
def url_patterns(spark, sf):
    return urls.link_patterns(scored_links(spark, sf))


@register("rollup_urls", """
    SELECT r.message_id, url_count, round(url_score, 8) AS url_score, malicious_urls, coalesce(p.patterns, '') AS patterns
    FROM s_url_rollup r LEFT JOIN (SELECT message_id, string_agg(pattern, '|' ORDER BY pattern) AS patterns
                                   FROM s_patterns GROUP BY message_id) p USING (message_id)""", URL_CTES)
def rollup_urls(spark, sf):
    return plain(urls.rollup_links(scored_links(spark, sf)).drop("most_threat_types"))


@register("rollup_urls_malicious", "SELECT DISTINCT message_id, url FROM s_judged WHERE is_malicious", URL_CTES)
def rollup_urls_malicious(spark, sf):
    return urls.malicious_links(scored_links(spark, sf))


@register("summary_url_reputation", """
    SELECT count(*) AS total_checked, count_if(is_malicious) AS malicious_count,
           count_if(NOT is_malicious AND threat_score < 0.3e0) AS clean_count,
           count_if(NOT is_malicious AND threat_score >= 0.3e0) AS unknown_count,
           round(coalesce(sum(reputation_sum) / nullif(sum(vendors), 0)::DOUBLE, 0e0), 8) AS avg_reputation_score
    FROM s_judged""", URL_CTES)
def summary_url_reputation(spark, sf):
    return plain(urls.reputation_summary(scored_links(spark, sf)))


def link_facts(spark, sf):
    """URL facts; the analysis time is spread over the days before the report date."""
    links = view(spark, sf, "v_urls")
    scored = urls.score_links(links, url_verdicts(spark, sf), hot_keys(links, ["url"]))
    at = F.expr(f"cast('{AS_OF}' as timestamp_ntz) - cast(page_id % 50 as int) * interval '1' day")
    return urls.link_facts(scored, at)


@register("sink_url_rows", f"""
    SELECT message_id AS email_analysis_id, url, domain, round(scan_score, 8) AS virustotal_score,
           round(host_score, 8) AS urlvoid_score, is_malicious, array_to_string(threat_types, '|') AS threat_types,
           reputation_category, strftime(TIMESTAMP '{AS_OF}' - (page_id % 50) * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS analyzed_at
    FROM s_judged""", URL_CTES)
def sink_url_rows(spark, sf):
    from mailquarry.sinks.facts import append_and_read

    return plain(append_and_read(link_facts(spark, sf), "url_analyses", "analyzed_at"))
