"""Small SQL text builders for the oracle side (DuckDB)."""

from __future__ import annotations

from mailquarry import lexicon as lx

SPACE = (r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def hits(text: str, terms) -> str:
    return "(" + " + ".join(f"(contains({text}, {q(t)}))::INT" for t in terms) + ")"


def any_of(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def isin(col: str, values) -> str:
    return f"{col} IN ({', '.join(q(v) for v in values)})"


def similarity(a: str, b: str) -> str:
    return f"1e0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE"


def d(value: float) -> str:
    return f"{value!r}::DOUBLE"


LEVEL = ("CASE WHEN {s} >= 0.9e0 THEN 'CRITICAL' WHEN {s} >= 0.7e0 THEN 'HIGH' "
         "WHEN {s} >= 0.5e0 THEN 'MEDIUM' ELSE 'LOW' END")

_PARTS = r"""
    SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS domain,
           lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')) AS pth,
           lower(regexp_extract(url, '^[^?#]*\?([^#]*)', 1)) AS qry
    FROM {source}"""

_best = "greatest(" + ", ".join(
    similarity("split_part(domain, '.', 1)", q(x.split(".")[0])) for x in lx.LEGITIMATE_DOMAINS) + ")"


def scored_static(source: str) -> dict[str, str]:
    """CTEs s_parts, s_pairs, s_static over a relation with a url column."""
    return {
        "s_parts": _PARTS.format(source=source),
        "s_best": f"SELECT *, {_best} AS best FROM s_parts",
        "s_query": r"""
            SELECT *, list_filter(string_split(qry, '&'), lambda p: regexp_matches(p, '^[^=]*=.+')) AS pairs FROM s_best""",
        "s_params": r"""
            SELECT *, list_transform(pairs, lambda p: url_decode(replace(split_part(p, '=', 1), '+', ' '))) AS pnames,
                   list_transform(pairs, lambda p: url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))) AS pvalues
            FROM s_query""",
        "s_scores": f"""
            SELECT * EXCLUDE (pairs, pnames, pvalues, pth, qry),
                   CASE WHEN length(url) > 300 THEN 0.9e0 WHEN length(url) > 200 THEN 0.6e0 WHEN length(url) > 100 THEN 0.3e0 ELSE 0e0 END AS length_score,
                   least(CASE WHEN regexp_matches(domain, '^\\d+\\.\\d+\\.\\d+\\.\\d+') THEN 0.8e0 ELSE 0e0 END
                       + CASE WHEN {any_of('lower(url)', lx.SUSPICIOUS_TLDS)} THEN 0.6e0 ELSE 0e0 END
                       + CASE WHEN {any_of('domain', lx.SHORTENERS)} THEN 0.4e0 ELSE 0e0 END
                       + CASE WHEN best > 0.7e0 AND best < 1e0 THEN 0.8e0 WHEN best > 0.5e0 AND best <= 0.7e0 THEN 0.4e0 ELSE 0e0 END
                       + CASE WHEN len(string_split(domain, '.')) > 4 THEN 0.3e0 ELSE 0e0 END, 1e0) AS domain_score,
                   least({hits('pth', lx.PATH_WORDS)} * 0.2e0
                       + CASE WHEN len(regexp_extract_all(pth, '%[0-9a-fA-F]{{2}}')) > 3 THEN 0.4e0 ELSE 0e0 END, 1e0) AS path_score,
                   least(({' + '.join(f"list_contains(pnames, {q(p)})::INT" for p in lx.REDIRECT_PARAMS)}) * 0.3e0
                       + len(list_filter(pvalues, lambda x: length(x) > 20 AND regexp_matches(x, '^[A-Za-z0-9+/]+=*$'))) * 0.4e0, 1e0) AS parameter_score
            FROM s_params""",
        "s_static": """
            SELECT *, length_score * 0.2e0 + domain_score * 0.4e0 + path_score * 0.3e0 + parameter_score * 0.1e0 AS static_score
            FROM s_scores""",
    }


SCAN_JSON = '{"positives":"BIGINT","total":"BIGINT","scans":"MAP(VARCHAR, STRUCT(detected BOOLEAN, result VARCHAR))"}'
HOST_JSON = ('{"detections":{"count":"BIGINT","engines":"MAP(VARCHAR, STRUCT(detected BOOLEAN, category VARCHAR))"}}')


def scan_verdicts(source: str, key: str) -> str:
    return f"""
        SELECT {key}, 'scan' AS vendor,
               CASE WHEN total > 0 THEN 1e0 - positives / total::DOUBLE ELSE 0.5e0 END AS reputation_score,
               positives > 0 AS is_malicious, positives, total, threat_types
        FROM (SELECT {key}, coalesce(r.positives, 0) AS positives, coalesce(r.total, 1) AS total,
                     list_sort(list_distinct(list_transform(list_filter(map_values(r.scans), lambda s: s.detected AND s.result <> ''),
                               lambda s: lower(s.result)))) AS threat_types
              FROM (SELECT {key}, from_json(report, '{SCAN_JSON}') AS r FROM {source}) a) b"""


def host_verdicts(source: str, key: str) -> str:
    return f"""
        SELECT {key}, 'host' AS vendor,
               CASE WHEN engines_count > 0 THEN 1e0 - detections / engines_count::DOUBLE ELSE 0.5e0 END AS reputation_score,
               detections > 0 AS is_malicious, detections, engines_count, threat_types
        FROM (SELECT {key}, coalesce(r.detections.count, 0) AS detections,
                     coalesce(len(map_values(r.detections.engines)), 0) AS engines_count,
                     list_sort(list_distinct(list_transform(list_filter(map_values(r.detections.engines), lambda e: e.detected),
                               lambda e: coalesce(e.category, 'malicious')))) AS threat_types
              FROM (SELECT {key}, from_json(report, '{HOST_JSON}') AS r FROM {source}) a) b"""


# URL chain: verdicts merged per URL and joined to the links of mails
URL_CTES = {
    **scored_static("v_urls"),
    "s_scan": scan_verdicts("v_url_reports_a", "url"),
    "s_host": host_verdicts("v_url_reports_b", "url"),
    "s_urls": """
        SELECT s.*, (a.url IS NOT NULL)::INT + (b.url IS NOT NULL)::INT AS vendors,
               1e0 - a.reputation_score AS scan_score, 1e0 - b.reputation_score AS host_score,
               coalesce(a.reputation_score, 0e0) + coalesce(b.reputation_score, 0e0) AS reputation_sum,
               list_sort(list_distinct(list_concat(CASE WHEN a.is_malicious THEN a.threat_types ELSE [] END,
                         CASE WHEN b.is_malicious THEN b.threat_types ELSE [] END))) AS threat_types
        FROM s_static s LEFT JOIN s_scan a ON a.url = s.url LEFT JOIN s_host b ON b.url = s.url""",
    "s_scored": """
        SELECT *, least(CASE WHEN vendors = 0 THEN static_score
                   ELSE static_score * 0.4e0 + (coalesce(scan_score, 0e0) + coalesce(host_score, 0e0)) / vendors * 0.6e0 END, 1e0) AS threat_score
        FROM s_urls""",
    "s_judged": """
        SELECT *, threat_score > 0.7e0 AS is_malicious,
               CASE WHEN threat_score > 0.7e0 THEN 'MALICIOUS' WHEN threat_score < 0.3e0 THEN 'CLEAN' ELSE 'SUSPICIOUS' END AS reputation_category
        FROM s_scored""",
    "s_patterns": f"""
        SELECT DISTINCT message_id, unnest(list_filter([
            CASE WHEN contains(lower(url), 'secure') AND contains(lower(url), 'update') THEN 'Fake security update URL' END,
            CASE WHEN {any_of('lower(url)', lx.URL_BRANDS)} AND NOT {isin('domain', lx.LEGITIMATE_DOMAINS)} THEN 'Brand impersonation URL' END,
            CASE WHEN domain_score > 0.7e0 THEN 'Suspicious domain structure' END,
            CASE WHEN len(threat_types) > 2 THEN 'Multiple threat indicators' END], lambda x: x IS NOT NULL)) AS pattern
        FROM s_judged""",
    "s_url_rollup": """
        SELECT message_id, count(*) AS url_count, least(avg(threat_score), 1e0) AS url_score,
               count_if(is_malicious) AS malicious_urls
        FROM s_judged GROUP BY message_id""",
}
