"""Oracle texts for the header jobs."""

from datasets.views import AS_OF
from mailquarry import lexicon as lx
from oracles.sql import any_of, isin


def _net(address: str) -> int:
    a, b, c, d = (int(x) for x in address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


_private = " OR ".join(f"n BETWEEN {_net(a)} AND {_net(a) + 2 ** (32 - b) - 1}" for a, b in lx.NON_PUBLIC_BLOCKS)
_RISK = isin("country", lx.HIGH_RISK_COUNTRIES)

HEADERS = {
    "h_hops": "SELECT message_id, unnest(hops) AS hop, unnest(range(len(hops))) AS hop_pos, len(hops) AS hop_n FROM v_headers",
    "h_found": r"""SELECT message_id, hop_pos, unnest(ips) AS ip, unnest(range(len(ips))) AS ip_pos
        FROM (SELECT *, regexp_extract_all(hop, '\[((?:\d{1,3}\.){3}\d{1,3})\]', 1) AS ips FROM h_hops) x""",
    "h_numbers": """SELECT *, CASE WHEN o1 <= 255 AND o2 <= 255 AND o3 <= 255 AND o4 <= 255
                                   THEN ((o1 * 256 + o2) * 256 + o3) * 256 + o4 END AS n
        FROM (SELECT *, split_part(ip, '.', 1)::BIGINT AS o1, split_part(ip, '.', 2)::BIGINT AS o2,
                     split_part(ip, '.', 3)::BIGINT AS o3, split_part(ip, '.', 4)::BIGINT AS o4 FROM h_found) x""",
    "h_public": f"SELECT message_id, hop_pos, row_number() OVER (PARTITION BY message_id, hop_pos ORDER BY ip_pos) - 1 AS pos, ip, n FROM h_numbers WHERE n IS NOT NULL AND NOT ({_private})",
    "h_geo": "SELECT p.*, coalesce(g.country, 'XX') AS country FROM h_public p LEFT JOIN v_geo_ranges g ON p.n BETWEEN g.start_ip AND g.end_ip",
    "h_ip": f"""SELECT message_id, count(*) AS public_ips, count_if({_RISK}) AS high_risk_ips, count(DISTINCT country) AS country_n,
               string_agg(DISTINCT country, '|' ORDER BY country) AS countries,
               coalesce(string_agg(DISTINCT CASE WHEN {_RISK} THEN ip || ' ' || country END, '|' ORDER BY CASE WHEN {_RISK} THEN ip || ' ' || country END), '') AS high_risk_evidence,
               min_by(country, hop_pos * 1000 + pos) AS sender_country, min_by(ip, hop_pos * 1000 + pos) AS sender_ip
        FROM h_geo GROUP BY message_id""",
    "h_hop_agg": f"""SELECT message_id, count(*) AS hop_count, count_if({any_of('lower(hop)', lx.DISPOSABLE_DOMAINS)}) AS disposable_hops,
               count_if(contains(lower(hop), 'unknown') OR contains(lower(hop), 'localhost')) AS unknown_hops FROM h_hops GROUP BY message_id""",
    "h_route": """SELECT v.message_id, coalesce(hop_count, 0) AS hop_count, coalesce(disposable_hops, 0) AS disposable_hops,
               coalesce(unknown_hops, 0) AS unknown_hops, coalesce(high_risk_ips, 0) AS high_risk_ips, coalesce(country_n, 0) AS country_n,
               coalesce(countries, '') AS countries, coalesce(high_risk_evidence, '') AS high_risk_evidence, sender_ip, sender_country
        FROM v_headers v LEFT JOIN h_hop_agg USING (message_id) LEFT JOIN h_ip USING (message_id)""",
    "h_routing": """SELECT *, least(high_risk_ips * 0.3e0 + disposable_hops * 0.4e0 + unknown_hops * 0.2e0
               + CASE WHEN hop_count > 10 THEN 0.3e0 WHEN hop_count < 2 THEN 0.4e0 ELSE 0e0 END
               + CASE WHEN country_n > 3 THEN 0.3e0 ELSE 0e0 END, 1e0) AS routing_score,
               high_risk_ips + disposable_hops + (country_n > 3)::INT AS suspicious_hops FROM h_route""",
    "h_auth0": """SELECT message_id, date_h IS NOT NULL AS present,
               CASE WHEN contains(lower(spf), 'pass') THEN 'pass' WHEN contains(lower(spf), 'softfail') THEN 'softfail'
                    WHEN contains(lower(spf), 'fail') THEN 'fail' WHEN contains(lower(spf), 'neutral') THEN 'neutral' ELSE 'none' END AS spf_result,
               CASE WHEN dkim IS NULL THEN 'none' WHEN contains(lower(auth), 'dkim=pass') THEN 'pass'
                    WHEN contains(lower(auth), 'dkim=fail') THEN 'fail' ELSE 'present' END AS dkim_result,
               CASE WHEN contains(lower(auth), 'dmarc=pass') THEN 'pass' WHEN contains(lower(auth), 'dmarc=fail') THEN 'fail'
                    WHEN contains(lower(auth), 'dmarc=quarantine') THEN 'quarantine' WHEN contains(lower(auth), 'dmarc=reject') THEN 'reject' ELSE 'none' END AS dmarc_result
        FROM v_headers""",
    "h_auth": """SELECT *, spf_score * 0.3e0 + dkim_score * 0.3e0 + dmarc_score * 0.4e0 AS authentication_score FROM (
        SELECT *, CASE spf_result WHEN 'pass' THEN 0e0 WHEN 'fail' THEN 1e0 WHEN 'softfail' THEN 0.7e0 WHEN 'neutral' THEN 0.3e0 ELSE 0.5e0 END AS spf_score,
               CASE dkim_result WHEN 'pass' THEN 0e0 WHEN 'fail' THEN 0.8e0 WHEN 'present' THEN 0.2e0 ELSE 0.5e0 END AS dkim_score,
               CASE dmarc_result WHEN 'pass' THEN 0e0 WHEN 'fail' THEN 0.9e0 WHEN 'quarantine' THEN 0.6e0 WHEN 'reject' THEN 1e0 ELSE 0.5e0 END AS dmarc_score
        FROM h_auth0) x""",
    "h_written": """SELECT message_id, 0 AS ord, date_h AS s FROM v_headers WHERE date_h IS NOT NULL
        UNION ALL SELECT message_id, hop_n - hop_pos AS ord, regexp_extract(hop, ';\\s*(.+)$', 1) AS s FROM h_hops""",
    "h_stamps": """SELECT message_id, ord, zone, epoch(t) - zone * 60 AS e FROM (
        SELECT *, strptime(regexp_extract(s, '(\\d{2} [A-Za-z]{3} \\d{4} \\d{2}:\\d{2}:\\d{2})', 1), '%d %b %Y %H:%M:%S') AS t,
               CASE WHEN contains(s, '+0200') THEN 120 ELSE 0 END AS zone FROM h_written) x""",
    "h_gaps": """SELECT *, e - lag(e) OVER w AS gap, zone <> lag(zone) OVER w AS moved FROM h_stamps WINDOW w AS (PARTITION BY message_id ORDER BY ord)""",
    "h_time0": f"""SELECT message_id, count(*) AS stamps, count_if(gap < 0) AS backward_steps, count_if(gap > 86400) AS long_gaps,
               count_if(moved) AS zone_changes, min(e) > epoch(TIMESTAMP '{AS_OF}') + 3600 AS future FROM h_gaps GROUP BY message_id""",
    "h_time": """SELECT v.message_id, coalesce(stamps, 0) AS stamps, coalesce(backward_steps, 0) AS backward_steps, coalesce(long_gaps, 0) AS long_gaps,
               coalesce(zone_changes, 0) AS zone_changes, coalesce(stamps >= 2 AND backward_steps > 0, false) AS timestamp_anomalies,
               coalesce(stamps >= 2 AND zone_changes > 0, false) AS timezone_inconsistencies,
               CASE WHEN stamps >= 2 THEN least(backward_steps * 0.6e0 + long_gaps * 0.3e0 + zone_changes * 0.2e0 + CASE WHEN future THEN 0.4e0 ELSE 0e0 END, 1e0) ELSE 0e0 END AS timestamp_score
        FROM v_headers v LEFT JOIN h_time0 USING (message_id)""",
    "h_sender": f"""SELECT v.message_id, sender_ip, sender_country,
               coalesce(lower(trim(return_path, '<>')) <> lower(regexp_extract(from_h, '[A-Za-z0-9_.\\-]+@[A-Za-z0-9_.\\-]+')), false) AS return_path_mismatch,
               coalesce({any_of('lower(from_h)', lx.DISPOSABLE_DOMAINS)}, false) AS disposable_from,
               coalesce({isin('sender_country', lx.HIGH_RISK_COUNTRIES)}, false) AS risky
        FROM v_headers v LEFT JOIN h_ip USING (message_id)""",
    "h_sent": """SELECT *, least(CASE WHEN risky THEN 0.4e0 ELSE 0e0 END + CASE WHEN return_path_mismatch THEN 0.3e0 ELSE 0e0 END
               + CASE WHEN disposable_from THEN 0.5e0 ELSE 0e0 END, 1e0) AS sender_score FROM h_sender""",
    "h_all": f"""SELECT message_id,
               CASE WHEN present THEN least(authentication_score * 0.4e0 + routing_score * 0.3e0 + timestamp_score * 0.2e0 + sender_score * 0.1e0, 1e0) ELSE 0.5e0 END AS header_score,
               CASE WHEN present THEN authentication_score ELSE 0.5e0 END AS authentication_score,
               CASE WHEN present THEN routing_score ELSE 0.5e0 END AS routing_score, timestamp_score, sender_score,
               spf_result, dkim_result, dmarc_result, s.sender_ip, s.sender_country, hop_count,
               present AND suspicious_hops > 0 AS suspicious_routing, timestamp_anomalies, return_path_mismatch,
               array_to_string(list_filter([
                   CASE WHEN NOT present THEN 'No headers available for analysis' END,
                   CASE WHEN present AND spf_result = 'fail' THEN 'SPF authentication failed' END,
                   CASE WHEN present AND dkim_result = 'fail' THEN 'DKIM signature verification failed' END,
                   CASE WHEN present AND dmarc_result = 'fail' THEN 'DMARC policy violation' END,
                   CASE WHEN present AND suspicious_hops > 0 THEN 'Suspicious routing detected (' || suspicious_hops || ' anomalies)' END,
                   CASE WHEN present AND timestamp_anomalies THEN 'Timestamp anomalies detected' END,
                   CASE WHEN present AND return_path_mismatch THEN 'Return-Path and From header mismatch' END,
                   CASE WHEN present AND risky THEN 'Email originated from high-risk country: ' || s.sender_country END],
                   lambda x: x IS NOT NULL), '|') AS warnings
        FROM h_auth JOIN h_routing r USING (message_id) JOIN h_time USING (message_id) JOIN h_sent s USING (message_id)""",
}
RISK = _RISK
