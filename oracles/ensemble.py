"""Oracle texts for features, verdicts and the whole plan."""

from mailquarry import lexicon as lx
from oracles import content as oc
from oracles.attachments import FILES
from oracles.headers import HEADERS
from oracles.sql import LEVEL, URL_CTES, any_of, isin, q, similarity

_sim = "greatest(" + ", ".join(
    f"CASE WHEN domain = {q(x)} THEN 0e0 ELSE {similarity('domain', q(x))} END" for x in lx.FEATURE_DOMAINS) + ")"

FEATURES = {
    **URL_CTES, **HEADERS, **FILES, **oc.FEATURES,
    "u_features": f"""SELECT message_id, count(*) AS url_count, avg(length(url)) AS avg_url_length, max(length(url)) AS max_url_length,
               count_if({_sim} > 0.8e0 OR regexp_matches(domain, '\\d') OR len(string_split(domain, '.')) > 3
                        OR length(domain) - length(replace(domain, '-', '')) > 2) AS suspicious_domains,
               count_if({any_of('domain', lx.FEATURE_SHORTENERS)}) AS url_shorteners,
               count_if(regexp_matches(domain, '^\\d+\\.\\d+\\.\\d+\\.\\d+')) AS ip_addresses,
               count_if({any_of('lower(url)', lx.FEATURE_TLDS)}) AS suspicious_tlds, 0 AS url_redirects
        FROM s_parts GROUP BY message_id""",
    "hf_features": f"""SELECT message_id, (spf_result = 'pass')::INT AS spf_pass, (dkim_result = 'pass')::INT AS dkim_pass,
               (dmarc_result = 'pass')::INT AS dmarc_pass, 0.5e0 AS sender_reputation, hop_count, suspicious_routing::INT AS suspicious_routing,
               timestamp_anomalies::INT AS timestamp_anomalies, coalesce({isin('sender_country', lx.FEATURE_HIGH_RISK_COUNTRIES)}, false)::INT AS high_risk_country
        FROM h_all""",
}
MODELS = {
    "p_grouped": "SELECT message_id, " + ", ".join(
        f"max(probability) FILTER (WHERE error IS NULL AND model_name = {q(m)}) AS {m}" for m in [*lx.MODEL_PRIORITY, "ensemble"])
        + ", bool_or(model_name = 'ensemble') AS has_ensemble, avg(probability) FILTER (WHERE error IS NULL) AS plain FROM v_predictions GROUP BY message_id",
    "p_list": f"SELECT *, list_filter([{', '.join(lx.MODEL_PRIORITY)}], lambda x: x IS NOT NULL) AS av FROM p_grouped",
    "p_soft": """SELECT message_id, coalesce(ensemble, CASE len(av) WHEN 1 THEN av[1] * 0.3e0 / 0.3e0
               WHEN 2 THEN (av[1] * 0.3e0 + av[2] * 0.3e0) / (0.3e0 + 0.3e0)
               WHEN 3 THEN (av[1] * 0.3e0 + av[2] * 0.3e0 + av[3] * 0.4e0) / (0.3e0 + 0.3e0 + 0.4e0) END, 0.5e0) AS probability,
               ensemble IS NOT NULL AS decided, ensemble IS NULL AND len(av) = 0 AS nothing,
               CASE WHEN has_ensemble THEN coalesce(ensemble, 0.5e0) ELSE coalesce(plain, 0.5e0) END AS model_mean FROM p_list""",
    "p_final": """SELECT *, CASE WHEN decided THEN probability > 0.5e0 WHEN nothing THEN false ELSE probability > 0.7e0 END AS prediction,
               CASE WHEN nothing THEN 0e0 ELSE abs(probability - 0.5e0) * 2e0 END AS confidence,
               CASE WHEN decided THEN 'ensemble_model' WHEN nothing THEN 'none' ELSE 'weighted_average' END AS method FROM p_soft""",
}
MAILBOX = {
    **FEATURES, **MODELS,
    "b_parts": """SELECT e.message_id, e.sender, e.recipients, e.subject, e.received_at, e.lang, c.urgent_words_count, c.suspicious_words_count,
               c.financial_words_count, header_score, sender_country, return_path_mismatch,
               coalesce(u.url_count, 0) AS url_count, coalesce(u.url_score, 0e0) AS url_score, coalesce(u.malicious_urls, 0) AS malicious_urls,
               coalesce(uf.suspicious_domains, 0) AS suspicious_domains, coalesce(a.attachment_count, 0) AS attachment_count,
               coalesce(a.attachment_score, 0e0) AS attachment_score, coalesce(a.malicious_files, 0) AS malicious_files,
               coalesce(af.suspicious_extensions, 0) AS suspicious_extensions,
               coalesce(p.probability, 0.5e0) AS content_score, coalesce(p.model_mean, 0.5e0) AS model_mean, p.message_id IS NOT NULL AS has_classifier
        FROM v_emails e JOIN c_features c USING (message_id) JOIN h_all USING (message_id) LEFT JOIN s_url_rollup u USING (message_id)
        LEFT JOIN u_features uf USING (message_id) LEFT JOIN a_rollup a USING (message_id) LEFT JOIN a_features af USING (message_id)
        LEFT JOIN p_final p USING (message_id)""",
    "b_scored": """SELECT *, least((content_score * 0.25e0 + url_score * 0.30e0 + attachment_score * 0.25e0 + header_score * 0.20e0) * 0.6e0
               + model_mean * 0.4e0, 1e0) AS threat_score FROM b_parts""",
    "b_judged": f"""SELECT *, threat_score > 0.7e0 AS is_phishing, {LEVEL.format(s='threat_score')} AS threat_level,
               CASE WHEN has_classifier THEN CASE WHEN content_score < 0.5e0 THEN 'LEGITIMATE' WHEN financial_words_count > 2 THEN 'FINANCIAL_SCAM'
                    WHEN urgent_words_count > 3 THEN 'PHISHING' WHEN suspicious_extensions > 0 THEN 'MALWARE' WHEN suspicious_domains > 0 THEN 'PHISHING' ELSE 'SPAM' END
                    ELSE CASE WHEN malicious_files > 0 THEN 'MALWARE' WHEN malicious_urls > 0 THEN 'PHISHING' WHEN url_score > 0.7e0 THEN 'PHISHING'
                         WHEN content_score > 0.5e0 THEN 'PHISHING' ELSE 'LEGITIMATE' END END AS threat_category,
               lower(split_part(sender, '@', 2)) IN ({', '.join(q(d) for d in lx.WHITELIST_DOMAINS)}) AS whitelisted
        FROM b_scored""",
    "b_threats": """SELECT *, list_filter([CASE WHEN is_phishing THEN 'phishing_attempt' END, CASE WHEN malicious_urls > 0 THEN 'malicious_url' END,
               CASE WHEN malicious_files > 0 THEN 'malicious_attachment' END, CASE WHEN return_path_mismatch THEN 'spoofed_sender' END,
               CASE WHEN urgent_words_count > 0 OR financial_words_count > 2 THEN 'social_engineering' END], lambda x: x IS NOT NULL) AS threats,
               list_filter([
                 CASE WHEN is_phishing THEN 'QUARANTINE: Move email to quarantine folder immediately' END,
                 CASE WHEN is_phishing THEN 'ALERT: Notify recipient about potential phishing attempt' END,
                 CASE WHEN malicious_urls > 0 THEN 'BLOCK: Block access to malicious URLs' END,
                 CASE WHEN malicious_urls > 0 THEN 'SCAN: Perform additional URL reputation checks' END,
                 CASE WHEN malicious_files > 0 THEN 'ISOLATE: Quarantine malicious attachments' END,
                 CASE WHEN malicious_files > 0 THEN 'SCAN: Perform deep malware analysis' END,
                 CASE WHEN header_score > 0.7e0 THEN 'VERIFY: Verify sender authenticity through alternative channels' END,
                 CASE WHEN header_score > 0.7e0 THEN 'INVESTIGATE: Review email routing and authentication failures' END,
                 CASE WHEN threat_score > 0.8e0 THEN 'ESCALATE: Report to security team for investigation' END,
                 CASE WHEN threat_score > 0.8e0 THEN 'EDUCATE: Provide phishing awareness training to recipient' END,
                 CASE WHEN threat_score > 0.5e0 AND threat_score <= 0.8e0 THEN 'MONITOR: Increase monitoring for similar threats' END,
                 CASE WHEN threat_score > 0.5e0 AND threat_score <= 0.8e0 THEN 'CAUTION: Advise recipient to exercise caution' END],
                 lambda x: x IS NOT NULL) AS recommendations FROM b_judged""",
    "b_decided": """SELECT *, CASE WHEN whitelisted THEN 0e0 ELSE threat_score END AS risk_score,
               CASE WHEN whitelisted THEN 'low' WHEN threat_score >= 0.7e0 THEN 'high' WHEN threat_score >= 0.3e0 THEN 'medium' ELSE 'low' END AS risk_level,
               CASE WHEN whitelisted THEN 'release' WHEN threat_score >= 0.7e0 THEN 'quarantine' WHEN len(threats) > 2 THEN 'quarantine' ELSE 'release' END AS action
        FROM b_threats""",
}
