"""Oracle texts for the attachment jobs."""

from mailquarry import lexicon as lx
from mailquarry.operators.attachments import RULE_FAMILIES, VENDOR_FAMILIES  # fixed values
from oracles.content import rule_rows
from oracles.sql import any_of, hits, isin, q, scan_verdicts

_ext = "CASE ext " + " ".join(f"WHEN {q(e)} THEN {s!r}::DOUBLE" for e, s in lx.EXTENSION_SCORES.items())
_ext += f" ELSE CASE WHEN {isin('ext', lx.EXECUTABLE_EXTENSIONS)} THEN 0.8e0 ELSE 0e0 END END"
_mime = "CASE ext " + " ".join(f"WHEN {q(e)} THEN {q(m)}" for e, m in sorted(lx.EXPECTED_MIME.items())) + " END"


def _family(col: str, families) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, {q(w)}) THEN {q(n)}" for w, n in families) + " END"


FILES = {
    "a_ext": r"""SELECT *, CASE WHEN ends_with(lower(filename), '.tar.gz') THEN '.tar.gz' WHEN ends_with(lower(filename), '.tar.bz2') THEN '.tar.bz2'
               ELSE regexp_extract(lower(filename), '[^/](\.[^./]+)$', 1) END AS ext,
               list_reverse(string_split(lower(filename), '.')) AS parts FROM v_attachments""",
    "a_scores": f"""SELECT *, {_mime} AS expected_mime,
               CASE WHEN len(parts) >= 3 AND {isin("'.' || parts[2]", lx.DOCUMENT_EXTENSIONS)} AND {isin('ext', lx.EXECUTABLE_EXTENSIONS)} THEN 0.9e0 ELSE {_ext} END AS extension_score,
               CASE WHEN file_size = 0 THEN 0.3e0 WHEN file_size < 1024 THEN 0.2e0 WHEN file_size > 104857600 THEN 0.4e0 ELSE 0e0 END AS size_score,
               least(CASE WHEN {isin('ext', lx.EXECUTABLE_EXTENSIONS)} THEN {hits('lower(filename)', lx.FILENAME_WORDS)} * 0.3e0 ELSE 0e0 END
                   + CASE WHEN length(filename) > 20 AND len(regexp_extract_all(filename, '\\d')) > length(filename) * 0.5e0 THEN 0.2e0 ELSE 0e0 END, 1e0) AS name_score
        FROM a_ext""",
    "a_static": f"""SELECT *, extension_score * 0.4e0 + size_score * 0.1e0 + mime_score * 0.3e0 + name_score * 0.2e0 AS static_score FROM (
        SELECT *, CASE WHEN {isin('mime_type', lx.SUSPICIOUS_MIME_TYPES)} THEN 0.8e0 WHEN expected_mime <> mime_type THEN 0.6e0 ELSE 0e0 END AS mime_score FROM a_scores) x""",
    "a_rules": rule_rows("(SELECT * FROM v_attachments WHERE data IS NOT NULL) z", "p_partkey", "data"),
    "a_matched": "SELECT p_partkey, max(score) AS rule_score, string_agg(rule_name, '|' ORDER BY rule_pos) AS rules FROM a_rules GROUP BY p_partkey",
    "a_vendor": scan_verdicts("v_file_reports", "file_hash"),
    "a_joined": """SELECT s.*, sha256(data) AS file_hash, coalesce(m.rule_score, 0e0) AS rule_score, coalesce(m.rules, '') AS rules,
               v.reputation_score AS vendor_reputation, v.is_malicious AS vendor_malicious, v.threat_types AS vendor_types,
               CASE WHEN v.is_malicious THEN 1e0 - v.reputation_score ELSE 0e0 END AS vendor
        FROM a_static s LEFT JOIN a_matched m USING (p_partkey) LEFT JOIN a_vendor v ON v.file_hash = sha256(data)""",
    "a_total": """SELECT *, least(CASE WHEN vendor > 0 THEN static_score * 0.2e0 + rule_score * 0.3e0 + vendor * 0.5e0
               WHEN rule_score > 0 THEN static_score * 0.3e0 + rule_score * 0.7e0 ELSE static_score END, 1e0) AS threat_score FROM a_joined""",
    "a_scored": f"""SELECT *, threat_score > 0.7e0 AS is_malware, CASE WHEN threat_score > 0.7e0 THEN coalesce(
               list_filter(list_transform(vendor_types, lambda t: {_family('t', VENDOR_FAMILIES)}), lambda f: f IS NOT NULL)[1], 'Unknown Malware') ELSE '' END AS malware_family
        FROM a_total""",
    "a_rollup": """SELECT message_id, count(*) AS attachment_count, least(avg(threat_score), 1e0) AS attachment_score, count_if(is_malware) AS malicious_files,
               count_if(threat_score > 0.5e0 AND NOT is_malware) AS suspicious_files FROM a_scored GROUP BY message_id""",
    "a_features": f"""SELECT message_id, 1 AS has_attachments, count(*) AS attachment_count,
               count_if({any_of('lower(filename)', lx.FEATURE_SUSPICIOUS_EXTENSIONS)}) AS suspicious_extensions,
               count_if({any_of('lower(filename)', lx.FEATURE_EXECUTABLE_EXTENSIONS)}) AS executable_attachments,
               count_if(file_size > 10485760) AS large_attachments, sum(file_size)::BIGINT AS total_attachment_size
        FROM v_attachments GROUP BY message_id""",
}
# none of the built-in rule categories names a family, so the vendor types decide
assert not any(w in r.category for r in lx.RULES for w, _ in RULE_FAMILIES)
