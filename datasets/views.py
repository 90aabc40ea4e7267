"""Derived input views, one SQL text for Spark and DuckDB.

The test tables hold no mail, so these views turn them into mails, links, headers,
attachments, verdict feeds and facts by arithmetic on their keys. The same text is used
for both engines with a few dialect words swapped; the jobs under test are written
separately on each side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
HOUR_AS_OF = "2024-01-20 12:00:00"
HISTORY_AS_OF = "1998-12-01 00:00:00"

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DIALECTS = {
    "spark": {
        "NTZ": "TIMESTAMP_NTZ",
        "DIV": "div",
        "ARR": "array",
        "SHA": lambda x: f"sha2({x}, 256)",
        "MAILDATE": lambda ts: f"date_format({ts}, 'EEE, dd MMM yyyy HH:mm:ss')",
        "REPEAT": lambda n, var, body: f"transform(slice(sequence(0, 12), 1, cast({n} as int)), {var} -> {body})",
    },
    "duckdb": {
        "NTZ": "TIMESTAMP",
        "DIV": "//",
        "ARR": "list_value",
        "SHA": lambda x: f"sha256({x})",
        "MAILDATE": lambda ts: f"strftime({ts}, '%a, %d %b %Y %H:%M:%S')",
        "REPEAT": lambda n, var, body: f"list_transform(range({n}), lambda {var}: {body})",
    },
}

SUBJECTS = [
    "Team lunch", "Urgent: act now, immediate deadline", "Verify your account",
    "Invoice payment by wire transfer or bitcoin from your bank", "Winner of the lottery prize",
    "Urgente: tiempo limitado", "Compte suspendu", "Amazon Microsoft PayPal", "Meeting notes",
    "Tax refund and inheritance", "GREAT SUCCESS!!",
]
PHRASES = [
    "", "please click here to verify account, expires today", "login with your PayPal password",
    "wire transfer for the lottery winner, $1,000 and €500", "enable macros to see it",
    "western union advance fee +1 555-123-4567", "hellooo qxz world. lower start? display:none",
]
BLOB = "QUJDREVGR0hJSktMTU5PUFFS"
EXTENSIONS = [
    ".pdf", ".exe", ".zip", ".pdf.exe", ".docx", ".js", ".tar.gz", ".app", "", ".iso", ".txt", ".scr",
]
SIZES = [0, 500, 5000, 2000000, 11000000, 60000000, 120000000]
COUNTRIES = "USCNRUDEFRNGBRPKINJPGBCAVNIDAUPHMYBDITESNLSEPLMXZA"


def _case(key: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {key} {whens} ELSE {values[-1]} END"


def _quoted(values: list[str]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'true' ELSE 'false' END"


def _level(score: str) -> str:
    return (f"CASE WHEN {score} >= 0.9e0 THEN 'CRITICAL' WHEN {score} >= 0.7e0 THEN 'HIGH' "
            f"WHEN {score} >= 0.5e0 THEN 'MEDIUM' ELSE 'LOW' END")


def _feed(ioc_type: str, source: str, table: str, error: str, **fields: str) -> str:
    columns = {
        "malicious": "CAST(NULL AS BIGINT)", "suspicious": "CAST(NULL AS BIGINT)",
        "harmless": "CAST(NULL AS BIGINT)", "query_status": "CAST(NULL AS VARCHAR(20))",
        "threat": "CAST(NULL AS VARCHAR(20))", "in_database": "CAST(NULL AS BOOLEAN)",
        "verified": "CAST(NULL AS BOOLEAN)", "abuse_pct": "CAST(NULL AS BIGINT)",
        "sandbox_score": "CAST(NULL AS BIGINT)", "verdict": "CAST(NULL AS VARCHAR(20))",
    }
    columns.update(fields)
    listed = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return (f"SELECT ioc, '{ioc_type}' AS ioc_type, '{source}' AS source, "
            f"CASE WHEN {error} THEN 'HTTP 500' END AS error, {listed} FROM {table}")


def build(dialect: str) -> dict[str, str]:
    """View name -> SQL text in the given dialect, dependencies before dependants."""
    d = DIALECTS[dialect]
    ntz, div, arr = d["NTZ"], d["DIV"], d["ARR"]
    start = f"CAST('2024-01-01 00:00:00' AS {ntz})"
    v: dict[str, str] = {}

    v["v_analyses"] = f"""
        SELECT 'm' || event_id AS email_id,
               'user' || user_id || '@d' || (user_id % 17) || '.example.com' AS sender_email,
               'user' || (event_id * 7 % 150) AS recipient_email,
               event_type || ' ' || event_id AS subject,
               least(value / 100e0, 1e0) AS threat_score,
               {_level('least(value / 100e0, 1e0)')} AS threat_level,
               least(value / 100e0, 1e0) > 0.7e0 AS is_phishing,
               least(value / 100e0, 1e0) >= 0.7e0 AS is_quarantined,
               abs(least(value / 100e0, 1e0) - 0.5e0) * 2e0 AS confidence,
               event_id % 9000 AS duration_ms,
               ((event_id * 7) % 101) / 100e0 AS content_score,
               ((event_id * 11) % 101) / 100e0 AS url_score,
               ((event_id * 13) % 101) / 100e0 AS attachment_score,
               ((event_id * 17) % 101) / 100e0 AS header_score,
               ((event_id * 19) % 101) / 100e0 AS manipulation_score,
               {_case('event_id % 3', _quoted(['en', 'es', 'fr']))} AS lang,
               {_case('event_id % 4', _quoted(['PHISHING', 'MALWARE', 'SPAM', 'FINANCIAL_SCAM']))} AS threat_category,
               event_type AS threat_type,
               event_id % 3 = 0 AS verified_threat,
               substr('{COUNTRIES}', CAST(2 * (user_id % 25) + 1 AS INTEGER), 2) AS sender_country,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
               CASE WHEN event_id % 7 = 0 THEN event_id % 2 = 0 END AS false_positive,
               ts AS created_at
        FROM events"""

    v["v_urls"] = f"""
        SELECT 'm' || (page_id {div} 3) AS message_id, page_id,
               {_case('page_id % 9', [
                   "url", "'http://192.168.' || (page_id % 256) || '.7/login'", "'http://bit.ly/' || page_id",
                   "'http://paypa1.com/secure/update?redirect=http://x.tk'",
                   "url || repeat('a', CAST(90 + page_id % 241 AS INTEGER))",
                   "'http://a.b.c.micros0ft.com/verify/account?next=1&t=QUJDREVGR0hJSktMTU5PUFFSU1RVVldY'",
                   "'http://ex.tk/%41%42%43%44%45/signin'", "'http://www.paypal.com/login'",
                   "'https://gooogle.com/'"])} AS url
        FROM pages"""

    v["v_emails"] = f"""
        SELECT 'm' || doc_id AS message_id, doc_id,
               'user' || (doc_id % 101) || '@corp.example.com' AS user_email,
               CASE WHEN doc_id % 10 = 9 THEN 'junk' ELSE 'inbox' END AS folder,
               'user' || (doc_id % 37) || '@' || {_case('doc_id % 5', _quoted(
                   ['microsoft.com', 'example.com', 'mailinator.com', 'corp.example.org', 'gmail.com']))} AS sender,
               {arr}('user' || (doc_id % 101), 'user' || (doc_id % 13)) AS recipients,
               {start} + doc_id * INTERVAL '40' MINUTE AS received_at,
               {_case('doc_id % 11', _quoted(SUBJECTS))} AS subject,
               CASE WHEN doc_id % 4 = 0 THEN 'html' ELSE 'text' END AS content_type,
               CASE WHEN doc_id % 4 = 0 THEN '<html><body>' ELSE '' END
               || CASE WHEN doc_id % 8 = 0 THEN '<div style="display:none;font-size:0">x</div>' ELSE '' END
               || text || ' ' || {_case('doc_id % 7', _quoted(PHRASES))} || ' '
               || CASE WHEN doc_id % 31 = 0 THEN '{' '.join([BLOB] * 4)} ' ELSE '' END
               || coalesce(u0 || '. ', '') || coalesce(u1 || ' ', '') || coalesce(u2 || '! ', '')
               || CASE WHEN doc_id % 4 = 0 THEN '</body></html>' ELSE '' END AS content,
               lang, n_chars
        FROM documents LEFT JOIN (
            SELECT message_id AS mid,
                   max(CASE WHEN page_id % 3 = 0 THEN url END) AS u0,
                   max(CASE WHEN page_id % 3 = 1 THEN url END) AS u1,
                   max(CASE WHEN page_id % 3 = 2 THEN url END) AS u2
            FROM v_urls GROUP BY message_id) links ON 'm' || doc_id = mid"""

    hop_ip = _case("(doc_id + i) % 7", [
        "'10.0.' || i || '.' || (doc_id % 256)", "'8.8.8.8'", "'256.1.2.3'", "'192.168.1.' || i",
        "(20 + (doc_id * 3 + i * 5) % 30) || '.' || (doc_id % 256) || '.' || ((doc_id + i) % 256) || '.' || (i + 1)"])
    hop_host = ("CASE WHEN (doc_id + i) % 9 = 0 THEN 'localhost' WHEN (doc_id + i) % 10 = 0 "
                "THEN 'relay.Mailinator.com' ELSE 'h' || i || '.example.net' END")
    hop_time = (f"({start} + (doc_id * 2400 - i * 60 "
                "- CASE WHEN doc_id % 8 = 0 AND i >= 2 THEN 90000 ELSE 0 END "
                "+ CASE WHEN doc_id % 12 = 0 AND i = 1 THEN 7200 ELSE 0 END) * INTERVAL '1' SECOND)")
    hop = (f"'from ' || {hop_host} || ' ([' || {hop_ip} || ']) by mx' || i || '.example.com with ESMTP; ' || "
           f"{d['MAILDATE'](hop_time)} || CASE WHEN (doc_id + i) % 6 = 0 THEN ' +0200' ELSE ' +0000 (UTC)' END")
    header_columns = f"""
               CASE WHEN doc_id % 29 = 0 THEN NULL ELSE
                 'User <user' || (doc_id % 37) || '@' || {_case('doc_id % 5', _quoted(
                     ['microsoft.com', 'example.com', 'mailinator.com', 'corp.example.org', 'gmail.com']))} || '>' END AS from_h,
               CASE WHEN doc_id % 29 = 0 THEN NULL
                    WHEN doc_id % 6 = 0 THEN '<bounce@elsewhere.example>'
                    ELSE '<User' || (doc_id % 37) || '@' || {_case('doc_id % 5', _quoted(
                     ['microsoft.com', 'example.com', 'mailinator.com', 'corp.example.org', 'gmail.com']))} || '>' END AS return_path,
               CASE WHEN doc_id % 29 = 0 THEN NULL ELSE {_case('doc_id % 5', _quoted(
                   ['Pass (sender ok)', 'Fail (not permitted)', 'SoftFail (moving)', 'Neutral (no policy)']) + ['NULL'])} END AS spf,
               CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 3 < 2 THEN 'v=1; a=rsa-sha256; d=example.com' END AS dkim,
               CASE WHEN doc_id % 29 = 0 THEN NULL ELSE {_case('doc_id % 4', _quoted(
                   ['mx; dkim=pass; dmarc=pass', 'mx; dkim=fail; dmarc=fail', 'mx; dmarc=quarantine', 'mx; DMARC=reject']))} END AS auth,
               CASE WHEN doc_id % 29 = 0 THEN NULL ELSE
                 {d['MAILDATE'](f"({start} + (doc_id * 2400 - 3600) * INTERVAL '1' SECOND)")} || ' +0000' END AS date_h,
               {d['REPEAT']('CASE WHEN doc_id % 29 = 0 THEN 0 ELSE doc_id % 13 END', 'i', hop)} AS hops"""
    v["v_headers"] = f"SELECT 'm' || doc_id AS message_id, doc_id, {header_columns} FROM documents"
    v["v_mails"] = f"SELECT v_emails.*, {header_columns} FROM v_emails"

    v["v_attachments"] = f"""
        SELECT 'm' || doc_id AS message_id, p_partkey,
               CASE WHEN p_partkey % 97 = 5 THEN 'invoice 12345678901234567890' ELSE p_name END
               || {_case('p_partkey % 12', _quoted(EXTENSIONS))} AS filename,
               CAST({_case('p_partkey % 7', [str(s) for s in SIZES])} AS BIGINT) AS file_size,
               {_case('p_partkey % 3', ["'application/pdf'", "'application/octet-stream'", "'application/x-msdownload'"])} AS mime_type,
               CASE WHEN p_partkey % 50 = 49 THEN NULL ELSE text ||
                 CASE WHEN p_partkey % 5 = 0 THEN ' Enable Macros; run setup.exe; urgent: click here' ELSE '' END END AS data
        FROM part JOIN documents ON doc_id = p_partkey {div} 2"""

    v["v_distinct_urls"] = "SELECT url, min(page_id) AS pid FROM v_urls GROUP BY url"
    v["v_url_reports_a"] = f"""
        SELECT url, '{{"positives":' || (pid % 8)
               || CASE WHEN pid % 22 = 0 THEN '' WHEN pid % 50 = 0 THEN ',"total":0' ELSE ',"total":8' END
               || ',"scans":{{"e1":{{"detected":' || {_flag('pid % 3 = 0')} || ',"result":"Phishing"}},"e2":{{"detected":'
               || {_flag('pid % 4 = 0')} || ',"result":"Malware"}},"e3":{{"detected":' || {_flag('pid % 8 = 0')}
               || ',"result":"phishing"}},"e4":{{"detected":' || {_flag('pid % 5 = 0')} || ',"result":"Trojan.Generic"}}}}}}' AS report
        FROM v_distinct_urls WHERE pid % 2 = 0"""
    v["v_url_reports_b"] = f"""
        SELECT url, '{{"detections":{{"count":' || (pid % 4) || ',"engines":{{'
               || CASE WHEN pid % 9 = 0 THEN '' ELSE '"h1":{{"detected":' || {_flag('pid % 2 = 1')}
               || ',"category":"phishing"}},"h2":{{"detected":' || {_flag('pid % 5 = 0')}
               || '}},"h3":{{"detected":false,"category":"spam"}},"h4":{{"detected":' || {_flag('pid % 6 = 0')}
               || ',"category":"fraud"}}' END || '}}}}}}' AS report
        FROM v_distinct_urls WHERE pid % 3 = 0"""

    v["v_file_hashes"] = f"""
        SELECT {d['SHA']('data')} AS file_hash, min(p_partkey) AS pid
        FROM v_attachments WHERE data IS NOT NULL GROUP BY {d['SHA']('data')}"""
    v["v_file_reports"] = f"""
        SELECT file_hash, '{{"positives":' || (pid % 8) || ',"total":8,"scans":{{"e1":{{"detected":' || {_flag('pid % 3 = 0')}
               || ',"result":' || {_case('pid % 5', _quoted(['"Trojan.Win32"', '"Crypto.Locker"', '"AdWare.Bundle"', '"Backdoor.X"', '"Generic"']))}
               || '}},"e2":{{"detected":' || {_flag('pid % 4 = 0')} || ',"result":"Worm.Mail"}}}}}}' AS report
        FROM v_file_hashes WHERE pid % 4 <> 1"""

    v["v_ioc_urls"] = "SELECT url AS ioc, pid AS k FROM v_distinct_urls"
    v["v_ioc_ips"] = """
        SELECT ioc, min(doc_id) AS k FROM (
            SELECT (20 + doc_id % 30) || '.' || (doc_id % 256) || '.7.' || (doc_id % 11) AS ioc, doc_id FROM documents) x
        GROUP BY ioc"""
    v["v_ioc_domains"] = """
        SELECT 'd' || (user_id % 97) || '.example.com' AS ioc, min(user_id) AS k
        FROM events GROUP BY 'd' || (user_id % 97) || '.example.com'"""
    v["v_ioc_hashes"] = "SELECT file_hash AS ioc, pid AS k FROM v_file_hashes"
    stats = {"malicious": "k % 5", "suspicious": "k % 3", "harmless": "CASE WHEN k % 7 = 0 THEN 0 ELSE 4 END"}
    v["v_feeds"] = "\n        UNION ALL ".join([
        _feed("url", "virustotal", "v_ioc_urls", "k % 5 = 0", **stats),
        _feed("url", "urlhaus", "v_ioc_urls", "k % 11 = 0",
              query_status="CASE WHEN k % 4 = 0 THEN 'ok' ELSE 'no_results' END", threat="'malware_download'"),
        _feed("url", "phishtank", "v_ioc_urls", "k % 13 = 0", in_database="k % 2 = 0", verified="k % 6 = 0"),
        _feed("url", "custom_feeds", "v_ioc_urls", "k % 10 = 0"),
        _feed("ip", "abuseipdb", "v_ioc_ips", "k % 5 = 0", abuse_pct="(k * 13) % 101"),
        _feed("ip", "virustotal_ip", "v_ioc_ips", "k % 10 = 0", **stats),
        _feed("ip", "custom_feeds", "v_ioc_ips", "k % 20 = 0"),
        _feed("domain", "virustotal_domain", "v_ioc_domains", "k % 5 = 0", **stats),
        _feed("domain", "custom_feeds", "v_ioc_domains", "k % 15 = 0"),
        _feed("hash", "virustotal_hash", "v_ioc_hashes", "k % 5 = 0", **stats),
        _feed("hash", "hybrid_analysis", "v_ioc_hashes", "k % 9 = 0",
              sandbox_score="CASE WHEN k % 3 = 0 THEN (k * 7) % 101 END",
              verdict="CASE WHEN k % 3 = 0 THEN 'malicious' ELSE 'not_found' END"),
    ])

    v["v_history"] = f"""
        SELECT 'o' || o_orderkey AS message_id, o_orderkey,
               CASE WHEN o_orderkey % 20 = 0 THEN 'user0' ELSE 'user' || o_custkey END AS sender,
               {arr}('user' || (o_orderkey % 101), 'user' || (o_orderkey % 13)) AS recipients,
               o_orderdate AS sent_at, (o_orderkey * 37) % 5000 AS body_length,
               o_orderpriority || ' ' || (o_orderkey % 40) AS subject
        FROM orders"""
    v["v_geo"] = f"""
        SELECT substr('{COUNTRIES}', CAST(2 * n_nationkey + 1 AS INTEGER), 2) AS country,
               (20 + n_nationkey) * 16777216e0 AS s, CASE WHEN n_nationkey % 2 = 0 THEN 16777215e0 ELSE 8388607e0 END AS w
        FROM nation
        UNION ALL SELECT 'US' AS country, 134744072e0 AS s, 0e0 AS w FROM region WHERE r_regionkey = 0"""
    v["v_geo_ranges"] = """
        SELECT country, CAST(s AS BIGINT) AS start_ip, CAST(s + w AS BIGINT) AS end_ip FROM v_geo"""
    v["v_requests"] = f"""
        SELECT event_id AS request_id,
               CASE event_type WHEN 'click' THEN '/api/analyze-email' WHEN 'view' THEN '/api/stats'
                    WHEN 'signup' THEN '/api/quarantine' WHEN 'error' THEN '/admin/users' ELSE '/index.html' END AS path,
               '10.0.0.' || (user_id % 2) AS client_ip,
               CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (user_id % 2) || ' , 172.16.0.1' END AS forwarded_for,
               CASE WHEN event_id % 3 = 1 THEN '10.0.0.' || (user_id % 2) END AS real_ip,
               CASE WHEN event_id % 3 = 2 AND event_id % 5 > 0 THEN '10.0.0.' || (user_id % 2) END AS peer_ip,
               {_case('event_id % 6', _quoted(['Mozilla/5.0', 'GoogleBot/2.1', 'curl/8', 'Security-Scanner 1', 'Web Crawler', 'Safari']))} AS user_agent,
               {start} + event_id * INTERVAL '5' SECOND AS ts
        FROM events"""
    v["v_audit"] = f"""
        SELECT event_id,
               {_case('event_id % 9', _quoted(['user_login', 'user_logout', 'email_analyzed', 'email_quarantined',
                   'email_released', 'config_changed', 'model_retrained', 'report_generated', 'security_alert']))} AS event_type,
               'u' || user_id AS user_id, 'user' || user_id || '@corp.example.com' AS user_email,
               'm' || event_id AS resource_id, event_type AS action, props AS details,
               '10.0.0.' || (user_id % 250) AS ip_address,
               CASE WHEN event_id % 2 = 0 THEN 'Mozilla/5.0' ELSE 'curl/8' END AS user_agent,
               event_type <> 'error' AS success, ts AS created_at
        FROM events"""
    v["v_models"] = f"""
        SELECT {_case('s_suppkey % 4', _quoted(['random_forest', 'svm', 'deep_learning', 'ensemble']))} AS model_name,
               s_suppkey AS version,
               CAST('{AS_OF}' AS {ntz}) - (s_suppkey % 45 + 1) * INTERVAL '12' HOUR AS training_date,
               0.8e0 + (s_suppkey % 20) / 100e0 AS accuracy, 0.7e0 + (s_suppkey % 30) / 100e0 AS precision_score,
               0.6e0 + (s_suppkey % 40) / 100e0 AS recall, 0.5e0 + (s_suppkey % 50) / 100e0 AS f1_score,
               s_suppkey % 3 > 0 AS is_active
        FROM supplier"""
    v["v_predictions"] = "\n        UNION ALL ".join(
        f"SELECT 'm' || doc_id AS message_id, doc_id, '{model}' AS model_name, toxic AS label, "
        f"((doc_id * {k}) % 1000) / 1000e0 AS probability, CASE WHEN {error} THEN 'failed' END AS error, "
        f"(doc_id * {k}) % 300 AS inference_ms, {start} + doc_id * INTERVAL '40' MINUTE AS created_at "
        f"FROM labels WHERE {present}"
        for model, k, error, present in [
            ("random_forest", 7, "doc_id % 10 = 0", "doc_id % 9 <> 1"), ("svm", 11, "doc_id % 4 = 0", "doc_id % 9 <> 1"),
            ("deep_learning", 13, "doc_id % 7 = 0", "doc_id % 9 <> 2"), ("ensemble", 17, "doc_id % 6 = 0", "doc_id % 3 = 0")])
    v["v_ocr"] = f"""
        SELECT page_id, url, html || {_case('page_id % 5', _quoted(['', ' Microsoft', ' PayPal and Adobe', ' zoom slack dropbox', ' Netflix']))} AS ocr_text,
               page_id % 15 AS shapes, ((page_id * 7) % 101) / 100e0 AS brand_score,
               ((page_id * 11) % 101) / 100e0 AS template_score
        FROM pages"""
    v["v_qr"] = f"""
        SELECT 'm' || (page_id {div} 4) AS message_id, page_id,
               CASE WHEN page_id % 3 = 0 THEN 'tel:' || page_id ELSE url END AS payload
        FROM pages"""
    v["v_releases"] = f"""
        SELECT 'm' || event_id AS email_id, ts + INTERVAL '1' HOUR AS released_at, 'admin' || (user_id % 3) AS released_by
        FROM events WHERE event_id % 7 = 0
        UNION ALL
        SELECT 'm' || event_id AS email_id, ts + INTERVAL '2' HOUR AS released_at, 'admin' || (user_id % 5) AS released_by
        FROM events WHERE event_id % 14 = 0"""
    v["v_incoming"] = f"""
        SELECT CASE WHEN event_id % 6 = 0 THEN 'x' || event_id ELSE 'm' || event_id END AS email_id, s AS seq,
               'new' || user_id AS sender_email, 'new' || event_id AS recipient_email, 're ' || event_type AS subject,
               {_level('((event_id * (30 + s)) % 101) / 100e0')} AS threat_level,
               ((event_id * (30 + s)) % 101) / 100e0 AS threat_score,
               ((event_id * (30 + s)) % 101) / 100e0 > 0.7e0 AS is_phishing,
               0.5e0 AS confidence, 'rescan ' || s AS analysis_details,
               CAST('{AS_OF}' AS {ntz}) + s * INTERVAL '1' MINUTE AS received_at
        FROM events JOIN (SELECT r_regionkey + 1 AS s FROM region WHERE r_regionkey < 2) n ON event_id % 3 = 0"""
    v["v_subscriptions"] = f"""
        SELECT 'user' || c_custkey AS user_email, 'sub' || c_custkey AS subscription_id,
               CAST('{AS_OF}' AS {ntz}) + (c_custkey % 100 - 20) * INTERVAL '1' HOUR AS expires_at
        FROM customer"""
    return v


VIEWS = {dialect: build(dialect) for dialect in DIALECTS}


def _needed(text: str, names) -> set[str]:
    return {n for n in names if re.search(rf"\b{n}\b", text)}


def with_views(dialect: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by a WITH clause holding every view it uses, directly or not."""
    views = {**VIEWS[dialect], **(extra or {})}
    wanted: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for name in sorted(_needed(text, views)):
            if name not in wanted and name not in open_:
                open_.add(name)
                visit(views[name])
                wanted.append(name)

    visit(body)
    if not wanted:
        return body
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in wanted)
    return f"WITH {ctes}\n{body}"


def _source(sf_dir: str, name: str) -> str:
    """FROM item of a given table."""
    return f"parquet.`{sf_dir}/{name}.parquet`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.sql(f"SELECT * FROM {_source(sf_dir, name)}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view (or a given table) as a lazy DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = with_views("spark", f"SELECT * FROM {name}")
    used = _needed(text, TABLES)
    for t in used:
        item = _source(sf_dir, t)
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", lambda m: f"{m.group(1)} {item}", text)
    return spark.sql(text)
