"""Response jobs."""

from pyspark.sql import functions as F

from catalog import urls as ur
from catalog.registry import plain, register
from datasets.views import AS_OF, view
from mailquarry import lexicon as lx
from mailquarry.operators import content, respond
from mailquarry.operators.respond import ALERT_BODY, INCIDENT_DESCRIPTION
from oracles import content as oc
from oracles.sql import URL_CTES, items, q

_AT = "'2024-01-31 00:00:00'"
_RULES = ", ".join(f"({q(level)}, {items(actions)})" for level, actions in lx.RESPONSE_ACTIONS.items())
CTES = {
    "r_judged": """SELECT email_id, sender_email AS sender, subject, CASE WHEN duration_ms % 50 = 49 THEN 'SEVERE' ELSE threat_level END AS threat_level,
               threat_score, created_at AS received_at, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS received FROM v_analyses""",
    "r_rules": f"SELECT * FROM (VALUES {_RULES}) r(threat_level, actions)",
    "r_plan": """SELECT email_id, sender, threat_level, threat_score, CASE WHEN actions IS NULL THEN '''' || threat_level || ''' is not a valid ThreatLevel' END AS error,
               position, actions[position + 1] AS action
        FROM (SELECT j.*, r.actions, unnest(CASE WHEN r.actions IS NULL THEN [NULL] ELSE range(len(r.actions)) END) AS position FROM r_judged j LEFT JOIN r_rules r USING (threat_level)) x""",
}


def judged(spark, sf):
    """Judged mails; some carry a level that no rule knows."""
    return view(spark, sf, "v_analyses").select(
        "email_id", F.col("sender_email").alias("sender"), "subject",
        F.when(F.col("duration_ms") % 50 == 49, "SEVERE").otherwise(F.col("threat_level")).alias("threat_level"),
        "threat_score", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"), "created_at")


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


@register("join_response_rules", """
    SELECT threat_level, position, action, count(*) AS mails FROM r_plan WHERE action IS NOT NULL GROUP BY threat_level, position, action""", CTES)
def join_response_rules(spark, sf):
    plan = respond.response_plan(judged(spark, sf), respond.action_rules(spark))
    return plain(plan.filter("action is not null").groupBy("threat_level", "position", "action").agg(F.count(F.lit(1)).alias("mails")))


@register("response_plan", "SELECT email_id, sender, threat_level, round(threat_score, 8) AS threat_score, error, position, action FROM r_plan", CTES)
def response_plan(spark, sf):
    return plain(respond.response_plan(judged(spark, sf), respond.action_rules(spark)))


@register("response_quarantine", f"""
    SELECT email_id, 'Automated response to ' || threat_level || ' threat' AS reason, 'QUARANTINED' AS status, {_AT} AS quarantined_at
    FROM r_plan WHERE action = 'quarantine'""", CTES)
def response_quarantine(spark, sf):
    plan = respond.response_plan(judged(spark, sf), respond.action_rules(spark))
    return plain(respond.quarantine_rows(plan, now()))


@register("response_log", f"""
    SELECT {_AT} AS timestamp, threat_level, email_id, sender, array_to_string(actions, '|') AS actions_executed FROM r_judged JOIN r_rules USING (threat_level)""", CTES)
def response_log(spark, sf):
    return plain(respond.response_log(judged(spark, sf), respond.action_rules(spark), now()))


@register("response_blocklist", """
    SELECT sender, round(max(threat_score), 8) AS threat_score, max_by(email_id, (threat_score, email_id)) AS email_id, 'Automated block due to CRITICAL threat' AS reason
    FROM r_judged WHERE threat_level = 'CRITICAL' GROUP BY sender""", CTES)
def response_blocklist(spark, sf):
    return plain(respond.blocklist(judged(spark, sf)))


def _template(text: str, *values: str) -> str:
    """SQL concatenation of a fixed text with %s fields."""
    parts = text.split("%s")
    out = [q(parts[0])]
    for value, rest in zip(values, parts[1:]):
        out += [value, q(rest)]
    return " || ".join(out)


_S2, _S3 = "printf('%.2f', threat_score)", "printf('%.3f', threat_score)"


@register("response_alerts", f"""
    SELECT email_id, '🚨 ' || threat_level || ' Threat Detected' AS alert_subject,
           {_template(ALERT_BODY, 'threat_level', 'sender', 'subject', _S2, _AT)} AS alert_body,
           CASE WHEN threat_level IN ('HIGH', 'CRITICAL') THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM r_judged""", CTES)
def response_alerts(spark, sf):
    return respond.alerts(judged(spark, sf), F.lit(AS_OF))


@register("response_incidents", f"""
    SELECT 'INC-' || substr(sha256(email_id), 1, 16) AS incident_id, 'Phishing Email Detected - CRITICAL Risk' AS title,
           {_template(INCIDENT_DESCRIPTION, 'threat_level', 'email_id', 'sender', 'subject', 'received', _S3)} AS description,
           threat_level AS severity, 'Email Security' AS category, email_id FROM r_judged WHERE threat_level = 'CRITICAL'""", CTES)
def response_incidents(spark, sf):
    return respond.incidents(judged(spark, sf))


@register("stats_response", f"""
    WITH recent AS (SELECT j.threat_level, r.actions FROM r_judged j JOIN r_rules r USING (threat_level)
                    WHERE received_at > TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AND received_at <= TIMESTAMP '{AS_OF}')
    SELECT 'level' AS kind, threat_level AS name, count(*)::DOUBLE AS value FROM recent GROUP BY threat_level
    UNION ALL SELECT 'action' AS kind, name, count(*)::DOUBLE AS value FROM (SELECT unnest(actions) AS name FROM recent) a GROUP BY name
    UNION ALL SELECT 'total' AS kind, 'responses' AS name, count(*)::DOUBLE AS value FROM recent
    UNION ALL SELECT 'total' AS kind, 'per_day' AS name, round(count(*) / 20e0, 8) AS value FROM recent""".replace(
    "WITH recent AS", "SELECT * FROM (WITH recent AS") + ") z", CTES)
def stats_response(spark, sf):
    log = respond.response_log(judged(spark, sf), respond.action_rules(spark), F.col("created_at"))
    return plain(respond.response_statistics(log, AS_OF, 20))


SIMILAR = {
    **URL_CTES,
    "k_bad": "SELECT DISTINCT message_id, url FROM s_judged WHERE reputation_category <> 'CLEAN'",
    "k_words": "SELECT message_id, list_filter(string_split_regex(lower(subject), '\\s+'), lambda w: length(w) > 3)[1:3] AS w, sender FROM v_emails",
    "k_ind": """SELECT DISTINCT message_id, indicator FROM (
        SELECT message_id, 'sender_domain:' || split_part(sender, '@', 2) AS indicator FROM k_words
        UNION ALL SELECT message_id, 'subject_keyword:' || unnest(w) AS indicator FROM k_words
        UNION ALL SELECT message_id, 'url:' || url AS indicator FROM k_bad) x""",
    "k_threats": f"SELECT DISTINCT message_id FROM ({oc.rule_rows('v_emails', 'message_id', 'content')}) r WHERE score >= 0.8e0",
}


def bad_links(spark, sf):
    """Links that are not clean count as malicious here, so that enough mails share one."""
    return ur.scored_links(spark, sf).filter(F.col("reputation_category") != "CLEAN").select("message_id", "url").distinct()


def threat_mails(spark, sf):
    mails = view(spark, sf, "v_emails")
    found = content.scan_text(mails).filter("rule_score >= 0.8").select("message_id")
    return mails.select("message_id", "sender").join(found, "message_id", "left_semi")


@register("extract_sender_domain", "SELECT message_id, lower(split_part(sender, '@', 2)) AS sender_domain FROM v_emails")
def extract_sender_domain(spark, sf):
    return respond.sender_domains(view(spark, sf, "v_emails"))


@register("extract_indicators", "SELECT message_id, indicator FROM k_ind", SIMILAR)
def extract_indicators(spark, sf):
    return respond.indicators(view(spark, sf, "v_emails"), bad_links(spark, sf))


_KNOWN = "SELECT 'sender_pattern' AS type, 'user' || user_id || '@gmail.com' AS pattern FROM events WHERE user_id % 2 = 0"


@register("extract_patterns", f"""
    SELECT p.*, 'automated_analysis' AS source FROM (
        SELECT DISTINCT 'url_pattern' AS type, url AS pattern, 0.8e0 AS confidence FROM k_bad WHERE message_id IN (SELECT message_id FROM k_threats)
        UNION SELECT 'sender_pattern' AS type, sender AS pattern, 0.7e0 AS confidence FROM v_emails WHERE message_id IN (SELECT message_id FROM k_threats)) p
    WHERE (type, pattern) NOT IN ({_KNOWN})""", SIMILAR)
def extract_patterns(spark, sf):
    known = view(spark, sf, "events").filter("user_id % 2 = 0").select(
        F.lit("sender_pattern").alias("type"), F.format_string("user%d@gmail.com", "user_id").alias("pattern"))
    return plain(respond.detection_patterns(threat_mails(spark, sf), bad_links(spark, sf), known))


@register("join_similar_threats", """
    SELECT t.message_id, count(DISTINCT o.message_id) AS emails_scanned, count(DISTINCT ot.message_id) AS threats_found
    FROM k_threats t JOIN k_ind a ON a.message_id = t.message_id
    LEFT JOIN k_ind o ON o.indicator = a.indicator AND o.message_id <> t.message_id
    LEFT JOIN k_threats ot ON ot.message_id = o.message_id GROUP BY t.message_id""", SIMILAR)
def join_similar_threats(spark, sf):
    found = respond.indicators(view(spark, sf, "v_emails"), bad_links(spark, sf))
    return plain(respond.similar_threats(found, threat_mails(spark, sf)))


@register("sink_alerts", """
    SELECT email_id, threat_level, round(threat_score, 8) AS threat_score, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS alert_sent_at
    FROM r_judged WHERE threat_level IN ('HIGH', 'CRITICAL')""", CTES)
def sink_alerts(spark, sf):
    from mailquarry.sinks.facts import append_and_read

    rows = judged(spark, sf).filter(F.col("threat_level").isin("HIGH", "CRITICAL")).select(
        "email_id", "threat_level", "threat_score", F.col("created_at").alias("alert_sent_at"))
    return plain(append_and_read(rows, "threat_alerts", "alert_sent_at"))


