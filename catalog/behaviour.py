"""Sender behaviour and graph jobs."""

from pyspark.sql import functions as F

from catalog.registry import plain, register
from datasets.views import HISTORY_AS_OF, view
from mailquarry.operators import behaviour

CTES = {
    "g_edges": "SELECT sender, unnest(recipients) AS recipient, unnest(range(len(recipients))) AS pos, sent_at, message_id FROM v_history",
    "g_volume": "SELECT sender, count(*) AS email_count FROM g_edges GROUP BY sender",
    "g_high": "SELECT * FROM g_volume WHERE email_count > 3 * (SELECT avg(email_count) FROM g_volume)",
    "g_counted": "SELECT sender, recipient, count(*) AS n, min((sent_at, message_id, pos)) AS fs FROM g_edges GROUP BY sender, recipient",
    "g_top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY n DESC, fs) AS rank FROM g_counted) x WHERE rank <= 5",
    "g_subjects": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY fs) AS rank FROM (
        SELECT sender, subject, min((sent_at, message_id)) AS fs FROM v_history GROUP BY sender, subject) x) y WHERE rank <= 10""",
    "g_recent": f"SELECT * FROM v_history WHERE sent_at >= TIMESTAMP '{HISTORY_AS_OF}' - INTERVAL 7 DAY AND sent_at <= TIMESTAMP '{HISTORY_AS_OF}'",
    "g_recent_edges": "SELECT sender, unnest(recipients) AS recipient, unnest(range(len(recipients))) AS pos, sent_at, message_id FROM g_recent",
    "g_recent_top": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY n DESC, fs) AS rank FROM (
        SELECT sender, recipient, count(*) AS n, min((sent_at, message_id, pos)) AS fs FROM g_recent_edges GROUP BY sender, recipient) x) y WHERE rank <= 5""",
    "g_base": """SELECT h.sender, mails, avg_length, r.recipients FROM (SELECT sender, count(*) AS mails, avg(body_length) AS avg_length FROM v_history GROUP BY sender) h
        LEFT JOIN (SELECT sender, list_sort(list(recipient)) AS recipients FROM g_top GROUP BY sender) r USING (sender)""",
    "g_now": """SELECT h.sender, mails, avg_length, r.recipients FROM (SELECT sender, count(*) AS mails, avg(body_length) AS avg_length FROM g_recent GROUP BY sender) h
        LEFT JOIN (SELECT sender, list_sort(list(recipient)) AS recipients FROM g_recent_top GROUP BY sender) r USING (sender)""",
    "g_both": """SELECT b.*, n.avg_length AS recent_length, coalesce(n.recipients, []) AS recent_recipients FROM g_base b LEFT JOIN g_now n USING (sender)""",
    "g_score": """SELECT *, CASE WHEN mails < 10 THEN 0e0 ELSE least(CASE WHEN recent_length IS NULL THEN 0e0 ELSE coalesce(least(abs(avg_length - recent_length) / nullif(avg_length, 0), 1e0), 0e0) END * 0.3e0
               + (1e0 - len(list_intersect(recipients, recent_recipients)) / len(recipients)::DOUBLE) * 0.4e0, 1e0) END AS score FROM g_both""",
}


def history(spark, sf):
    return view(spark, sf, "v_history")


@register("graph_edges", "SELECT sender, recipient, strftime(sent_at, '%Y-%m-%d %H:%M:%S') AS sent_at, 1::BIGINT AS weight FROM g_edges", CTES)
def graph_edges(spark, sf):
    return plain(behaviour.edges(history(spark, sf)))


@register("set_graph_nodes", "SELECT sender AS node FROM g_edges UNION SELECT recipient AS node FROM g_edges", CTES)
def set_graph_nodes(spark, sf):
    return behaviour.nodes(history(spark, sf))


@register("graph_high_volume", "SELECT 'high_volume_sender' AS type, sender, email_count, 'medium' AS severity FROM g_high", CTES)
def graph_high_volume(spark, sf):
    return plain(behaviour.high_volume_senders(history(spark, sf)))


@register("graph_stats", """
    SELECT (SELECT count(*) FROM (SELECT sender FROM g_edges UNION SELECT recipient FROM g_edges) n) AS total_nodes,
           (SELECT count(*) FROM g_edges) AS total_edges, (SELECT count(*) FROM g_high) AS anomalies_detected,
           round((SELECT count(*) FROM g_high) * 0.2e0, 8) AS threat_score""", CTES)
def graph_stats(spark, sf):
    return plain(behaviour.graph_stats(history(spark, sf)))


@register("win_top_recipients", "SELECT sender, recipient, n AS count, rank FROM g_top", CTES)
def win_top_recipients(spark, sf):
    return plain(behaviour.top_recipients(history(spark, sf)))


@register("win_first_subjects", "SELECT sender, subject, rank FROM g_subjects", CTES)
def win_first_subjects(spark, sf):
    return plain(behaviour.first_subjects(history(spark, sf)))


@register("behaviour_baseline", """
    SELECT b.sender, mails, round(avg_length, 8) AS avg_length, array_to_string(recipients, '|') AS recipients, s.subjects
    FROM g_base b LEFT JOIN (SELECT sender, string_agg(subject, '|' ORDER BY subject) AS subjects FROM g_subjects GROUP BY sender) s USING (sender)
    WHERE mails >= 10""", CTES)
def behaviour_baseline(spark, sf):
    return plain(behaviour.baseline(history(spark, sf)))


@register("behaviour_current", """
    SELECT sender, mails, round(avg_length, 8) AS avg_length, array_to_string(recipients, '|') AS recipients FROM g_now""", CTES)
def behaviour_current(spark, sf):
    return plain(behaviour.current(history(spark, sf), HISTORY_AS_OF))


@register("behaviour_anomaly", """
    SELECT sender, mails >= 10 AS baseline_established, round(score, 8) AS behavioral_anomaly_score,
           CASE WHEN score > 0.7e0 THEN 'HIGH' WHEN score > 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS compromise_likelihood FROM g_score""", CTES)
def behaviour_anomaly(spark, sf):
    return plain(behaviour.anomaly(history(spark, sf), HISTORY_AS_OF))


@register("behaviour_flags", """
    SELECT sender, flag FROM (SELECT sender, unnest([CASE WHEN recent_length > avg_length * 2 THEN 'Unusually long emails' END,
        CASE WHEN recent_length < avg_length * 0.5e0 THEN 'Unusually short emails' END,
        CASE WHEN len(list_filter(recent_recipients, lambda r: NOT list_contains(recipients, r))) > len(recipients) * 0.5e0 THEN 'Many new recipients' END]) AS flag
        FROM g_both WHERE mails >= 10) x WHERE flag IS NOT NULL""", CTES)
def behaviour_flags(spark, sf):
    return behaviour.anomaly_flags(history(spark, sf), HISTORY_AS_OF)


@register("behaviour_send_hours", """
    SELECT sender_email AS sender, hour, mails, round(mails / sum(mails) OVER (PARTITION BY sender_email)::DOUBLE, 8) AS share
    FROM (SELECT sender_email, hour(created_at) AS hour, count(*) AS mails FROM v_analyses GROUP BY 1, 2) x""")
def behaviour_send_hours(spark, sf):
    sent = view(spark, sf, "v_analyses").select(F.col("sender_email").alias("sender"), F.col("created_at").alias("sent_at"))
    return plain(behaviour.send_hours(sent))
