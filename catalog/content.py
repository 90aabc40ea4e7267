"""Text jobs."""

from pyspark.sql import functions as F

from catalog.registry import plain, register
from datasets.views import view
from mailquarry import lexicon as lx
from mailquarry.operators import content
from oracles import content as oc
from oracles.sql import hits, q


def _rounded(columns):
    return ", ".join(f"round({c}, 8) AS {c}" if c in ("avg_word_length", "all_caps_ratio") else f"{c}::BIGINT AS {c}"
                     for c in columns)


@register("split_body", "SELECT message_id, md5(body_text) AS text_md5, md5(body_html) AS html_md5 FROM c_split", oc.FEATURES)
def split_body(spark, sf):
    return content.split_body(view(spark, sf, "v_emails")).select(
        "message_id", F.md5("body_text").alias("text_md5"), F.md5("body_html").alias("html_md5"))


@register("content_features", f"SELECT message_id, {_rounded(oc.FEATURE_COLUMNS)} FROM c_features", oc.FEATURES)
def content_features(spark, sf):
    return plain(content.content_features(view(spark, sf, "v_emails")))


@register("content_manipulation", "SELECT message_id, k AS detected_language, " + ", ".join(
    f"round({c}, 8) AS {c}, {c}_terms" for c in lx.MANIPULATION_CATEGORIES)
    + ", round(manipulation_score, 8) AS manipulation_score FROM m_mean", oc.MANIPULATION)
def content_manipulation(spark, sf):
    return plain(content.manipulation(view(spark, sf, "v_emails")))


_SHORT = [t for g in lx.MANIPULATION_SHORT.values() for t in g]


@register("content_manipulation_short", f"""
    SELECT message_id, least({hits('lower(content)', _SHORT)} * 0.25e0, 1e0) AS manipulation_score FROM v_emails""")
def content_manipulation_short(spark, sf):
    return plain(content.manipulation_short(view(spark, sf, "v_emails")))


@register("extract_money_phone", f"""
    SELECT message_id, kind, pos - 1 AS pos, vals[pos] AS value FROM (
        SELECT message_id, kind, vals, unnest(range(1, len(vals) + 1)) AS pos FROM (
            SELECT message_id, 'money' AS kind, regexp_extract_all(content, {q(lx.MONEY_PATTERN)}) AS vals FROM v_emails
            UNION ALL
            SELECT message_id, 'phone' AS kind, regexp_extract_all(content, {q(lx.PHONE_PATTERN)}) AS vals FROM v_emails) a) b""")
def extract_money_phone(spark, sf):
    return plain(content.money_and_phones(view(spark, sf, "v_emails")))


@register("content_scam_level", """
    SELECT message_id, scam_terms::BIGINT AS scam_terms, money_count, phone_count,
           round(manipulation_score, 8) AS manipulation_score, round(scam_score, 8) AS scam_score,
           CASE WHEN manipulation_score + scam_score > 0.8e0 THEN 'CRITICAL' WHEN manipulation_score + scam_score > 0.6e0 THEN 'HIGH'
                WHEN manipulation_score + scam_score > 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level
    FROM m_level""", oc.MANIPULATION)
def content_scam_level(spark, sf):
    return plain(content.scam_level(view(spark, sf, "v_emails")))


@register("content_style_by_group", """
    SELECT sender, lang, count(*) AS mails, round(avg(readability), 8) AS avg_readability, round(avg(polarity), 8) AS avg_polarity,
           round(avg(avg_sentence_length), 8) AS avg_sentence_length, sum(lower_starts)::BIGINT AS lower_starts
    FROM t_style GROUP BY sender, lang""", oc.STYLE)
def content_style_by_group(spark, sf):
    return plain(content.style_by_group(view(spark, sf, "v_emails"), "sender", "lang"))


@register("join_lexicon", " UNION ALL ".join(
    f"SELECT message_id, {q(name)} AS category, {hits('lower(content)', terms)}::BIGINT AS hits, {len(terms)}::BIGINT AS size, "
    f"array_to_string(list_filter({oc.items(terms)}, lambda x: contains(lower(content), x)), '|') AS terms FROM v_emails"
    for name, terms in lx.FEATURE_LEXICONS.items()))
def join_lexicon(spark, sf):
    return plain(content.lexicon_hits(view(spark, sf, "v_emails"), lx.lexicon_table(spark), "feature"))


@register("rule_scan_text", f"""
    SELECT e.message_id, coalesce(max(r.score), 0e0) AS rule_score, coalesce(string_agg(rule_name, '|' ORDER BY rule_pos), '') AS rules
    FROM v_emails e LEFT JOIN ({oc.rule_rows('v_emails', 'message_id', 'content')}) r USING (message_id) GROUP BY e.message_id""")
def rule_scan_text(spark, sf):
    scanned = content.scan_text(view(spark, sf, "v_emails"))
    return plain(scanned.select("message_id", "rule_score", F.col("matches.rule_name").alias("rules")))


@register("join_rules", f"""
    SELECT message_id, rule_name, category, severity, score
    FROM ({oc.rule_rows('v_emails', 'message_id', 'content')}) r""")
def join_rules(spark, sf):
    return plain(content.scan_rule_table(view(spark, sf, "v_emails"), lx.rule_table(spark)))


_RULE_VALUES = ", ".join(f"({q(r.name)}, {q(r.category)}, {q(r.severity)})" for r in lx.RULES)


@register("rule_stats", f"""
    SELECT v.category, v.severity, count(*) AS rules, sum(coalesce(h.hits, 0))::BIGINT AS hits
    FROM (VALUES {_RULE_VALUES}) v(rule_name, category, severity)
    LEFT JOIN (SELECT rule_name, count(*) AS hits FROM ({oc.rule_rows('v_emails', 'message_id', 'content')}) r GROUP BY rule_name) h USING (rule_name)
    GROUP BY v.category, v.severity""")
def rule_stats(spark, sf):
    hits_ = content.rule_hits(content.scan_text(view(spark, sf, "v_emails")))
    return plain(content.rule_statistics(hits_, lx.rule_table(spark)))


_LEX_VALUES = ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {q(t)})" for a, b, c, _, t in lx.lexicon_rows())


@register("src_lexicons", f"""
    SELECT v.lexicon, v.lang, v.category, v.term, coalesce(m.mails, 0) AS mails
    FROM (VALUES {_LEX_VALUES}) v(lexicon, lang, category, term)
    LEFT JOIN (SELECT term, count(*) AS mails FROM v_emails,
                      (SELECT DISTINCT term FROM (VALUES {_LEX_VALUES}) x(lexicon, lang, category, term)) t
               WHERE contains(lower(subject || ' ' || content), term) GROUP BY term) m USING (term)""")
def src_lexicons(spark, sf):
    return plain(content.term_frequencies(view(spark, sf, "v_emails"), lx.lexicon_table(spark)))


@register("visual_threats", "SELECT * FROM o_visual", oc.VISUAL)
def visual_threats(spark, sf):
    return plain(content.visual_threats(view(spark, sf, "v_ocr")))


@register("qr_destinations", """
    SELECT message_id, count(*) AS qr_codes, max(CASE WHEN starts_with(payload, 'http://') OR starts_with(payload, 'https://')
             THEN CASE WHEN payload IN (SELECT url FROM o_visual WHERE visual_level = 'HIGH') THEN 0.6e0 ELSE 0.3e0 END ELSE 0.1e0 END) AS max_threat_score
    FROM v_qr GROUP BY message_id""", oc.VISUAL)
def qr_destinations(spark, sf):
    return plain(content.qr_destinations(view(spark, sf, "v_qr"), content.visual_threats(view(spark, sf, "v_ocr"))))
