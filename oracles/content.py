"""Oracle texts for the content jobs."""

from mailquarry import lexicon as lx
from oracles.sql import SPACE, any_of, hits, items, q

SPLIT = """
    SELECT *, CASE WHEN content_type = 'text' THEN content ELSE '' END AS body_text,
           CASE WHEN content_type = 'html' THEN content ELSE '' END AS body_html FROM v_emails"""
_W = r"\p{L}\p{N}_"
_triples = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
FEATURES = {
    "c_split": SPLIT,
    "c_text": "SELECT *, subject || ' ' || body_text || ' ' || body_html AS raw FROM c_split",
    "c_lower": f"""
        SELECT *, lower(raw) AS t, regexp_extract_all(lower(raw), '[^{SPACE}]+') AS words,
               list_filter(string_split_regex(lower(raw), '[^{_W}]+'),
                           lambda w: length(w) > 2 AND regexp_matches(w, '^[a-z]+$')) AS plain
        FROM c_text""",
    "c_features": f"""
        SELECT message_id, length(t) AS text_length, len(words) AS word_count,
               len(regexp_extract_all(t, '[.!?]+')) + 1 AS sentence_count,
               CASE WHEN len(words) = 0 THEN 0e0 ELSE list_sum(list_transform(words, lambda w: length(w))) / len(words)::DOUBLE END AS avg_word_length,
               {hits('t', lx.URGENT)} AS urgent_words_count, {hits('t', lx.SUSPICIOUS)} AS suspicious_words_count,
               {hits('t', lx.FINANCIAL)} AS financial_words_count, {hits('t', lx.BRAND)} AS brand_words_count,
               len(list_filter(plain, lambda w: regexp_matches(w, '{_triples}')))
                 + len(list_filter(plain, lambda w: regexp_matches(w, '[qwxz][qwxz]'))) AS spelling_errors,
               regexp_matches(t, '(^|[^{_W}])(your|you''re)[{SPACE}]+(welcome|wellcome)([^{_W}]|$)')::INT
                 + regexp_matches(t, '(^|[^{_W}])(there|their|they''re)[{SPACE}]+(are|is)([^{_W}]|$)')::INT AS grammar_errors,
               len(regexp_extract_all(body_html, '<[^>]+>')) AS html_tag_count,
               (contains(body_html, 'display:none') OR contains(body_html, 'visibility:hidden'))::INT AS hidden_text,
               (contains(body_html, 'font-size:0') OR contains(body_html, 'color:white'))::INT AS suspicious_css,
               len(regexp_extract_all(raw, '[A-Z]{{3,}}')) / greatest(len(words), 1)::DOUBLE AS all_caps_ratio,
               len(regexp_extract_all(t, '!')) AS exclamation_count, len(regexp_extract_all(t, '[?]')) AS question_count,
               {hits('t', lx.POSITIVE)} AS positive_words, {hits('t', lx.NEGATIVE)} AS negative_words
        FROM c_lower""",
}
FEATURE_COLUMNS = [
    "text_length", "word_count", "sentence_count", "avg_word_length", "urgent_words_count",
    "suspicious_words_count", "financial_words_count", "brand_words_count", "spelling_errors",
    "grammar_errors", "html_tag_count", "hidden_text", "suspicious_css", "all_caps_ratio",
    "exclamation_count", "question_count", "positive_words", "negative_words",
]

_langs = {code: c for code, c in lx.MANIPULATION.items()}


def _pick(value) -> str:
    return f"CASE k WHEN 'es' THEN {value('es')} WHEN 'fr' THEN {value('fr')} ELSE {value('en')} END"


def _matched(terms) -> str:
    return f"array_to_string(list_filter({items(terms)}, lambda x: contains(t, x)), '|')"


MANIPULATION = {
    "m_lang": f"""
        SELECT *, CASE WHEN lang IN ({', '.join(q(c) for c in lx.SUPPORTED_LANGUAGES)}) THEN lang ELSE 'en' END AS k,
               lower(content) AS t FROM v_emails""",
    "m_scores": "SELECT *, " + ", ".join(
        _pick(lambda c, cat=cat: f"{hits('t', _langs[c][cat])} / {len(_langs[c][cat])}::DOUBLE") + f" AS {cat}"
        for cat in lx.MANIPULATION_CATEGORIES) + ", " + ", ".join(
        _pick(lambda c, cat=cat: _matched(_langs[c][cat])) + f" AS {cat}_terms"
        for cat in lx.MANIPULATION_CATEGORIES) + " FROM m_lang",
    "m_mean": f"SELECT *, ({' + '.join(lx.MANIPULATION_CATEGORIES)}) / 5e0 AS manipulation_score FROM m_scores",
    "m_scam": f"""
        SELECT *, {_pick(lambda c: hits('t', lx.SCAM_TERMS[c]))} AS scam_terms,
               len(regexp_extract_all(content, {q(lx.MONEY_PATTERN)})) AS money_count,
               len(regexp_extract_all(content, {q(lx.PHONE_PATTERN)})) AS phone_count FROM m_mean""",
    "m_level": "SELECT *, scam_terms * 0.3e0 + money_count * 0.2e0 AS scam_score FROM m_scam",
}

STYLE = {
    "t_words": f"SELECT *, regexp_extract_all(content, '[^{SPACE}]+') AS w, lower(content) AS t FROM v_emails",
    "t_counts": f"""
        SELECT message_id, sender, lang, len(w) AS words, len(regexp_extract_all(content, '[.!?]+')) + 1 AS sentences,
               list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+'))
                   - CASE WHEN ends_with(lower(x), 'e') AND len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS syllables,
               {hits('t', lx.SENTIMENT_POSITIVE)} AS p, {hits('t', lx.SENTIMENT_NEGATIVE)} AS n,
               len(regexp_extract_all(content, '(?:^|[.!?]+)[{SPACE}]*\\p{{Ll}}')) AS lower_starts
        FROM t_words""",
    "t_style": """
        SELECT *, CASE WHEN words = 0 THEN 0e0 ELSE greatest(0e0, least(100e0,
                   206.835e0 - 1.015e0 * (words / sentences::DOUBLE) - 84.6e0 * (syllables / words::DOUBLE))) END AS readability,
               CASE WHEN p + n = 0 THEN 0e0 ELSE (p - n) / (p + n)::DOUBLE END AS polarity,
               words / sentences::DOUBLE AS avg_sentence_length
        FROM t_counts""",
}


def rule_condition(rule, text: str, lowered: str) -> str:
    if rule.pattern is not None:
        return f"len(regexp_extract_all({text}, {q(rule.pattern)})) > {rule.more_than}"
    return "(" + " AND ".join(any_of(lowered, g) for g in rule.groups) + ")"


def rule_rows(source: str, key: str, text: str, rules=None) -> str:
    """(key, rule_name, category, severity, score) rows of matching rules."""
    return "\nUNION ALL ".join(
        f"SELECT {key}, {q(r.name)} AS rule_name, {q(r.category)} AS category, {q(r.severity)} AS severity, "
        f"{r.score!r}::DOUBLE AS score, {i} AS rule_pos FROM {source} WHERE {rule_condition(r, text, f'lower({text})')}"
        for i, r in enumerate(lx.RULES if rules is None else rules))


VISUAL = {
    "o_brands": f"SELECT *, list_filter({items(lx.VISUAL_BRANDS)}, lambda b: contains(lower(ocr_text), b)) AS brands FROM v_ocr",
    "o_raw": "SELECT *, len(brands) * 0.3e0 + least(shapes * 0.1e0, 1e0) * 0.7e0 AS raw, (brand_score + template_score) / 2e0 AS vis FROM o_brands",
    "o_visual": """
        SELECT page_id, url, array_to_string(brands, '|') AS brands, round(least(raw, 1e0), 8) AS impersonation_score,
               CASE WHEN raw > 0.7e0 THEN 'HIGH' WHEN raw > 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS impersonation_level,
               CASE WHEN vis > 0.7e0 THEN 'HIGH' WHEN vis > 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS visual_level
        FROM o_raw""",
}
