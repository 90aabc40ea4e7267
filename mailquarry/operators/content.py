"""Text of mails: features, manipulation and scam terms, style, rules, extracted images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions import rules as rl
from mailquarry.functions.syllables import words_and_syllables
from mailquarry.functions.text import (
    SENTENCE_END, SPACE, WORD_CHARS, add, cap, clamp, has_any, matched_terms, occurrences, plain_spaces, sentence_count,
    single_spaced, term_hits, word_count, word_letters,
)
from mailquarry.operators.terms import body_key, rules_in, terms_in
from mailquarry.plans.skew import small
from mailquarry.sinks.facts import staged

_START = f"(?<![{WORD_CHARS}])"
_END = f"(?![{WORD_CHARS}])"
TRIPLED_LETTER = _START + r"[a-z]*([a-z])\1\1[a-z]*" + _END
ODD_PAIR = _START + "(?=[a-z]{3})[a-z]*[qwxz]{2}[a-z]*" + _END
GRAMMAR = [
    _START + f"(your|you're)[{SPACE}]+(welcome|wellcome)" + _END,
    _START + f"(there|their|they're)[{SPACE}]+(are|is)" + _END,
]


def split_body(emails: DataFrame) -> DataFrame:
    """Adds body_text and body_html; the one that does not apply is ''."""
    content = F.coalesce("content", F.lit(""))
    return emails.withColumn(
        "body_text", F.when(F.col("content_type") == "text", content).otherwise(F.lit(""))
    ).withColumn("body_html", F.when(F.col("content_type") == "html", content).otherwise(F.lit("")))


def with_lowered(emails: DataFrame) -> DataFrame:
    """Adds _text and _lower as columns, so that a body is lower-cased once, not once per term."""
    texts = emails.withColumn("_text", F.coalesce("content", F.lit("")))
    return texts.withColumn("_lower", F.lower("_text"))


def _full_text() -> Column:
    return F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.col("body_text"), F.lit(" "), F.col("body_html"))


def spelling_errors(lowered: Column) -> Column:
    # the plain core of each pattern is a cheap first test
    tripled = F.when(lowered.rlike(r"([a-z])\1\1"), F.regexp_count(lowered, F.lit(TRIPLED_LETTER))).otherwise(0)
    odd = F.when(lowered.rlike("[qwxz]{2}"), F.regexp_count(lowered, F.lit(ODD_PAIR))).otherwise(0)
    return tripled + odd


def grammar_errors(lowered: Column) -> Column:
    return ((has_any(lowered, ["welcome", "wellcome"]) & lowered.rlike(GRAMMAR[0])).cast("int")
            + (has_any(lowered, ["there", "their", "they're"]) & lowered.rlike(GRAMMAR[1])).cast("int"))


def content_features(emails: DataFrame) -> DataFrame:
    """The text features of each mail; row-wise, so bodies never pass a shuffle."""
    return with_content_features(emails, ["message_id"])


def with_content_features(emails: DataFrame, keep: list) -> DataFrame:
    """The columns in ``keep`` and the text features."""
    mails = split_body(emails).withColumn("_raw", _full_text()).withColumn("_text", F.lower("_raw")).withColumn(
        "_plain", plain_spaces(F.col("_text")))
    mails = mails.withColumn("_spaced", single_spaced(F.col("_text"), F.col("_plain"))).withColumn(
        "_letters", word_letters(F.col("_spaced"))).withColumn("_words", word_count(F.col("_spaced"), F.col("_letters")))
    text, html, words = F.col("_text"), F.col("body_html"), F.col("_words")
    is_html = html != ""
    return mails.select(
        *keep,
        F.length(text).alias("text_length"),
        words.alias("word_count"),
        sentence_count(text).alias("sentence_count"),
        F.coalesce(F.try_divide(F.col("_letters"), words), F.lit(0.0)).alias("avg_word_length"),
        term_hits(text, lx.URGENT).alias("urgent_words_count"),
        term_hits(text, lx.SUSPICIOUS).alias("suspicious_words_count"),
        term_hits(text, lx.FINANCIAL).alias("financial_words_count"),
        term_hits(text, lx.BRAND).alias("brand_words_count"),
        spelling_errors(text).alias("spelling_errors"),
        grammar_errors(text).alias("grammar_errors"),
        F.when(is_html, F.regexp_count(html, F.lit("<[^>]+>"))).otherwise(0).alias("html_tag_count"),
        (is_html & has_any(html, ["display:none", "visibility:hidden"])).cast("int").alias("hidden_text"),
        (is_html & has_any(html, ["font-size:0", "color:white"])).cast("int").alias("suspicious_css"),
        (F.regexp_count("_raw", F.lit("[A-Z]{3,}")) / F.greatest(words, F.lit(1))).alias("all_caps_ratio"),
        occurrences(text, "!").alias("exclamation_count"),
        occurrences(text, "?").alias("question_count"),
        term_hits(text, lx.POSITIVE).alias("positive_words"),
        term_hits(text, lx.NEGATIVE).alias("negative_words"),
    )


def known_language(lang: Column) -> Column:
    """Languages outside the supported list count as the default one."""
    return F.when(lang.isin(lx.SUPPORTED_LANGUAGES), lang).otherwise(F.lit(lx.DEFAULT_LANGUAGE))


def _by_language(lang: Column, per_language: dict[str, Column]) -> Column:
    result = per_language[lx.DEFAULT_LANGUAGE]
    for code, value in per_language.items():
        if code != lx.DEFAULT_LANGUAGE:
            result = F.when(lang == code, value).otherwise(result)
    return result


def manipulation(emails: DataFrame) -> DataFrame:
    """Per mail: share of matched terms per tactic, the matched terms, and the mean."""
    lang = known_language(F.col("lang"))
    text = F.col("_lower")
    scores, terms = [], []
    for category in lx.MANIPULATION_CATEGORIES:
        lists = {code: categories[category] for code, categories in lx.MANIPULATION.items()}
        terms.append(_by_language(lang, {
            code: matched_terms(text, t) for code, t in lists.items()}).alias(f"{category}_terms"))
        size = _by_language(F.col("detected_language"), {code: F.lit(len(t)) for code, t in lists.items()})
        scores.append((F.size(f"{category}_terms") / size).alias(category))
    # the terms are read twice, so they stay a projection of their own and a text is searched once
    scored = with_lowered(emails).select("message_id", lang.alias("detected_language"), *terms).select(
        "message_id", "detected_language", *scores, *[f"{c}_terms" for c in lx.MANIPULATION_CATEGORIES])
    return scored.withColumn(
        "manipulation_score", add([F.col(c) for c in lx.MANIPULATION_CATEGORIES]) / len(lx.MANIPULATION_CATEGORIES))


def manipulation_score(text: Column, lang: Column) -> Column:
    """Mean share over the tactics, as one expression."""
    parts = [
        _by_language(lang, {code: term_hits(text, categories[category]) / len(categories[category])
                            for code, categories in lx.MANIPULATION.items()})
        for category in lx.MANIPULATION_CATEGORIES]
    return add(parts) / len(parts)


def manipulation_short(emails: DataFrame) -> DataFrame:
    """A quarter per matched term of the short list, at most 1."""
    terms = [t for group in lx.MANIPULATION_SHORT.values() for t in group]
    return with_lowered(emails).select(
        "message_id", cap(term_hits(F.col("_lower"), terms) * F.lit(0.25)).alias("manipulation_score"))


def money_amounts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(lx.MONEY_PATTERN), F.lit(0))


def phone_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(lx.PHONE_PATTERN), F.lit(0))


def money_and_phones(emails: DataFrame) -> DataFrame:
    """One row per mail, kind and position: money amounts and phone numbers in the body."""
    content = F.coalesce("content", F.lit(""))
    found = F.concat(
        F.transform(money_amounts(content), lambda v, i: F.struct(F.lit("money").alias("kind"), i.alias("pos"), v.alias("value"))),
        F.transform(phone_numbers(content), lambda v, i: F.struct(F.lit("phone").alias("kind"), i.alias("pos"), v.alias("value"))))
    return emails.select("message_id", F.inline_outer(found)).filter("kind is not null")


def scam_level(emails: DataFrame) -> DataFrame:
    """Scam terms, money and phones per mail, with the level of manipulation plus scam score."""
    lang = known_language(F.col("lang"))
    text, lowered = F.col("_text"), F.col("_lower")
    terms = _by_language(lang, {code: term_hits(lowered, t) for code, t in lx.SCAM_TERMS.items()})
    found = with_lowered(emails).select(
        "message_id", terms.alias("scam_terms"),
        F.size(money_amounts(text)).alias("money_count"), F.size(phone_numbers(text)).alias("phone_count"),
        manipulation_score(lowered, lang).alias("manipulation_score"))
    scored = found.withColumn("scam_score", F.col("scam_terms") * 0.3 + F.col("money_count") * 0.2)
    total = F.col("manipulation_score") + F.col("scam_score")
    return scored.withColumn(
        "threat_level", F.when(total > 0.8, "CRITICAL").when(total > 0.6, "HIGH")
        .when(total > 0.4, "MEDIUM").otherwise("LOW"))


def style(emails: DataFrame) -> DataFrame:
    """Readability, polarity and sentence figures per mail."""
    raw, text, counts = F.col("_text"), F.col("_lower"), F.col("_counts")
    positive, negative = term_hits(text, lx.SENTIMENT_POSITIVE), term_hits(text, lx.SENTIMENT_NEGATIVE)
    counted = with_lowered(emails).select(
        "message_id", "sender", "lang", words_and_syllables(text).alias("_counts"), sentence_count(raw).alias("sentences"),
        positive.alias("positive"), negative.alias("negative"),
        F.regexp_count(raw, F.lit(f"(?:^|{SENTENCE_END})[{SPACE}]*\\p{{Ll}}")).alias("lower_starts"),
    ).withColumns({"words": counts.words, "syllables": counts.syllables})
    score = (F.lit(206.835) - F.lit(1.015) * (F.col("words") / F.col("sentences"))
             - F.lit(84.6) * (F.col("syllables") / F.col("words")))
    return counted.select(
        "message_id", "sender", "lang", "words", "sentences", "lower_starts",
        F.when(F.col("words") > 0, clamp(score, 0.0, 100.0)).otherwise(F.lit(0.0)).alias("readability"),
        F.coalesce(F.try_divide(F.col("positive") - F.col("negative"), F.col("positive") + F.col("negative")),
                   F.lit(0.0)).alias("polarity"),
        (F.col("words") / F.col("sentences")).alias("avg_sentence_length"))


def style_by_group(emails: DataFrame, *group: str) -> DataFrame:
    """Mean style figures per group."""
    return style(emails).groupBy(*group).agg(
        F.count(F.lit(1)).alias("mails"), F.avg("readability").alias("avg_readability"),
        F.avg("polarity").alias("avg_polarity"), F.avg("avg_sentence_length").alias("avg_sentence_length"),
        F.sum("lower_starts").alias("lower_starts"))


#: Up to this many terms or rules become expressions or one broadcast row; larger tables are indexed by their rarest grams.
MOST_INLINE = 1000
#: Pattern rules that meet a text at once.
PATTERN_BLOCK = 500


def lexicon_hits(texts: DataFrame, lexicon: DataFrame, name: str, most_inline: int = MOST_INLINE) -> DataFrame:
    """Terms of a lexicon table found in each text: (message_id, category, hits, size, terms).

    A language without its own terms uses the default language; 'any' terms apply to all. Up to ``most_inline`` terms become
    one broadcast row per language, so each text is read once; a larger lexicon is searched through :mod:`terms`.
    """
    chosen = lexicon.filter(F.col("lexicon") == name)
    if chosen.limit(most_inline + 1).count() > most_inline:
        return _indexed_lexicon_hits(texts, chosen)
    languages = [r.lang for r in chosen.select("lang").distinct().collect()]  # at most most_inline
    per_category = chosen.groupBy("lang", "category").agg(
        F.array_sort(F.collect_list(F.struct("position", "term"))).alias("t"))
    per_language = per_category.groupBy("lang").agg(
        F.collect_list(F.struct("category", F.col("t.term").alias("terms"))).alias("categories")
    ).withColumnRenamed("lang", "_lang")
    fallback = "any" if "any" in languages else lx.DEFAULT_LANGUAGE
    keyed = texts.withColumn(
        "_lang", F.when(F.col("lang").isin(languages), F.col("lang")).otherwise(F.lit(fallback)))
    lowered = F.lower(F.coalesce("content", F.lit("")))
    found = F.transform("categories", lambda c: F.struct(
        c["category"].alias("category"), F.size(c["terms"]).alias("size"),
        F.filter(c["terms"], lambda t: F.contains(F.col("_text"), t)).alias("terms")))
    return (
        keyed.withColumn("_text", lowered).join(F.broadcast(per_language), "_lang")
        .select("message_id", F.inline_outer(found)).filter("category is not null")
        .select("message_id", "category", F.size("terms").alias("hits"), "size", "terms")
    )


def _indexed_lexicon_hits(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The same rows for a lexicon of any size: only (text, term) pairs that hold are joined with its rows."""
    fallback = "any" if lexicon.filter("lang = 'any'").limit(1).count() else lx.DEFAULT_LANGUAGE
    known = lexicon.select(F.col("lang").alias("_known")).filter("_known IS NOT NULL").distinct()
    bodies = texts.select("message_id", "lang", F.lower(F.coalesce("content", F.lit(""))).alias("text")).withColumn("body", body_key(F.col("text")))
    keyed = bodies.drop("text").join(small(known), F.col("lang") == F.col("_known"), "left").select(
        "message_id", "body", F.coalesce("_known", F.lit(fallback)).alias("lang"))
    entries = lexicon.select("lang", "category", "position", "term")
    # of one text and language: at most the terms it holds
    held = terms_in(bodies, entries).join(entries, "term").groupBy("body", "lang", "category").agg(
        F.array_sort(F.collect_list(F.struct("position", "term"))).alias("held"))
    sizes = entries.groupBy("lang", "category").agg(F.count("*").cast("int").alias("size"))
    rows = keyed.join(small(sizes.filter("category IS NOT NULL")), "lang").join(held, ["body", "lang", "category"], "left")
    found = F.coalesce(F.col("held.term"), F.array().cast("array<string>"))
    return rows.select("message_id", "category", F.size(found).alias("hits"), "size", found.alias("terms"))


def scan_text(emails: DataFrame, rules: list[lx.Rule] | None = None) -> DataFrame:
    """Rule score and matched rules per mail."""
    found = rl.with_matches(with_lowered(emails).select("message_id", "_text", "_lower"), "_text", "_lower", rules)
    # a generator of one row: a filter on the score stays above it, where below it would search the text anew for every string
    return found.select("message_id", F.inline_outer(F.array(F.struct("matches", "rule_score"))))


def scan_rule_table(emails: DataFrame, rules: DataFrame, most_inline: int = MOST_INLINE) -> DataFrame:
    """One row per (mail, matched rule) for a rule table of any size: (message_id, rule_name, category, severity, score).

    Up to ``most_inline`` rules become expressions. Of more, the strings are searched through :mod:`terms` and a rule matches where each
    of its groups has a string in the text; pattern rules can't be indexed and meet every text in blocks. A repeated rule matches as often as it
    stands in the table, a repeated mail as often as it occurs.
    """
    if rules.limit(most_inline + 1).count() <= most_inline:
        return rule_hits(scan_text(emails, lx.rules_from(rules, most_inline)))
    named = rules.select("rule_name", "category", "severity", "groups", "pattern", F.coalesce("more_than", F.lit(0)).alias("more_than"))
    named = staged(named.groupBy(*named.columns).agg(F.count(F.lit(1)).cast("int").alias("copies")).withColumn(
        "rule", F.sha2(F.to_json(F.struct("rule_name", "category", "severity", "groups", "pattern", "more_than")), 256)), "rules")
    bodies = emails.select("message_id", F.coalesce("content", F.lit("")).alias("_text")).withColumn("text", F.lower("_text")).withColumn(
        "body", body_key(F.col("_text")))
    strings = named.filter("pattern IS NULL").select("rule", F.size("groups").alias("n"), F.posexplode("groups").alias("at", "strings")).select(
        "rule", "n", "at", F.explode("strings").alias("term")).withColumn("term", F.lower("term")).distinct()
    by_string = rules_in(bodies, strings)
    patterns = named.filter("pattern IS NOT NULL")
    n_blocks = -(-patterns.count() // PATTERN_BLOCK) or 1
    blocks = patterns.groupBy(F.pmod(F.xxhash64("rule"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list(F.struct("rule", "pattern", "more_than")).alias("patterns")).drop("block")
    by_pattern = bodies.crossJoin(small(blocks)).select("body", F.explode(F.filter(
        "patterns", lambda p: F.size(F.regexp_extract_all(F.col("_text"), p["pattern"], F.lit(0))) > p["more_than"])).alias("p")).select("body", "p.rule")
    score = F.coalesce(F.create_map(*[F.lit(x) for pair in lx.SEVERITY_SCORES.items() for x in pair])[F.col("severity")], F.lit(0.5))
    matched = by_string.unionByName(by_pattern).distinct().join(named, "rule")
    matched = matched.select("body", "rule_name", "category", "severity", score.cast("double").alias("score"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy"))
    return bodies.select("message_id", "body").join(matched, "body").drop("body", "_copy")


def rule_hits(scanned: DataFrame, key: str = "message_id") -> DataFrame:
    """One row per (mail, matched rule)."""
    return scanned.select(key, F.inline_outer("matches")).filter("rule_name is not null")


def rule_statistics(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules and hits per category and severity."""
    per_rule = hits.groupBy("rule_name").agg(F.count(F.lit(1)).alias("hits"))
    return (
        rules.select("rule_name", "category", "severity").join(per_rule, "rule_name", "left")
        .groupBy("category", "severity")
        .agg(F.count(F.lit(1)).alias("rules"), F.sum(F.coalesce("hits", F.lit(0))).alias("hits"))
    )


def term_frequencies(emails: DataFrame, lexicon: DataFrame, most_inline: int = MOST_INLINE) -> DataFrame:
    """Every lexicon term with the number of mails that contain it. Up to ``most_inline`` distinct terms are tests of their own, more are
    searched through :mod:`terms`."""
    distinct = [r.term for r in lexicon.select("term").filter("term IS NOT NULL").distinct().orderBy("term").limit(most_inline + 1).collect()]
    texts = emails.select(F.lower(F.concat_ws(" ", "subject", "content")).alias("text"))
    if len(distinct) > most_inline:
        texts = texts.withColumn("body", body_key(F.col("text")))
        mails = texts.groupBy("body").agg(F.count(F.lit(1)).alias("mails"))
        counts = terms_in(texts, lexicon).join(mails, "body").groupBy("term").agg(F.sum("mails").alias("mails"))
    else:
        found = texts.select(F.explode_outer(matched_terms(F.col("text"), distinct)).alias("term")).filter("term is not null")
        counts = F.broadcast(found.groupBy("term").agg(F.count(F.lit(1)).alias("mails")))
    return lexicon.join(counts, "term", "left").select(
        "lexicon", "lang", "category", "term", F.coalesce("mails", F.lit(0)).alias("mails"))


def visual_threats(images: DataFrame) -> DataFrame:
    """Brand impersonation from recognised text and shape counts, and the visual level of a page."""
    read = images.withColumn("_lower", F.lower("ocr_text"))
    found = read.withColumn("brands", matched_terms(F.col("_lower"), lx.VISUAL_BRANDS))
    raw = F.size("brands") * F.lit(0.3) + cap(F.col("shapes") * F.lit(0.1)) * F.lit(0.7)
    visual = (F.col("brand_score") + F.col("template_score")) / 2

    def level(score: Column) -> Column:
        return F.when(score > 0.7, "HIGH").when(score > 0.4, "MEDIUM").otherwise("LOW")

    return found.select(
        "page_id", "url", "brands", cap(raw).alias("impersonation_score"),
        level(raw).alias("impersonation_level"), level(visual).alias("visual_level"))


def qr_destinations(payloads: DataFrame, visual: DataFrame) -> DataFrame:
    """Decoded codes per mail: count and highest threat score."""
    high = visual.filter(F.col("visual_level") == "HIGH").select(F.col("url").alias("payload")).distinct()
    judged = payloads.join(high.withColumn("_high", F.lit(True)), "payload", "left")
    is_url = F.col("payload").startswith("http://") | F.col("payload").startswith("https://")
    score = F.when(is_url, F.when(F.col("_high"), 0.6).otherwise(0.3)).otherwise(0.1)
    return judged.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("qr_codes"), F.max(score).alias("max_threat_score"))


