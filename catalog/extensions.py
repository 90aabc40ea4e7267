"""Extension points: rules, languages and feeds added as rows."""

from pyspark.sql import functions as F

from catalog.registry import plain, register
from catalog.reputation import FEEDS
from datasets.views import view
from mailquarry import lexicon as lx
from mailquarry.lexicon import Rule
from mailquarry.operators import content, reputation
from oracles import content as oc
from oracles.sql import hits, items

CUSTOM = [
    Rule("Hidden_Frame", "phishing", "medium", (("<html", "</html>"), ("display:none", "visibility:hidden"))),
    Rule("Dollar_Amounts", "financial_scam", "low", pattern=r"\$[0-9]+", more_than=0),
]


@register("ext_custom_rules", f"""
    SELECT message_id, rule_name, category, severity, score FROM ({oc.rule_rows('v_emails', 'message_id', 'content', lx.RULES + CUSTOM)}) r
    WHERE rule_name IN ('Hidden_Frame', 'Dollar_Amounts')""")
def ext_custom_rules(spark, sf):
    table = lx.rule_table(spark).unionByName(lx.rule_table(spark, CUSTOM))
    found = content.scan_rule_table(view(spark, sf, "v_emails"), table)
    return plain(found.filter(F.col("rule_name").isin([r.name for r in CUSTOM])))


GERMAN = {"urgency": ["sofort", "dringend", "und"], "trust": ["die", "bitte"]}


@register("ext_language", " UNION ALL ".join(
    f"SELECT message_id, '{cat}' AS category, {hits('lower(content)', terms)}::BIGINT AS hits, "
    f"array_to_string(list_filter({items(terms)}, lambda x: contains(lower(content), x)), '|') AS terms FROM v_emails WHERE lang = 'de'"
    for cat, terms in GERMAN.items()))
def ext_language(spark, sf):
    extra = [("manipulation", "de", cat, i, t) for cat, terms in GERMAN.items() for i, t in enumerate(terms)]
    found = content.lexicon_hits(view(spark, sf, "v_emails"), lx.lexicon_table(spark, extra), "manipulation")
    german = view(spark, sf, "v_emails").filter("lang = 'de'").select("message_id")
    return plain(found.join(german, "message_id", "left_semi").drop("size"))


@register("ext_feed", """
    SELECT ioc, count(*) AS sources_checked, round(coalesce(avg(threat_score), 0e0), 8) AS threat_score FROM (
        SELECT ioc, ioc_type, threat_score FROM f_scores
        UNION ALL SELECT 'd' || (user_id % 97) || '.example.com' AS ioc, 'domain' AS ioc_type, count_if(event_type = 'error') / count(*)::DOUBLE AS threat_score
        FROM events GROUP BY 1) x GROUP BY ioc, ioc_type""", FEEDS)
def ext_feed(spark, sf):
    base = view(spark, sf, "v_feeds")
    # a new source: error share of the domain's events, as counts
    added = view(spark, sf, "events").groupBy(
        F.concat(F.lit("d"), (F.col("user_id") % 97).cast("string"), F.lit(".example.com")).alias("ioc")
    ).agg(F.count_if(F.col("event_type") == "error").alias("malicious"), F.count(F.lit(1)).alias("n")).select(
        "ioc", F.lit("domain").alias("ioc_type"), F.lit("event_errors").alias("source"), "malicious",
        F.lit(0).cast("bigint").alias("suspicious"), (F.col("n") - F.col("malicious")).alias("harmless"))
    merged = reputation.normalise_feeds(base.unionByName(added, allowMissingColumns=True))
    return plain(reputation.aggregate_verdicts(merged).select("ioc", "sources_checked", "threat_score"))


# tables of terms and rules that grow with the data: each run of three words of the benchmark, and a rule for each of its texts
_WIDE_TERMS = """
    SELECT DISTINCT lower(array_to_string(w[i:i+2], ' ')) AS term FROM (
        SELECT w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT string_split(text, ' ') AS w FROM benchmark) a) b"""


@register("join_lexicon_wide", f"""
    SELECT message_id, 'benchmark' AS category, count(*) AS hits, md5(string_agg(term, '|' ORDER BY term)) AS terms
    FROM v_emails JOIN ({_WIDE_TERMS}) t ON contains(lower(content), term) GROUP BY message_id""")
def join_lexicon_wide(spark, sf):
    words = view(spark, sf, "benchmark").select(F.split("text", " ").alias("w")).filter("size(w) > 2")
    runs = words.select("w", F.explode(F.sequence(F.lit(1), F.size("w") - 2)).alias("i"))
    terms = runs.select(F.lower(F.array_join(F.slice("w", F.col("i"), 3), " ")).alias("term")).distinct()
    lexicon = terms.select(F.lit("wide").alias("lexicon"), F.lit("any").alias("lang"), F.lit("benchmark").alias("category"), F.lit(0).alias("position"), "term")
    found = content.lexicon_hits(view(spark, sf, "v_emails"), lexicon, "wide", most_inline=0).filter("hits > 0")
    return plain(found.select("message_id", "category", F.col("hits").cast("bigint").alias("hits"), F.md5(F.array_join(F.sort_array("terms"), "|")).alias("terms")))


@register("join_rules_wide", """
    SELECT message_id, 'item_' || item_id AS rule_name, 'benchmark' AS category, 'high' AS severity, 0.8e0 AS score
    FROM v_emails JOIN (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark) b
      ON (contains(lower(content), w[1]) OR contains(lower(content), w[2])) AND contains(lower(content), w[3]) AND contains(lower(content), w[4])
    WHERE len(w) >= 4""")
def join_rules_wide(spark, sf):
    words = view(spark, sf, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w")).filter("size(w) >= 4")
    one = [F.array(F.col("w")[i]) for i in (2, 3)]
    rules = words.select(
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("rule_name"), F.lit("benchmark").alias("category"), F.lit("high").alias("severity"),
        F.array(F.slice("w", 1, 2), *one).alias("groups"), F.lit(None).cast("string").alias("pattern"), F.lit(0).alias("more_than"))
    return plain(content.scan_rule_table(view(spark, sf, "v_emails"), rules, most_inline=0))
