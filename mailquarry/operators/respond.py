"""Responses to judged mails: action plans, ledger and alert rows, indicators, similar threats.

Input rows carry email_id, sender, subject, threat_level, threat_score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions.text import SPACE
from mailquarry.plans.skew import position_within, small
from mailquarry.sinks.facts import staged

# Fixed texts of alerts and incidents
ALERT_SUBJECT = "🚨 %s Threat Detected"
ALERT_BODY = "\n".join([
    "A %s level threat has been detected and automatically processed.",
    "Email Details:", "- Sender: %s", "- Subject: %s", "- Threat Score: %s", "- Detection Time: %s",
    "Please review the threat analysis in the security dashboard.",
])
INCIDENT_TITLE = "Phishing Email Detected - %s Risk"
INCIDENT_DESCRIPTION = "\n".join([
    "Automated phishing detection system identified a %s level threat.",
    "Email Information:", "- Message ID: %s", "- From: %s", "- Subject: %s", "- Received: %s",
    "Threat Analysis Results:", "- Overall Threat Score: %s",
])
#: An indicator of more mails than this is a common one.
MAILS_OF_COMMON = 64
#: Over how many parts the rows of an indicator are counted, and in how many parts groups are numbered.
PARTS, NUMBERED_PARTS = 64, 1024
#: Bits of a count; those of the second count of a group follow.
COUNT_BITS = 63


def action_rules(spark) -> DataFrame:
    """(threat_level, actions) with the actions in order."""
    return spark.createDataFrame(list(lx.RESPONSE_ACTIONS.items()), "threat_level string, actions array<string>")


def with_actions(judged: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the ordered action list of the level; null for a level without a rule."""
    return judged.join(small(rules, 1000), "threat_level", "left")


def response_plan(judged: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per mail and action in order; a mail of unknown level gives one error row."""
    planned = with_actions(judged, rules)
    error = F.when(F.col("actions").isNull(), F.concat(
        F.lit("'"), F.coalesce("threat_level", F.lit("None")), F.lit("' is not a valid ThreatLevel")))
    return planned.select(
        "email_id", "sender", "threat_level", "threat_score", error.alias("error"),
        F.posexplode_outer("actions").alias("position", "action"))


def quarantine_rows(plan: DataFrame, at: Column) -> DataFrame:
    """Ledger rows of the planned quarantines."""
    return plan.filter(F.col("action") == "quarantine").select(
        "email_id", F.concat(F.lit("Automated response to "), "threat_level", F.lit(" threat")).alias("reason"),
        F.lit("QUARANTINED").alias("status"), at.alias("quarantined_at"))


def response_log(judged: DataFrame, rules: DataFrame, at: Column) -> DataFrame:
    """One record per mail with its actions; the list belongs to the level, so nothing is grouped."""
    return with_actions(judged, rules).filter("actions is not null").select(
        at.alias("timestamp"), "threat_level", "email_id", "sender", F.col("actions").alias("actions_executed"))


def blocklist(judged: DataFrame) -> DataFrame:
    """Senders of CRITICAL mails with the reason and their highest score."""
    return judged.filter(F.col("threat_level") == "CRITICAL").groupBy("sender").agg(
        F.max("threat_score").alias("threat_score"),
        F.max_by("email_id", F.struct("threat_score", "email_id")).alias("email_id"),
    ).withColumn("reason", F.lit("Automated block due to CRITICAL threat"))


def alerts(judged: DataFrame, at: Column) -> DataFrame:
    """Alert subject, body and priority per mail."""
    return judged.select(
        "email_id", F.format_string(ALERT_SUBJECT, "threat_level").alias("alert_subject"),
        F.format_string(ALERT_BODY, "threat_level", "sender", "subject", F.format_number("threat_score", 2),
                        at.cast("string")).alias("alert_body"),
        F.when(F.col("threat_level").isin("HIGH", "CRITICAL"), "HIGH").otherwise("MEDIUM").alias("priority"))


def incidents(judged: DataFrame) -> DataFrame:
    """Incident rows of CRITICAL mails; the id depends on the mail only, so a rerun gives the same."""
    return judged.filter(F.col("threat_level") == "CRITICAL").select(
        F.concat(F.lit("INC-"), F.substring(F.sha2("email_id", 256), 1, 16)).alias("incident_id"),
        F.format_string(INCIDENT_TITLE, "threat_level").alias("title"),
        F.format_string(INCIDENT_DESCRIPTION, "threat_level", "email_id", "sender", "subject",
                        F.col("received_at").cast("string"), F.format_number("threat_score", 3)).alias("description"),
        F.col("threat_level").alias("severity"), F.lit("Email Security").alias("category"), "email_id")


def response_statistics(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(kind, name, value) rows: total, per level, per action and mean per day of the period."""
    start = F.expr(f"cast('{as_of}' as timestamp_ntz) - interval {int(days)} days")
    recent = log.filter((F.col("timestamp") > start) & (F.col("timestamp") <= F.lit(as_of).cast("timestamp_ntz")))
    levels = recent.groupBy("threat_level", "actions_executed").agg(F.count(F.lit(1)).alias("n"))
    per_level = levels.groupBy(F.col("threat_level").alias("name")).agg(F.sum("n").cast("double").alias("value")).select(
        F.lit("level").alias("kind"), "name", "value")
    per_action = levels.select(F.explode("actions_executed").alias("name"), "n").groupBy("name").agg(
        F.sum("n").cast("double").alias("value")).select(F.lit("action").alias("kind"), "name", "value")
    total = levels.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n")).select(
        F.lit("total").alias("kind"), F.explode(F.create_map(
            F.lit("responses"), F.col("n"), F.lit("per_day"), F.col("n") / days)).alias("name", "value"))
    return per_level.unionByName(per_action).unionByName(total)


def sender_domains(mails: DataFrame) -> DataFrame:
    return mails.select("message_id", F.lower(F.substring_index("sender", "@", -1)).alias("sender_domain"))


def indicators(mails: DataFrame, bad_links: DataFrame) -> DataFrame:
    """Distinct (mail, indicator): sender domain, malicious URLs, first three longer subject words."""
    words = F.filter(F.split(F.lower("subject"), f"[{SPACE}]+"), lambda w: F.length(w) > 3)
    domain = F.when(F.contains("sender", F.lit("@")),
                    F.concat(F.lit("sender_domain:"), F.get(F.split("sender", "@"), F.lit(1))))
    own = mails.select("message_id", F.explode(F.array_compact(F.concat(
        F.array(domain),
        F.coalesce(F.transform(F.slice(words, 1, 3), lambda w: F.concat(F.lit("subject_keyword:"), w)), F.array().cast("array<string>"))))).alias("indicator"))
    links = bad_links.select("message_id", F.concat(F.lit("url:"), "url").alias("indicator"))
    return own.unionByName(links).distinct()


def detection_patterns(threats: DataFrame, bad_links: DataFrame, known: DataFrame) -> DataFrame:
    """New URL and sender patterns of threat mails that are not in the rule table yet."""
    links = bad_links.join(threats.select("message_id"), "message_id", "left_semi").select(
        F.lit("url_pattern").alias("type"), F.col("url").alias("pattern"), F.lit(0.8).alias("confidence"))
    senders = threats.filter("sender <> ''").select(
        F.lit("sender_pattern").alias("type"), F.col("sender").alias("pattern"), F.lit(0.7).alias("confidence"))
    found = links.unionByName(senders).distinct().withColumn("source", F.lit("automated_analysis"))
    return found.join(known.select("type", "pattern").distinct(), ["type", "pattern"], "left_anti")


def shared_rows(found: DataFrame, threats: DataFrame) -> DataFrame:
    """(message_id, is_threat, indicator, n_mails): every indicator row with how many mails have the indicator."""
    flagged = threats.select("message_id", F.lit(True).alias("is_threat")).distinct()
    mails = found.groupBy("message_id").agg(F.collect_set("indicator").alias("indicators")).join(flagged, "message_id", "left")
    mails = staged(mails.select("message_id", F.coalesce("is_threat", F.lit(False)).alias("is_threat"), "indicators"), "indicator-mails")
    rows = mails.select("message_id", "is_threat", F.pmod(F.xxhash64("message_id"), F.lit(PARTS)).alias("part"), F.explode("indicators").alias("indicator"))
    here = rows.groupBy("indicator", "part").agg(F.count(F.lit(1)).alias("n_here"))
    total = here.groupBy("indicator").agg(F.sum("n_here").alias("n_mails"))
    counted = rows.join(here.select("indicator", "part").join(total, "indicator"), ["indicator", "part"])
    return staged(counted.select("message_id", "is_threat", "indicator", "n_mails"), "indicators")


def _bits(count: Column, base: int) -> Column:
    """The places of the bits that are set in a count, from ``base``."""
    places = F.sequence(F.lit(0), F.lit(COUNT_BITS - 1))
    return F.transform(F.filter(places, lambda b: F.call_function("getbit", count, b) == 1), lambda b: b + base)


def group_unions(groups: DataFrame) -> DataFrame:
    """(commons, n, n_threats) of groups of mails with the same ``commons``, for those with a threat: how many mails and threats are in all
    groups that share an indicator with it.

    A bitmap has the groups that have an indicator, not their mails, and there is one for each bit of the groups' counts: the groups of a
    union with that bit, counted, times its value, are its part of the sum. So its size depends on the distinct groups alone.
    """
    numbered = position_within(groups, [], F.pmod(F.xxhash64("commons"), F.lit(NUMBERED_PARTS)), [F.asc("commons")], "number")
    # written, so that a group's number is the same wherever it is read
    numbered = staged(numbered, "numbered-groups")
    planes = F.explode(F.concat(_bits(F.col("n"), 0), _bits(F.col("n_threats"), COUNT_BITS))).alias("plane")
    placed = numbered.select("commons", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("position"), planes)
    maps = placed.select(F.explode("commons").alias("indicator"), "bucket", "plane", "position").groupBy(
        "indicator", "bucket", "plane").agg(F.bitmap_construct_agg("position").alias("groups"))
    wanted = numbered.filter("n_threats > 0")
    unions = wanted.select("number", F.explode("commons").alias("indicator")).join(maps, "indicator").groupBy(
        "number", "bucket", "plane").agg(F.bitmap_count(F.bitmap_or_agg("groups")).alias("n_groups"))

    def total(base: int) -> Column:
        of = F.col("plane").between(base, base + COUNT_BITS - 1)
        return F.coalesce(F.sum(F.when(of, F.col("n_groups") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("plane") - base))), F.lit(0))

    sums = unions.groupBy("number").agg(total(0).alias("n"), total(COUNT_BITS).alias("n_threats"))
    return wanted.select("number", "commons").join(sums, "number").drop("number")


def similar_threats(found: DataFrame, threats: DataFrame, dense: int = MAILS_OF_COMMON) -> DataFrame:
    """For each threat, how many other mails share an indicator with it and how many are threats.

    Indicators of more than ``dense`` mails are common, others rare. Mails with the same common indicators are one group, and the mails that
    share a common indicator with a threat are those of the groups that do (:func:`group_unions`). The mails that share only a rare one
    are added: at most ``dense`` for each rare indicator of a distinct set of indicators. No step has a row for each set and part of the mails.
    """
    rows = shared_rows(found, threats)
    shared, common = F.col("n_mails") > 1, F.col("n_mails") > dense
    mails = staged(rows.groupBy("message_id").agg(
        F.bool_or("is_threat").alias("is_threat"),
        F.sort_array(F.collect_set(F.when(shared & common, F.col("indicator")))).alias("commons"),
        F.sort_array(F.collect_set(F.when(shared & ~common, F.col("indicator")))).alias("rares")), "mails-by-indicators")
    groups = mails.filter(F.size("commons") > 0).groupBy("commons").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_threat").alias("n_threats"))
    unions = group_unions(groups)

    own = mails.filter("is_threat").withColumn("set", F.when(F.size("rares") > 0, F.sha2(F.to_json(F.struct("commons", "rares")), 256)))
    sets = own.filter("set IS NOT NULL").select("set", "commons", "rares").distinct().select("set", "commons", F.explode("rares").alias("indicator"))
    others = mails.select("message_id", "is_threat", F.col("commons").alias("others"), F.explode("rares").alias("indicator"))
    only_rare = sets.join(others, "indicator").filter(~F.arrays_overlap("commons", "others")).select("set", "message_id", "is_threat").distinct().groupBy(
        "set").agg(F.count(F.lit(1)).alias("n_rare"), F.count_if("is_threat").alias("n_rare_threats"))

    def others_of(by_groups: str, by_rares: str) -> Column:
        # a threat is one of the mails that share with it
        return F.greatest(F.coalesce(by_groups, F.lit(0)) + F.coalesce(by_rares, F.lit(0)) - 1, F.lit(0))

    return own.join(unions, "commons", "left").join(only_rare, "set", "left").select(
        "message_id", others_of("n", "n_rare").alias("emails_scanned"), others_of("n_threats", "n_rare_threats").alias("threats_found"))
