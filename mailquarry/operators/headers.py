"""Header jobs: authentication, route, time stamps, sender.

Everything that needs only the mail's own headers stays in its row as array expressions;
only (mail, address) pairs leave the row, for the country lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions import net
from mailquarry.functions.text import cap, flags, has, mentions
from mailquarry.plans.skew import small

NO_HEADERS = "No headers available for analysis"
_ADDRESS = r"[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+"


def header(name: str) -> Column:
    """Value of the last non-empty header with this name, '' when absent."""
    same = F.filter("headers", lambda h: (F.lower(h["name"]) == name) & (h["value"] != ""))
    return F.coalesce(F.try_element_at(same, F.lit(-1))["value"], F.lit(""))


def hops() -> Column:
    """Values of the Received headers, newest first as written."""
    received = F.filter("headers", lambda h: (F.lower(h["name"]) == "received") & (h["value"] != ""))
    return F.transform(received, lambda h: h["value"])


def has_headers() -> Column:
    return F.coalesce(F.size("headers"), F.lit(0)) > 0


def header_rows(mails: DataFrame) -> DataFrame:
    """(mail, lower-cased name, value); empty entries dropped, the last of a name wins."""
    filled = F.filter("headers", lambda h: (h["name"] != "") & (h["value"] != ""))
    kept = mails.select("message_id", filled.alias("_h"))
    last = F.filter("_h", lambda h, i: ~F.exists(
        F.slice("_h", i + 2, F.greatest(F.size("_h"), F.lit(1))), lambda later: F.lower(later["name"]) == F.lower(h["name"])))
    return kept.select("message_id", F.explode_outer(last).alias("h")).filter("h is not null").select(
        "message_id", F.lower("h.name").alias("name"), F.col("h.value").alias("value"))


def authentication(mails: DataFrame) -> DataFrame:
    """SPF, DKIM and DMARC results and scores per mail."""
    return _with_authentication(mails).select(
        "message_id", "spf_result", "dkim_result", "dmarc_result", "spf_score", "dkim_score",
        "dmarc_score", "authentication_score")


def _with_authentication(mails: DataFrame) -> DataFrame:
    read = mails.withColumns({"_spf": F.lower(header("received-spf")), "_auth": F.lower(header("authentication-results"))})
    spf, results = F.col("_spf"), F.col("_auth")
    spf_result = (F.when(has(spf, "pass"), "pass").when(has(spf, "softfail"), "softfail")
                  .when(has(spf, "fail"), "fail").when(has(spf, "neutral"), "neutral").otherwise("none"))
    dkim_result = F.when(header("dkim-signature") == "", "none").when(
        has(results, "dkim=pass"), "pass").when(has(results, "dkim=fail"), "fail").otherwise("present")
    dmarc_result = F.lit("none")
    for name in ("reject", "quarantine", "fail", "pass"):
        dmarc_result = F.when(has(results, f"dmarc={name}"), name).otherwise(dmarc_result)

    def scored(result: Column, scores: dict[str, float]) -> Column:
        value = F.lit(0.5)
        for name, s in scores.items():
            value = F.when(result == name, F.lit(s)).otherwise(value)
        return value

    named = read.withColumns({
        "spf_result": spf_result, "dkim_result": dkim_result, "dmarc_result": dmarc_result}).drop("_spf", "_auth")
    return (
        named
        .withColumns({
            "spf_score": scored(F.col("spf_result"), {"pass": 0.0, "fail": 1.0, "softfail": 0.7, "neutral": 0.3}),
            "dkim_score": scored(F.col("dkim_result"), {"pass": 0.0, "fail": 0.8, "present": 0.2}),
            "dmarc_score": scored(F.col("dmarc_result"), {"pass": 0.0, "fail": 0.9, "quarantine": 0.6, "reject": 1.0})})
        .withColumn("authentication_score",
                    F.col("spf_score") * 0.3 + F.col("dkim_score") * 0.3 + F.col("dmarc_score") * 0.4)
    )


def hop_addresses(mails: DataFrame) -> DataFrame:
    """(mail, hop, pos, ip) of the public addresses in the Received headers."""
    return mails.select("message_id", F.inline_outer(address_list())).filter("ip is not null")


def address_list() -> Column:
    """The public addresses of a mail's hops as array<struct<hop, pos, ip>>."""
    return F.flatten(F.transform(hops(), lambda value, hop: F.transform(
        net.public_ips(value), lambda ip, pos: F.struct(hop.alias("hop"), pos.alias("pos"), ip.alias("ip")))))


def sender_ip(mails: DataFrame) -> DataFrame:
    """First public address over the hops in order, per mail."""
    found = F.flatten(F.transform(hops(), net.public_ips))
    return mails.select("message_id", F.try_element_at(found, F.lit(1)).alias("sender_ip"))


def known_ranges(spark) -> DataFrame:
    """The built-in single-address lookup in range form."""
    rows = [(country, ip) for ip, country in lx.KNOWN_IP_COUNTRIES.items()]
    n = net.ip_number(F.col("ip"))
    return spark.createDataFrame(rows, "country string, ip string").select(
        "country", n.alias("start_ip"), n.alias("end_ip"))


def geo_join(addresses: DataFrame, ranges: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """Adds ``country``; unknown addresses get the unknown code.

    ``ranges`` (country, start_ip, end_ip) must not overlap. They are cut at /16 borders, so the
    lookup is an equi join on the /16 with a range test behind it. The range table is broadcast
    only while it is counted small; beyond that the join shuffles and adaptive execution splits
    a crowded /16.
    """
    cut = ranges.select(
        "country", "start_ip", "end_ip",
        F.explode(F.sequence(F.shiftright("start_ip", 16), F.shiftright("end_ip", 16))).alias("_block"))
    cut = small(cut, max_broadcast)
    numbered = addresses.withColumn("_n", net.ip_number(F.col("ip"))).withColumn("_b", F.shiftright("_n", 16))
    matched = numbered.join(
        cut, (F.col("_b") == F.col("_block")) & F.col("_n").between(F.col("start_ip"), F.col("end_ip")), "left")
    return matched.withColumn("country", F.coalesce("country", F.lit(lx.UNKNOWN_COUNTRY))).drop(
        "_n", "_b", "_block", "start_ip", "end_ip")


def address_rollup(located: DataFrame) -> DataFrame:
    """Per mail: high-risk addresses, distinct countries, sender country, evidence."""
    risky = F.col("country").isin(lx.HIGH_RISK_COUNTRIES)
    return located.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("public_ips"),
        F.count_if(risky).alias("high_risk_ips"),
        F.sort_array(F.collect_set("country")).alias("countries"),
        F.sort_array(F.collect_set(F.when(risky, F.concat_ws(" ", "ip", "country")))).alias("high_risk_evidence"),
        F.min_by("country", F.struct("hop", "pos")).alias("sender_country"),
        F.min_by("ip", F.struct("hop", "pos")).alias("sender_ip"))


def _route_columns() -> dict[str, Column]:
    received = hops()
    lowered = F.transform(received, F.lower)
    return {
        "hop_count": F.size(received),
        "disposable_hops": F.size(F.filter(lowered, lambda v: mentions(v, lx.DISPOSABLE_DOMAINS))),
        "unknown_hops": F.size(F.filter(lowered, lambda v: mentions(v, ["unknown", "localhost"]))),
    }


def _routing_score() -> Column:
    countries = F.coalesce(F.size("countries"), F.lit(0))
    return cap(
        F.coalesce("high_risk_ips", F.lit(0)) * F.lit(0.3) + F.col("disposable_hops") * 0.4
        + F.col("unknown_hops") * 0.2
        + F.when(F.col("hop_count") > 10, 0.3).when(F.col("hop_count") < 2, 0.4).otherwise(0.0)
        + F.when(countries > 3, 0.3).otherwise(0.0))


def _evidence_count() -> Column:
    return (F.coalesce("high_risk_ips", F.lit(0)) + F.col("disposable_hops")
            + (F.coalesce(F.size("countries"), F.lit(0)) > 3).cast("int"))


def routing(mails: DataFrame, ranges: DataFrame) -> DataFrame:
    """Route score per mail with hop counts, countries and evidence."""
    own = mails.select("message_id", *[c.alias(n) for n, c in _route_columns().items()])
    located = address_rollup(geo_join(hop_addresses(mails), ranges))
    return (
        own.join(located, "message_id", "left")
        .withColumn("routing_score", _routing_score())
        .withColumn("suspicious_hops", _evidence_count())
    )


def _stamps() -> Column:
    """Readable time stamps, oldest expected first: Date, then the hops from the bottom up."""
    written = F.concat(
        F.array(header("date")),
        F.reverse(F.transform(hops(), lambda v: F.regexp_extract(v, r";\s*(.+)$", 1))))
    return net.mail_times(written)


def timestamps(mails: DataFrame, as_of: Column) -> DataFrame:
    """Time score per mail from consecutive stamps; the lag stays inside the row."""
    return _with_timestamps(mails, as_of).select(
        "message_id", "stamps", "backward_steps", "long_gaps", "zone_changes", "timestamp_anomalies",
        "timezone_inconsistencies", "timestamp_score")


def _with_timestamps(mails: DataFrame, as_of: Column) -> DataFrame:
    n = F.size("_s")
    pairs = F.zip_with(
        F.slice("_s", 1, F.greatest(n - 1, F.lit(0))), F.slice("_s", 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(
            (b["epoch"] - a["epoch"]).alias("gap"), (a["zone_minutes"] != b["zone_minutes"]).alias("moved")))
    counted = mails.withColumn("_s", _stamps()).withColumn("_p", pairs).withColumns({
        "stamps": n,
        "backward_steps": F.size(F.filter("_p", lambda p: p["gap"] < 0)),
        "long_gaps": F.size(F.filter("_p", lambda p: p["gap"] > 86400)),
        "zone_changes": F.size(F.filter("_p", lambda p: p["moved"])),
        "earliest": F.array_min(F.transform("_s", lambda s: s["epoch"]))})
    future = F.col("earliest") > F.unix_timestamp(as_of) + 3600
    score = cap(F.col("backward_steps") * 0.6 + F.col("long_gaps") * 0.3 + F.col("zone_changes") * 0.2
                + F.when(future, 0.4).otherwise(0.0))
    enough = F.col("stamps") >= 2
    return counted.withColumns({
        "timestamp_anomalies": enough & (F.col("backward_steps") > 0),
        "timezone_inconsistencies": enough & (F.col("zone_changes") > 0),
        "timestamp_score": F.when(enough, score).otherwise(F.lit(0.0))}).drop("_s", "_p", "earliest")


def _sender_columns() -> dict[str, Column]:
    return_path = F.regexp_replace(header("return-path"), "^[<>]+|[<>]+$", "")
    sender = header("from")
    address = F.regexp_extract(sender, _ADDRESS, 0)
    return {
        "return_path_mismatch": (return_path != "") & (address != "") & (F.lower(return_path) != F.lower(address)),
        "disposable_from": mentions(F.lower(sender), lx.DISPOSABLE_DOMAINS),
    }


def _sender_score() -> Column:
    risky = F.coalesce(F.col("sender_country").isin(lx.HIGH_RISK_COUNTRIES), F.lit(False))
    return cap(F.when(risky, 0.4).otherwise(0.0) + F.when(F.col("return_path_mismatch"), 0.3).otherwise(0.0)
               + F.when(F.col("disposable_from"), 0.5).otherwise(0.0))


def sender(mails: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sender score per mail: origin country, return path and disposable domain."""
    own = mails.select("message_id", *[c.alias(n) for n, c in _sender_columns().items()])
    first = sender_ip(mails).withColumnRenamed("sender_ip", "ip").filter("ip is not null")
    located = geo_join(first, ranges).select("message_id", F.col("ip").alias("sender_ip"), F.col("country").alias("sender_country"))
    return own.join(located, "message_id", "left").withColumn("sender_score", _sender_score())


def _warnings() -> Column:
    risky = F.coalesce(F.col("sender_country").isin(lx.HIGH_RISK_COUNTRIES), F.lit(False))
    # fixed warning texts
    return flags(
        (~F.col("headers_present"), NO_HEADERS),
        (F.col("headers_present") & (F.col("spf_result") == "fail"), "SPF authentication failed"),
        (F.col("headers_present") & (F.col("dkim_result") == "fail"), "DKIM signature verification failed"),
        (F.col("headers_present") & (F.col("dmarc_result") == "fail"), "DMARC policy violation"),
        (F.col("headers_present") & (F.col("suspicious_hops") > 0),
         F.concat(F.lit("Suspicious routing detected ("), F.col("suspicious_hops").cast("string"), F.lit(" anomalies)"))),
        (F.col("headers_present") & F.col("timestamp_anomalies"), "Timestamp anomalies detected"),
        (F.col("headers_present") & F.col("return_path_mismatch"), "Return-Path and From header mismatch"),
        (F.col("headers_present") & risky,
         F.concat(F.lit("Email originated from high-risk country: "), F.col("sender_country"))),
    )


SCORE_COLUMNS = [
    "header_score", "authentication_score", "routing_score", "timestamp_score", "sender_score",
    "spf_result", "dkim_result", "dmarc_result", "sender_ip", "sender_country", "hop_count",
    "suspicious_routing", "timestamp_anomalies", "return_path_mismatch", "warnings",
]


def with_header_parts(mails: DataFrame, as_of: Column) -> DataFrame:
    """Adds every part that needs only the mail's own headers; drops the headers."""
    own = mails.withColumns({"headers_present": has_headers(), **_route_columns(), **_sender_columns()})
    return _with_timestamps(_with_authentication(own), as_of).drop(
        "headers", "spf_score", "dkim_score", "dmarc_score", "stamps", "backward_steps", "long_gaps",
        "zone_changes", "timezone_inconsistencies")


def finish_scores(parts: DataFrame, addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Joins the located addresses to the header parts and adds the scores and warnings."""
    located = address_rollup(geo_join(addresses, ranges))
    joined = (
        parts.join(located, "message_id", "left")
        .withColumns({"routing_score": _routing_score(), "suspicious_hops": _evidence_count(), "sender_score": _sender_score()})
    )
    present = F.col("headers_present")
    total = cap(F.col("authentication_score") * 0.4 + F.col("routing_score") * 0.3
                + F.col("timestamp_score") * 0.2 + F.col("sender_score") * 0.1)
    return (
        joined.withColumns({
            "warnings": _warnings(),
            "header_score": F.when(present, total).otherwise(F.lit(0.5)),
            "authentication_score": F.when(present, F.col("authentication_score")).otherwise(F.lit(0.5)),
            "routing_score": F.when(present, F.col("routing_score")).otherwise(F.lit(0.5)),
            "suspicious_routing": present & (F.col("suspicious_hops") > 0)})
    )


def score_headers(mails: DataFrame, ranges: DataFrame, as_of: Column) -> DataFrame:
    """Weighted header score per mail with its parts and warnings.

    One pass over the mails for all row-wise parts and one join with the address roll-up.
    """
    parts = with_header_parts(mails.select("message_id", "headers"), as_of)
    return finish_scores(parts, hop_addresses(mails), ranges).select("message_id", *SCORE_COLUMNS)


def header_facts(scored: DataFrame, analyzed_at: Column) -> DataFrame:
    """Rows of the header fact table."""
    return scored.select(
        F.col("message_id").alias("email_analysis_id"), "spf_result", "dkim_result", "dmarc_result",
        "sender_ip", "sender_country", F.lit(0.5).alias("sender_reputation_score"), "hop_count",
        "suspicious_routing", "timestamp_anomalies", F.col("header_score").alias("header_authenticity_score"),
        analyzed_at.alias("analyzed_at"))
