"""Vendor reports and indicator feeds turned into verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.schemas import HOST_REPORT, SCAN_REPORT

VERDICT_ABOVE = [(0.7, "MALICIOUS"), (0.4, "SUSPICIOUS"), (0.1, "QUESTIONABLE")]


def scan_verdicts(reports: DataFrame, key: str) -> DataFrame:
    """Scan reports (key, report json) to verdict rows of vendor ``scan``."""
    parsed = reports.select(key, F.from_json("report", SCAN_REPORT).alias("r"))
    positives = F.coalesce("r.positives", F.lit(0))
    total = F.coalesce("r.total", F.lit(1))
    detected = F.filter(F.map_values("r.scans"), lambda s: F.coalesce(s["detected"], F.lit(False)))
    names = F.transform(detected, lambda s: F.lower(F.coalesce(s["result"], F.lit(""))))
    return parsed.select(
        key, F.lit("scan").alias("vendor"),
        F.when(total > 0, 1 - positives / total).otherwise(F.lit(0.5)).alias("reputation_score"),
        (positives > 0).alias("is_malicious"),
        F.coalesce(F.array_distinct(F.filter(names, lambda n: n != "")),
                   F.array().cast("array<string>")).alias("threat_types"),
        positives.alias("positives"), total.alias("total"),
    )


def host_verdicts(reports: DataFrame, key: str) -> DataFrame:
    """Host reports (key, report json) to verdict rows of vendor ``host``."""
    parsed = reports.select(key, F.from_json("report", HOST_REPORT).alias("r")).select(
        key, F.coalesce("r.detections.count", F.lit(0)).alias("count"),
        F.map_values("r.detections.engines").alias("engines"))
    engines = F.coalesce(F.size("engines"), F.lit(0))
    detected = F.filter("engines", lambda e: F.coalesce(e["detected"], F.lit(False)))
    return parsed.select(
        key, F.lit("host").alias("vendor"),
        F.when(engines > 0, 1 - F.col("count") / engines).otherwise(F.lit(0.5)).alias("reputation_score"),
        (F.col("count") > 0).alias("is_malicious"),
        F.coalesce(F.array_distinct(F.transform(
            detected, lambda e: F.coalesce(e["category"], F.lit("malicious")))),
            F.array().cast("array<string>")).alias("threat_types"),
        F.col("count").alias("detections"), engines.alias("engines_count"),
    )


def verdict_table(scan: DataFrame, host: DataFrame | None, key: str) -> DataFrame:
    """Verdicts of both vendors in one long table."""
    columns = [key, "vendor", "reputation_score", "is_malicious", "threat_types"]
    rows = scan.select(columns)
    return rows if host is None else rows.unionByName(host.select(columns))


def _share(malicious: Column, suspicious: Column, harmless: Column) -> Column:
    parts = [F.coalesce(c, F.lit(0)) for c in (malicious, suspicious, harmless)]
    return (parts[0] + parts[1]) / F.greatest(parts[0] + parts[1] + parts[2], F.lit(1))


def normalise_feeds(feeds: DataFrame) -> DataFrame:
    """Raw feed rows to (ioc, ioc_type, source, threat_score, error, detected, threat_type).

    A source not named here counts as a scan source when it reports counts, otherwise as a
    custom feed; adding a source means adding rows.
    """
    source = F.col("source")
    share = _share(F.col("malicious"), F.col("suspicious"), F.col("harmless"))
    score = (
        F.when(source == "urlhaus", F.when(F.col("query_status") == "ok", 0.8).otherwise(0.0))
        .when(source == "phishtank", F.when(F.coalesce("verified", F.lit(False)), 0.9).otherwise(0.0))
        .when(source == "abuseipdb", F.coalesce("abuse_pct", F.lit(0)) / 100)
        .when(source == "hybrid_analysis", F.coalesce("sandbox_score", F.lit(0)) / 100)
        .when(F.col("malicious").isNotNull(), share)
        .otherwise(F.lit(0.0))
    )
    detected = (
        ((source == "urlhaus") & (F.coalesce("query_status", F.lit("")) == "ok"))
        | ((source == "phishtank") & F.coalesce("in_database", F.lit(False)))
        | (F.coalesce("malicious", F.lit(0)) > 0)
    )
    failed = F.col("error").isNotNull()
    return feeds.select(
        "ioc", "ioc_type", "source",
        F.when(~failed, score).alias("threat_score"), "error",
        (~failed & detected).alias("detected"),
        F.when(~failed & detected, F.when((source == "urlhaus") & (F.col("query_status") == "ok"),
               F.coalesce("threat", F.lit("unknown"))).otherwise(F.coalesce("verdict", F.lit("unknown"))))
        .alias("threat_type"),
    )


def applicable_sources(iocs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each indicator with every source that covers its type, and that source's verdict if any."""
    sources = F.lit(None).cast("array<string>")
    for ioc_type, names in lx.IOC_SOURCES.items():
        sources = F.when(F.col("ioc_type") == ioc_type, F.array(*[F.lit(n) for n in names])).otherwise(sources)
    wanted = iocs.select("ioc", "ioc_type").distinct().select(
        "ioc", "ioc_type", F.explode(sources).alias("source"))
    return wanted.join(verdicts, ["ioc", "ioc_type", "source"], "left")


def aggregate_verdicts(verdicts: DataFrame) -> DataFrame:
    """One row per indicator: sources asked and answered, mean score, verdict, detecting sources."""
    # one row per source first: the context list is then bounded by the number of sources
    per_source = verdicts.groupBy("ioc", "ioc_type", "source").agg(
        F.max(F.struct(F.col("error").isNull().alias("answered"), "threat_score", "detected", "threat_type"))
        .alias("v")).select("ioc", "ioc_type", "source", "v.*")
    answered = F.col("answered") & F.col("threat_score").isNotNull()
    grouped = per_source.groupBy("ioc", "ioc_type").agg(
        F.count(F.lit(1)).alias("sources_checked"),
        F.count_if(answered).alias("sources_responded"),
        F.avg(F.when(answered, F.col("threat_score"))).alias("mean_score"),
        F.sort_array(F.collect_list(F.when(
            answered & F.col("detected"),
            F.concat_ws(":", "source", F.coalesce("threat_type", F.lit("unknown")))))).alias("threat_context"),
    )
    verdict = F.lit("CLEAN")
    for limit, name in reversed(VERDICT_ABOVE):
        verdict = F.when(F.col("mean_score") > limit, name).otherwise(verdict)
    return grouped.select(
        "ioc", "ioc_type", F.coalesce("mean_score", F.lit(0.0)).alias("threat_score"),
        "sources_checked", "sources_responded",
        F.when(F.col("sources_responded") == 0, "UNKNOWN").otherwise(verdict).alias("verdict"),
        "threat_context")
