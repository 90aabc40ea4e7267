"""Attachment jobs. File bytes are read in the scan stage only and never shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions import files as fl
from mailquarry.functions import rules as rl
from mailquarry.functions.text import cap, has, mentions
from mailquarry.plans.skew import spread_join

MALWARE_ABOVE = 0.7
RULE_FAMILIES = [("trojan", "Trojan"), ("ransomware", "Ransomware"), ("backdoor", "Backdoor"), ("worm", "Worm")]
VENDOR_FAMILIES = [
    ("trojan", "Trojan"), ("ransomware", "Ransomware"), ("crypto", "Ransomware"),
    ("backdoor", "Backdoor"), ("worm", "Worm"), ("adware", "Adware"),
]
UNKNOWN_FAMILY = "Unknown Malware"


def extract_attachments(mails: DataFrame) -> DataFrame:
    """Nested attachments of mails that have them, renamed and with defaults."""
    return (
        mails.filter("hasAttachments").select("message_id", F.posexplode("attachments").alias("pos", "a"))
        .select("message_id", "pos",
                F.coalesce("a.name", F.lit("")).alias("filename"),
                F.coalesce("a.size", F.lit(0)).alias("file_size"),
                F.coalesce("a.contentType", F.lit("")).alias("mime_type"),
                F.col("a.contentBytes").alias("file_data"))
    )


def file_bytes() -> Column:
    """Decoded data, null when it is absent, empty or not base64."""
    data = F.try_to_binary("file_data", F.lit("base64"))
    return F.when(F.length(data) > 0, data)


def score_static(files: DataFrame) -> DataFrame:
    """Adds the extension, size, type and name scores and their weighted sum."""
    name = F.col("filename")
    return (
        files.withColumn("extension", fl.extension(name))
        .withColumns({
            "extension_score": fl.extension_score(name, F.col("extension")),
            "size_score": fl.size_score(F.coalesce("file_size", F.lit(0))),
            "mime_score": fl.mime_score(F.coalesce("mime_type", F.lit("")), F.col("extension")),
            "name_score": fl.name_score(name, F.col("extension")),
        })
        .withColumn("static_score", F.col("extension_score") * 0.4 + F.col("size_score") * 0.1
                    + F.col("mime_score") * 0.3 + F.col("name_score") * 0.2)
    )


def guess_mime(files: DataFrame) -> DataFrame:
    """Expected media type by extension (fixed table) and whether the declared one differs."""
    spark = files.sparkSession
    table = F.broadcast(spark.createDataFrame(sorted(lx.EXPECTED_MIME.items()), "extension string, expected_mime string"))
    named = files.withColumn("extension", fl.extension(F.col("filename")))
    return named.join(table, "extension", "left").withColumn(
        "mismatch", F.coalesce((F.col("mime_type") != "") & (F.col("expected_mime") != F.col("mime_type")), F.lit(False)))


def scan(files: DataFrame, rules: list[lx.Rule] | None = None) -> DataFrame:
    """Hash and rule matches of each file; files without data get none.

    Bytes are read as Latin-1, one character per byte, so any file can be searched for ASCII.
    """
    decoded = files.withColumn("_data", F.try_to_binary("file_data", F.lit("base64")))
    scanned = decoded.withColumn("_bytes", F.when(F.length("_data") > 0, F.col("_data"))).drop("_data")
    text = F.when(F.col("_bytes").isNotNull(), F.decode("_bytes", "ISO-8859-1")).otherwise(F.lit(""))
    read = scanned.withColumn("file_hash", F.sha2("_bytes", 256)).withColumn("_text", text).withColumn("_lower", F.lower("_text"))
    return rl.with_matches(read, "_text", "_lower", rules).drop("_bytes", "_text", "_lower", "file_data")


def file_hashes(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.sha2(file_bytes(), 256)).drop("file_data")


def join_verdicts(hashed: DataFrame, verdicts: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Vendor verdict by file hash; files without a verdict keep nulls.

    A file that makes up much of the mail is spread with ``hot`` or split by the adaptive join.
    """
    per_hash = verdicts.groupBy("file_hash").agg(
        F.max(F.struct("reputation_score", "is_malicious", "threat_types")).alias("v")
    ).select("file_hash", F.col("v.reputation_score").alias("vendor_reputation"),
             F.col("v.is_malicious").alias("vendor_malicious"), F.col("v.threat_types").alias("vendor_types"))
    if hot is None:
        return hashed.join(per_hash, "file_hash", "left")
    return spread_join(hashed, per_hash, ["file_hash"], hot)


def _first_family(values: Column, families: list[tuple[str, str]]) -> Column:
    """Family of the first value that names one."""
    def one(value: Column) -> Column:
        family = F.lit(None).cast("string")
        for word, name in reversed(families):
            family = F.when(has(F.lower(value), word), name).otherwise(family)
        return family

    return F.try_element_at(F.filter(F.transform(values, one), lambda x: x.isNotNull()), F.lit(1))


def score_files(files: DataFrame, verdicts: DataFrame, rules: list[lx.Rule] | None = None,
                hot: DataFrame | None = None) -> DataFrame:
    """Threat score, malware flag and family per attachment."""
    joined = join_verdicts(scan(score_static(files), rules), verdicts, hot)
    vendor = F.when(F.col("vendor_malicious"), 1 - F.col("vendor_reputation")).otherwise(F.lit(0.0))
    combined = (
        F.when(vendor > 0, F.col("static_score") * 0.2 + F.col("rule_score") * 0.3 + vendor * 0.5)
        .when(F.col("rule_score") > 0, F.col("static_score") * 0.3 + F.col("rule_score") * 0.7)
        .otherwise(F.col("static_score")))
    # a record without a file name cannot be analysed and counts as medium risk
    readable = F.col("filename").isNotNull()
    scored = joined.withColumn("threat_score", F.when(readable, cap(combined)).otherwise(F.lit(0.5)))
    scored = scored.withColumn("is_malware", readable & (F.col("threat_score") > MALWARE_ABOVE))
    family = F.coalesce(
        _first_family(F.col("matches.category"), RULE_FAMILIES),
        _first_family(F.col("vendor_types"), VENDOR_FAMILIES), F.lit(UNKNOWN_FAMILY))
    return scored.withColumn("malware_family", F.when(F.col("is_malware"), family).otherwise(F.lit("")))


def rollup_files(scored: DataFrame) -> DataFrame:
    """One row per mail: count, average score, malicious and suspicious counts."""
    return scored.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("attachment_count"), cap(F.avg("threat_score")).alias("attachment_score"),
        F.count_if("is_malware").alias("malicious_files"),
        F.count_if((F.col("threat_score") > 0.5) & ~F.col("is_malware")).alias("suspicious_files"))


def flagged_files(scored: DataFrame) -> DataFrame:
    """The malicious and suspicious files of each mail, one row each."""
    verdict = F.when(F.col("is_malware"), "malicious").when(F.col("threat_score") > 0.5, "suspicious")
    return scored.withColumn("verdict", verdict).filter("verdict is not null").select(
        "message_id", "filename", "verdict")


def summary(scored: DataFrame) -> DataFrame:
    """(kind, name, value) rows: totals and the number of files per extension."""
    suffixes = scored.groupBy("extension").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("extension").alias("kind"), F.col("extension").alias("name"), "value")
    totals = scored.agg(
        F.count(F.lit(1)).cast("double").alias("total_files"),
        F.count_if("is_malware").cast("double").alias("malware_detected"),
        F.count_if((F.col("threat_score") > 0.5) & ~F.col("is_malware")).cast("double").alias("suspicious_files"),
        F.count_if((F.col("threat_score") <= 0.5) & ~F.col("is_malware")).cast("double").alias("clean_files"),
        F.coalesce(F.avg("threat_score"), F.lit(0.0)).alias("avg_threat_score"),
        F.count_if(F.size("matches") > 0).cast("double").alias("rule_detections"),
        F.count_if(F.coalesce("vendor_malicious", F.lit(False))).cast("double").alias("vendor_detections"))
    long = totals.unpivot([], totals.columns, "name", "value").select(F.lit("total").alias("kind"), "name", "value")
    return suffixes.unionByName(long)


def file_facts(scored: DataFrame, analyzed_at: Column) -> DataFrame:
    """Rows of the attachment fact table."""
    return scored.select(
        F.col("message_id").alias("email_analysis_id"), F.coalesce("filename", F.lit("")).alias("filename"),
        "file_size", "mime_type", F.coalesce("file_hash", F.lit("")).alias("file_hash"),
        F.col("matches.rule_name").alias("yara_matches"), F.col("rule_score").alias("yara_threat_score"),
        "is_malware", "malware_family", analyzed_at.alias("analyzed_at"))


def attachment_features(files: DataFrame) -> DataFrame:
    """The attachment features of each mail that has attachments."""
    name = F.lower(F.coalesce("filename", F.lit("")))
    size = F.coalesce("file_size", F.lit(0))
    return files.groupBy("message_id").agg(
        F.lit(1).alias("has_attachments"), F.count(F.lit(1)).alias("attachment_count"),
        F.count_if(mentions(name, lx.FEATURE_SUSPICIOUS_EXTENSIONS)).alias("suspicious_extensions"),
        F.count_if(mentions(name, lx.FEATURE_EXECUTABLE_EXTENSIONS)).alias("executable_attachments"),
        F.count_if(size > lx.FEATURE_LARGE_BYTES).alias("large_attachments"),
        F.sum(size).alias("total_attachment_size"))
