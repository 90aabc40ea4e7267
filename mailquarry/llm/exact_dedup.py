"""Exact duplicates by progressive refinement: length, then a hash of the start, then a hash of the whole text.

Texts are equal when they are identical after lower-casing A-Z. Lower-casing keeps the number of bytes, so
the first round groups by bytes alone. Rows whose length occurs again are grouped by length and a hash of
their first ``PREFIX`` characters; only rows for which that occurs again too get lower-cased and hashed as a whole (SHA-256). The sets
of lengths and of starts that occur again go to the scan as bit filters of bounded size. A filter never
hides a member; a row that it lets through without need is one more text to hash and settles there.
Rows carry an id, lengths and hashes through the shuffles, never their text.

Of equal texts the row with the largest doc_id stays. Cases: a null text is an empty one, and empty texts are equal. Rows
without doc_id come before all others, so one of them stays only where no row of the group has a doc_id. Of repeated rows with
the largest doc_id exactly one stays. Extra columns are ignored by :func:`duplicates` and kept by
:func:`without_copies`. No rows give no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import documents_of, filter_bits, hash_filter, marked_in, perhaps_in, with_groups
from mailquarry.sinks.facts import staged

PREFIX = 256
#: Lengths below 2**24 bytes have a place of their own in their filter.
LENGTH_BITS = 24


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _sized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_bytes", F.octet_length("text").cast("long"))


def _started(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start_hash", F.xxhash64("n_bytes", lowered(F.substring("text", 1, PREFIX))))


def _repeated_starts(rows: DataFrame) -> tuple[DataFrame, int]:
    """(filter, its bits) of the (length, start) pairs that two or more rows have."""
    lengths = _sized(rows).groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1")
    again = perhaps_in(_sized(rows), F.col("n_bytes"), hash_filter(lengths, F.col("n_bytes"), LENGTH_BITS), LENGTH_BITS)
    starts = _started(again).groupBy("start_hash").agg(F.count("*").alias("n")).where("n > 1").select("start_hash")
    starts = staged(starts, "llm-starts")
    bits = filter_bits(starts.count())
    return staged(hash_filter(starts, F.col("start_hash"), bits), "llm-start-filter"), bits


def _survivors_marked(rows: DataFrame) -> DataFrame:
    """All rows with n_bytes, start_hash and ``open``: whether the first two rounds leave them undecided."""
    filled, bits = _repeated_starts(rows)
    return marked_in(_started(_sized(rows)), F.col("start_hash"), filled, bits, "open")


def duplicates(docs: DataFrame, hash_all: bool = False) -> DataFrame:
    """(doc_id, n_bytes, start_hash, digest, keep_id, group_size, kept) of every row.

    ``digest`` is the SHA-256 of the lower-cased text in hex; rows that earlier rounds settle have none
    unless ``hash_all`` asks for it.
    """
    rows = documents_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.sha2(lowered(F.col("text")), 256)
    found = _survivors_marked(rows).withColumn("digest", digest if hash_all else F.when(F.col("open"), digest))
    found = staged(found.select("doc_id", F.monotonically_increasing_id().alias("row"), "n_bytes", "start_hash", "open", "digest"), "llm-digests")
    groups = found.where("open").groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n"))
    groups = staged(groups.where("n > 1").select("digest", "keep", "n", F.col("n").alias("group_size")), "llm-equal-texts")
    grouped = with_groups(found.where("open"), groups, "digest", "n")
    alone = found.where("NOT open").withColumns({"keep": F.lit(None).cast(dict(groups.dtypes)["keep"]), "group_size": F.lit(None).cast("long")})
    none = F.col("keep").isNull()
    return grouped.unionByName(alone).select(
        "doc_id", "n_bytes", "start_hash", "digest", F.when(none, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows settled by length or start pass without a shuffle; the others are reduced to one row for each text, in their
    task first and then by digest. Rows with the same largest doc_id and the same text may differ in other columns; any one of them stays.
    """
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = _survivors_marked(docs.select(whole.alias("whole"), F.col("doc_id").alias("id"), text.alias("text")))
    settled = rows.where("NOT open").select("whole")
    open_rows = rows.where("open").select("whole", F.sha2(lowered(F.col("text")), 256).alias("digest"), F.struct("id", "text").alias("rank"))
    return settled.unionAll(open_rows.groupBy("digest").agg(F.max_by("whole", "rank").alias("whole")).select("whole")).select("whole.*")


def oracle() -> str:
    """DuckDB SQL of the digest over ``documents``."""
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM d WINDOW same AS (PARTITION BY norm)"""
