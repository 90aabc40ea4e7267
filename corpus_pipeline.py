"""The corpus pipeline: language ID, line dedup, near-duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.llm import decontaminate, language, lines, packing, simhash
from mailquarry.llm.common import apart
from mailquarry.llm.registry import table, tokenizer_file
from mailquarry.sinks.facts import staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised; models and limits come from their own labels."""
    docs, old = apart(docs, "doc_id", "text", "lang")
    found = language.identify(docs, language.learned(docs))
    return found.where("NOT rejected").select(old)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that another document had first; n_chars follows the text."""
    kinds, (docs, old) = dict(docs.dtypes), apart(docs, "doc_id", "text", "n_chars")
    found = lines.dedup_lines(docs)
    if "n_chars" in kinds:
        found = found.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return found.select(old)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints (three-word shingles, at most two bits apart)."""
    return simhash.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids of each document lie in the packed sequences."""
    return packing.digest(packing.pack(docs, tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: Models, fingerprints and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
