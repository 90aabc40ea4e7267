"""Registered queries of the corpus operators, over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.llm import (
    decontaminate, exact_dedup, filter_audit, language, licenses, lines, merkle, packing, quality_rules, records, simhash, site_quality, toxicity,
)
from mailquarry.llm.common import crc_fold, documents_of

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template another document had first."""
    return lines.dedup_lines(documents_of(table(spark, sf_dir, "documents")))


ORACLES["op1_line_templates"] = lines.oracle()


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents whose fold of 4 isn't 2."""
    docs = documents_of(table(spark, sf_dir, "documents"), "lang")
    held_out = crc_fold("doc_id", 4) == 2
    model = language.learned(docs, ~held_out)
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(found["fingerprint"]).alias("fingerprint"), "component_id")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every id of every document lies in the packed sequences."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


@query
def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the written files of records give it back."""
    folder = records.new_folder(spark)
    records.write_records(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), folder)
    return records.placed(spark, folder)


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document holds passages of the benchmark, of how many items, and the largest overlap."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", "item_id", "overlap")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels whose fold of 3 isn't 1."""
    docs = documents_of(table(spark, sf_dir, "documents"))
    held_out = crc_fold("doc_id", 3) == 1
    model = toxicity.learned(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    found = toxicity.scored(docs.withColumn("held_out", held_out), model, "held_out")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules, and the rules whose cutoffs the labels bear out."""
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license notices of every document."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


ORACLES["op2_licenses"] = licenses.oracle()


@query
def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its source is the host, and its language there the path."""
    found = site_quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"), F.col("source"), F.col("lang"))
    return found.select("doc_id", "host", "path", "p", "host_rate", "path_rate", "posterior", "kept")


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document's text, and the text's digest."""
    found = exact_dedup.duplicates(table(spark, sf_dir, "documents"), hash_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op11_exact_dedup"] = exact_dedup.oracle()


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at every step of all their orders, by language."""
    found = filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("filter")


ORACLES["op12_filter_audit"] = filter_audit.oracle()


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of every document; one more character is claimed where 7 divides the id's crc32."""
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(38,0)") + 1)


ORACLES["op13_merkle"] = merkle.oracle()
