"""Extra columns with names that the operators use themselves come through every stage with their values."""

import pytest

import corpus_pipeline
from mailquarry.llm import decontaminate, lines, simhash

CLASHING = ["_text_hash", "_id", "_hash", "_drops", "_copies", "score", "rejected", "lang_pred", "cross_entropy", "hash", "text_hash", "root", "fingerprint",
            "a.b", "key", "owner", "n_words", "item_id", "column_1_"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *[f"{c} of {r[0]}" for c in CLASHING]) for r in rows], schema).cache()


def values_are_own(found, docs):
    assert found.columns[: len(docs.columns)] == docs.columns
    rows = found.collect()
    assert rows and all(list(r[5: 5 + len(CLASHING)]) == [f"{c} of {r.doc_id}" for c in CLASHING] for r in rows)


def test_operators_keep_values(spark, sf, docs):
    values_are_own(lines.dedup_lines(docs), docs)
    values_are_own(simhash.first_of_each(docs), docs)
    values_are_own(decontaminate.clean(docs, spark.read.parquet(f"{sf}/benchmark.parquet")), docs)


def test_stages_keep_values(spark, sf, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, sf).cache()
        values_are_own(now, docs)
        assert now.count() <= before.count() and now.schema == before.schema, name
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() >= now.count()
