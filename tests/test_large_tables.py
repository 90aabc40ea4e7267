"""Lexicons and rule tables of any size: the indexed search against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.lexicon import Rule
from mailquarry.operators import content, terms

WORDS = ["konto", "prüfen", "änderung", "pass", "wort", "geld", "a", "über", "登录", "密码", "x", "verify", "now"]


def some_text(rng, n):
    return rng.choice(["", " "]).join(rng.choice(WORDS) for _ in range(n))


def text_rows(rng):
    rows = [(f"m{i}", rng.choice(["de", "en", "xx", None]), some_text(rng, rng.randrange(30))) for i in range(60)]
    return rows + [("m0", "de", rows[0][2]), ("m1", "en", None), (None, "de", "geld verify now"), ("long", "en", "konto pass " * 200_000 + "verify now")]


def term_rows(rng):
    every = [some_text(rng, n)[rng.randrange(3):] for n in (1, 1, 2, 2, 3, 4) for _ in range(40)] + ["", None, "登", "geld", "geld", "never there"]
    return [("big", rng.choice(["de", "en"]), rng.choice("ABC"), i, t) for i, t in enumerate(every)]


def test_terms_in_equals_contains(spark, monkeypatch):
    monkeypatch.setattr(terms, "CHUNK", 64)  # grams over the ends of chunks
    rng = random.Random(3)
    texts = spark.createDataFrame([(t or "",) for _, _, t in text_rows(rng)[:-1]], "text string").withColumn("body", terms.body_key(F.col("text")))
    wanted = {t for *_, t in term_rows(rng) if t is not None}
    got = terms.terms_in(texts, spark.createDataFrame([(t,) for t in wanted] + [(None,)], "term string"))
    keys = {r.body: r.text for r in texts.collect()}
    assert sorted((keys[r.body], r.term) for r in got.collect()) == sorted((x, t) for x in set(keys.values()) for t in wanted if t in x)
    assert terms.terms_in(texts, spark.createDataFrame([], "term string")).count() == 0
    assert terms.terms_in(texts.limit(0), spark.createDataFrame([("a",)], "term string")).count() == 0


def test_indexed_lexicon_equals_inline(spark):
    rng = random.Random(5)
    mails = spark.createDataFrame(text_rows(rng), "message_id string, lang string, content string")
    lexicon = spark.createDataFrame(term_rows(rng), "lexicon string, lang string, category string, position int, term string")
    inline = content.lexicon_hits(mails, lexicon, "big", most_inline=10_000)
    indexed = content.lexicon_hits(mails, lexicon, "big", most_inline=10)
    assert dict(inline.dtypes) == dict(indexed.dtypes)
    assert Counter(map(str, inline.collect())) == Counter(map(str, indexed.select(inline.columns).collect()))
    mails = mails.withColumn("subject", F.lit("Geld"))
    inline, indexed = content.term_frequencies(mails, lexicon), content.term_frequencies(mails, lexicon, most_inline=10)
    assert Counter(map(str, inline.collect())) == Counter(map(str, indexed.collect()))


def test_indexed_rules_equal_inline(spark):
    rng = random.Random(7)
    mails = spark.createDataFrame(text_rows(rng)[:-1], "message_id string, lang string, content string")
    pick = lambda: tuple(tuple(some_text(rng, 1).upper() for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(1, 4)))
    rules = [Rule(f"r{i}", rng.choice("xy"), rng.choice(["low", "high", "odd"]), pick()) for i in range(50)]
    rules += [Rule("p1", "x", "low", pattern="[a-c]o", more_than=1), Rule("p2", "x", "high", pattern="登", more_than=0), Rule("none", "x", "low"), rules[0]]
    table = lx.rule_table(spark, rules)
    inline, indexed = content.scan_rule_table(mails, table), content.scan_rule_table(mails, table, most_inline=10)
    assert inline.count() > 50
    assert Counter(map(str, inline.collect())) == Counter(map(str, indexed.select(inline.columns).collect()))


@pytest.mark.parametrize("n_terms", [200_000])
def test_many_terms_equal_brute_force(spark, sf, n_terms):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.lower(F.coalesce("text", F.lit(""))).alias("text")).withColumn("body", terms.body_key(F.col("text")))
    texts = {r.body: r.text for r in docs.collect()}
    # all pieces of three words that stand in a text, then invented ones
    pieces = {" ".join(w[i: i + 3]) for t in texts.values() for w in [t.split(" ")] for i in range(0, len(w) - 3, 2)}
    wanted = sorted(pieces)[:n_terms // 2] + [f"code {i} offer" for i in range(n_terms - min(len(pieces), n_terms // 2))]
    got = {(r.body, r.term) for r in terms.terms_in(docs, spark.createDataFrame([(t,) for t in wanted], "term string").repartition(8)).collect()}
    own, want = set(wanted), set()
    sizes = {len(t) for t in own}
    for body, text in texts.items():
        want |= {(body, text[i: i + n]) for n in sizes for i in range(len(text) - n + 1) if text[i: i + n] in own} if len(text) < 3000 else set()
    short = {b for b, t in texts.items() if len(t) < 3000}
    assert want and {p for p in got if p[0] in short} == want
    assert all(t in texts[b] for b, t in got)


def test_rules_of_fifty_thousand_strings(spark, sf):
    mails = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("message_id"), F.col("text").alias("content"))
    rows = [(r.message_id, (r.content or "").lower()) for r in mails.collect()]
    words = sorted({w for _, t in rows for w in re.findall(r"[a-z]{5,}", t)})
    rules = [Rule(f"r{i}", "x", "low", ((words[i % len(words)], f"no such {i}"), (words[(i * 7 + 3) % len(words)],))) for i in range(50_000)]
    got = {(r.message_id, r.rule_name) for r in content.scan_rule_table(mails, lx.rule_table(spark, rules).repartition(8)).collect()}
    sample = rows[::20]
    ids = {i for i, _ in sample}
    held = {i: {w for w in words if w in t} for i, t in sample}
    want = {(i, r.name) for i, _ in sample for r in rules if r.groups[0][0] in held[i] and r.groups[1][0] in held[i]}
    assert {g for g in got if g[0] in ids} == want
