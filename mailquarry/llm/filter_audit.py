"""Audit of how filters interact: what each filter removes at each place of every order.

Every document becomes a mask, one bit for each filter that it fails; documents of one part (language) and mask are one
cell with counts, at most 32 cells a part however large the table is. A recursive query over the cells then
extends filter prefixes by each unused letter, joins the part's cells and carries the bits
applied so far; the row that a level emits holds the metrics of its last letter. The 120 full orders
take the metrics of their steps from the rows of their prefixes.

Filters, failing if: A under 100 words; B 100 * distinct words < 80 * words; C 100 * ``[A-Z]`` characters > 10 * code points;
D holds any of ``#$%&*|``; E the text is identical to that of a smaller doc_id anywhere in the table.

Cases: a null text is an empty one. A document with several label rows is good or toxic if one of them says so. A null language
is the part with an empty name, together with an empty language. Rows without doc_id have no labels, never fail E and
make no other row fail it; repeated rows with one doc_id are counted each and don't make each other fail it. Extra columns are not read.
No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import unlimited_recursion, with_groups
from mailquarry.sinks.facts import staged

LETTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = r"[#$%&*|]"


def _bit(letter: str, fails: Column) -> Column:
    return F.when(fails, 1 << LETTERS.index(letter)).otherwise(0)


def _own_mask(rows: DataFrame) -> DataFrame:
    """``mask`` of the filters that look at the text alone, instead of the text."""
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return rows.withColumn("mask", (
        _bit("A", n < LEAST_WORDS) + _bit("B", 100 * distinct < LEAST_DISTINCT * n)
        + _bit("C", 100 * capitals.cast("long") > MOST_CAPITALS * F.length("text").cast("long")) + _bit("D", F.col("text").rlike(SYMBOLS)))).drop("words", "text")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each language and set of failed filters."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _own_mask(rows.withColumn("digest", F.unhex(F.sha2("text", 256))))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    named = rows.where("doc_id IS NOT NULL").join(marks.where("doc_id IS NOT NULL"), "doc_id", "left")
    unnamed = rows.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    rows = staged(named.unionByName(unnamed).na.fill(0, ["good", "toxic"]), "llm-masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"))
    firsts = staged(firsts.where("n_rows > 1"), "llm-first-texts")
    again = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    full = with_groups(rows, firsts, "digest", "n_rows").withColumn("mask", F.col("mask") + _bit("E", again))
    return full.groupBy("part", "mask").agg(*[F.sum(x).cast("long").alias(a) for a, x in (("n", F.col("n")), ("good", F.col("n") * F.col("good")), ("toxic", F.col("n") * F.col("toxic")))])


def _sum(of: str, condition: str) -> str:
    return f"aggregate(c.cells, 0L, (s, x) -> s + IF({condition}, x.{of}, 0L))"


def prefix_metrics(counted: DataFrame) -> DataFrame:
    """(part, prefix, step, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost): one row for each
    part and each ordered choice of filters; the metrics are those of the last one. Step 0 is the empty prefix."""
    one_row = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    one_row = staged(one_row, "llm-cells")
    letters = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(LETTERS))
    removed = "x.mask & p.applied = 0 AND x.mask & p.next.bit <> 0"
    sql = f"""
WITH RECURSIVE prefixes(part, prefix, step, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT c.part, '', 0, 0, {_sum("n", "true")}, 0L, 0L, 0L, 0L, 0L FROM {{parts}} AS c
  UNION ALL
  SELECT p.part, concat(p.prefix, p.next.letter), p.step + 1, p.applied | p.next.bit,
    {_sum("n", "x.mask & (p.applied | p.next.bit) = 0")}, {_sum("n", removed)},
    {_sum("n", "x.mask & p.applied <> 0 AND x.mask & p.next.bit <> 0")}, {_sum("n", "x.mask = p.next.bit")},
    {_sum("good", removed)}, {_sum("toxic", removed)}
  FROM (SELECT *, explode(filter(array({letters}), l -> applied & l.bit = 0)) AS next FROM prefixes) AS p
  JOIN {{parts}} AS c ON c.part = p.part)
SELECT * FROM prefixes"""
    spark = counted.sparkSession
    with unlimited_recursion(spark):
        return staged(spark.sql(sql, parts=one_row), "llm-prefixes")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    ``shapley`` is what the row's filter removes, summed over all orders: 120 times its Shapley value.
    """
    metrics = prefix_metrics(cells(docs, labels))
    orders = metrics.where(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    orders = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    orders = orders.withColumn("prefix", F.expr("left(filter_order, step)"))
    rows = orders.join(metrics.drop("step", "applied"), ["part", "prefix"]).withColumn("filter", F.expr("right(prefix, 1)"))
    sums = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(sums, ["part", "filter"]).select(
        "part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def oracle() -> str:
    """DuckDB SQL of the audit over ``documents`` and ``labels``: every order and step counted on its own."""
    bits = " + ".join(f"CASE WHEN fails_{x.lower()} THEN {1 << i} ELSE 0 END" for i, x in enumerate(LETTERS))
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(LETTERS))
    slots = range(1, len(LETTERS) + 1)
    distinct = " AND ".join(f"l{b}.x <> l{a}.x" for a in slots for b in slots if a < b)
    order = " || ".join(f"l{i}.x" for i in slots)
    steps = " UNION ALL ".join(
        f"SELECT {order} AS filter_order, {k} AS step, l{k}.b AS bit, {' + '.join(['0'] + [f'l{i}.b' for i in slots if i < k])} AS applied FROM "
        + ", ".join(f"letters l{i}" for i in slots) + f" WHERE {distinct}" for k in slots)
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part, len(words) < {LEAST_WORDS} AS fails_a, 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) AS fails_b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) AS fails_c, regexp_matches(t, '{SYMBOLS}') AS fails_d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS fails_e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cell AS (SELECT part, {bits} AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters(x, b) AS (VALUES {letters}),
steps AS ({steps}),
m AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & applied <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps, cell GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM m"""
