"""Quality rules whose thresholds control the risk of rejecting good text.

Every text is measured once. A rule rejects a text whose measure lies beyond a cutoff; each rule has a fixed list of
cutoffs from lenient to strict. In each stratum (language) the labelled good texts are a holdout: a cutoff
holds if the exact binomial test shows, at the error level, that it rejects less than the allowed share
of good texts, that is if P(X <= rejected) <= level for X ~ Binomial(holdout, allowed share). Cutoffs are tested in order and
the last one before the first failure is used (fixed-sequence testing, which needs no correction over
cutoffs); over rules and strata the level is divided by their number (Bonferroni). The allowed share is divided by the
number of rules, so all rules of a stratum together stay within it. A stratum with too few
labels gets no cutoff and rejects nothing.

Cases: a null text has no words and counts 0 everywhere; measures of a text without words are 0 and no
rule of this method rejects it. A null language is a stratum of its own. A document with several
labels is good if all say so; null labels say nothing. Repeated rows are answered as often as they occur, and count
in the holdout as often. Without labels nothing but the base rules rejects. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import in_arrow, slices, texts_of
from mailquarry.sinks.facts import staged

SPACES, SYMBOLS, CAPITALS, CRIES = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91)), b"!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_cries")
#: Cutoffs of each measure from lenient to strict; a text is rejected above its cutoff.
CUTOFFS = {
    "symbols": (4.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1),
    "capitals": (8.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5),
    "cries": (4.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeats": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "long_words": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0),
    "short_words": (-1.5, -2.0, -2.5, -3.0, -3.5),
}
ALLOWED, LEVEL = 0.02, 0.05
#: Strata whose cutoffs are sent to all executors at most; with more they are joined by shuffle.
MOST_SENT = 10_000


def counts_of(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    raw = text.encode()
    words = raw.split()  # bytes: ASCII white space only

    def without(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    lines = raw.split(b"\n")
    real = [x for x in lines if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, covered = Counter(windows), bytearray(len(words))
        for at, window in enumerate(windows):
            if times[window] > 1:
                covered[at: at + 3] = b"\x01\x01\x01"
        repeated = sum(covered)
    return (len(words), len(text) - without(SPACES), without(SYMBOLS), len(real) - len(set(real)), repeated,
            len(real), without(CAPITALS), without(CRIES))


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns and the counts of every row."""
    rows = docs.select("doc_id", *more, F.col("text").cast("string").alias("text"))
    kept = ["doc_id", *more]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([counts_of(x) for x in texts_of(part).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(found[:, i]) for i in range(len(COUNTS))], names=[*kept, *COUNTS])

    return in_arrow(rows, run, ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"{c} long" for c in COUNTS]))


def measures() -> dict[str, Column]:
    """What each rule holds against its cutoffs, 0 for texts without words."""
    def per(count: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(count) / F.col(of)).otherwise(0.0)

    return {
        "symbols": per("n_symbols", "n_words"), "capitals": per("n_capitals", "n_words"), "cries": per("n_cries", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "long_words": per("word_chars", "n_words"),
        "short_words": F.when(F.col("n_words") > 0, -F.col("word_chars") / F.col("n_words")).otherwise(-1e9),
    }


def lenience() -> Column:
    """By rule, how many of its cutoffs don't reject the row; the stricter ones after these do."""
    found = []
    for rule, value in measures().items():
        passed = F.lit(0)
        for cutoff in CUTOFFS[rule]:
            passed = passed + (value <= F.lit(cutoff)).cast("int")
        found += [F.lit(rule), passed]
    return F.create_map(*found)


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Binomial(n, p)."""
    if k >= n:
        return 1.0
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(k + 1)))


def strictest(passes: list[int], allowed: float, level: float, cutoffs: int) -> int:
    """How many cutoffs hold, tested in order; ``passes[i]`` good texts pass exactly i cutoffs."""
    n, rejected = sum(passes), 0
    for used in range(cutoffs):
        rejected += passes[used]  # this cutoff rejects texts that pass at most ``used`` before it
        # beyond twice the allowed share the test can't hold, and its sum would be long
        if n == 0 or rejected > 2 * allowed * n or at_most(rejected, n, allowed) > level:
            return used
    return cutoffs


def thresholds(rows: DataFrame, labels: DataFrame, allowed: float = ALLOWED, level: float = LEVEL) -> DataFrame:
    """(stratum, used): by rule, how many cutoffs hold, from rows (doc_id, stratum, passed) and labels (doc_id, quality)."""
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = rows.join(good, "doc_id").select("stratum", F.explode("passed").alias("rule", "passes"))
    held = staged(held.groupBy("stratum", "rule", "passes").agg(F.count("*").alias("n")), "llm-holdout")
    strata = max(held.select("stratum").distinct().count(), 1)
    rules = len(CUTOFFS)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        size = len(CUTOFFS[key[1].as_py()])
        passes = [0] * (size + 1)
        for row in table.to_pylist():
            passes[row["passes"]] += row["n"]
        return pa.table({"stratum": [key[0].as_py()], "rule": [key[1].as_py()], "used": pa.array([strictest(passes, allowed / rules, level / (rules * strata), size)], pa.int32())})

    found = held.groupBy("stratum", "rule").applyInArrow(run, "stratum string, rule string, used int")
    return found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "used"))).alias("used"))


def judged(docs: DataFrame, labels: DataFrame, allowed: float = ALLOWED, level: float = LEVEL) -> DataFrame:
    """The counts of every row, base_failed, failed_rules (joined by commas) and kept."""
    rows = measured(docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum")), "stratum")
    rows = staged(rows.withColumn("passed", lenience()), "llm-measures")
    used = staged(thresholds(rows, labels, allowed, level), "llm-thresholds")
    used = used.withColumnRenamed("stratum", "of")
    if used.count() <= MOST_SENT:
        used = F.broadcast(used)
    rows = rows.join(used, F.col("stratum") == F.col("of"), "left")
    # a cutoff that holds rejects texts that pass fewer cutoffs than are used
    failed = F.map_keys(F.map_filter("passed", lambda rule, passed: passed < F.coalesce(F.element_at("used", rule), F.lit(0))))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.when(F.col("used").isNull() | (F.col("n_words") == 0), F.array().cast("array<string>")).otherwise(failed)
    return rows.withColumns({"base_failed": base, "failed": failed}).select(
        "doc_id", *COUNTS, "base_failed", F.array_join(F.array_sort("failed"), ",").alias("failed_rules"), (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
