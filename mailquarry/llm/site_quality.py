"""Quality with hierarchical empirical Bayes over hosts and paths.

A logistic classifier on counts of a text gives each document its own probability of being good. Sums of these
by host and by path within the host, reduced before the shuffle, give the sites' rates. The global rate is the
prior of the hosts and a host's posterior that of its paths; how strongly a site is drawn to its prior is estimated
by the method of moments from how much sites differ beyond what their sizes explain, so sparse sites are
shrunk most. A document's posterior adds to its own log odds what its path's posterior, without the document itself,
says beyond the global rate.

A document is kept if its posterior reaches the cutoff, which is 0.5 or, if lower, the value that a share of
``FALSE_REJECTION`` of the labelled good documents stays below.

Training takes at most ``MOST_SAMPLED`` labelled texts, the first by a hash of the id; all documents are scored, and all
enter the sites' sums. Sites stay tables: what goes through the driver are the classifier and a few sums.

Cases: a null text is an empty one. A null host or path is a site of its own. A document with several labels
is good if all say so; null labels say nothing. Repeated rows count and are answered as often as they occur.
With labels of one class or none, every document has the share of good labels (0.5 without labels) as its own
probability. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import in_arrow, same_row
from mailquarry.llm.quality_rules import COUNTS, measured
from mailquarry.llm.toxicity import logistic
from mailquarry.sinks.facts import staged

MOST_SAMPLED = 20_000
FALSE_REJECTION = 0.01
#: Documents that a site's prior is worth at least and at most.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e6
EDGE = 1e-6


@dataclass
class Classifier:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant


def features(counts: np.ndarray) -> np.ndarray:
    """Features of rows of ``COUNTS``: rates, and sizes as logarithms."""
    n = dict(zip(COUNTS, counts.T.astype(np.float64), strict=True))
    words, lines = np.maximum(n["n_words"], 1), np.maximum(n["n_lines"], 1)
    rates = [n["n_symbols"] / words, n["n_capitals"] / words, n["n_cries"] / words, n["n_dup_lines"] / lines, n["n_repeat_words"] / words]
    return np.stack([np.log1p(n["n_words"]), np.log1p(n["n_lines"]), n["word_chars"] / words, *rates, *[np.sqrt(r) for r in rates], n["n_words"] < 50], axis=1)


def trained(counts: np.ndarray, good: np.ndarray) -> Classifier:
    """The classifier of rows of counts and their labels."""
    width = features(np.zeros((1, len(COUNTS)))).shape[1]
    if len(set(good.tolist())) < 2:
        share = (good.mean() * len(good) + 0.5) / (len(good) + 1) if len(good) else 0.5
        return Classifier(np.zeros(width), np.ones(width), np.array([0.0] * width + [np.log(share / (1 - share))]))
    x = features(counts)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.concatenate(((x - centre) / scale, np.ones((len(x), 1))), axis=1)
    return Classifier(centre, scale, logistic(x, good.astype(np.float64), np.ones(len(x)), ridge=1.0))


def probabilities(model: Classifier, counts: np.ndarray) -> np.ndarray:
    x = np.concatenate(((features(counts) - model.centre) / model.scale, np.ones((len(counts), 1))), axis=1)
    return np.clip(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))), EDGE, 1 - EDGE)


def good_labels(labels: DataFrame) -> DataFrame:
    rows = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    return rows.groupBy("doc_id").agg((F.min("quality") == 1).cast("int").alias("good"))


def learned(rows: DataFrame, labels: DataFrame, most: int = MOST_SAMPLED) -> Classifier:
    """The classifier of measured rows and labels (doc_id, quality)."""
    sample = good_labels(labels).orderBy(F.xxhash64("doc_id")).limit(most)
    found = rows.join(sample, "doc_id").orderBy(F.xxhash64("doc_id"), *COUNTS).limit(most).select(*COUNTS, "good").toArrow()
    table = np.stack([found.column(c).to_numpy() for c in (*COUNTS, "good")], axis=1) if found.num_rows else np.zeros((0, len(COUNTS) + 1))
    return trained(table[:, :-1], table[:, -1])


def with_probability(rows: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, host, path, p) of measured rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kinds = dict(rows.dtypes)
    kept = ["doc_id", "host", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(probabilities(sent.value, counts))], names=[*kept, "p"])

    return in_arrow(rows, run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", p double")


def prior_strength(sites: DataFrame, mean: Column) -> float:
    """Documents that the prior of sites (n, s) is worth, by the method of moments.

    Sites of n documents with a common rate m differ by m(1 - m) / n; what they differ beyond that is between sites.
    """
    rate = F.col("s") / F.col("n")
    row = sites.where("n > 0").withColumn("m", mean).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("sites"),
        F.sum(F.col("n") * (rate - F.col("m")) * (rate - F.col("m"))).alias("away"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("own")).first()
    if not row["n"] or row["sites"] < 2:
        return MOST_PRIOR
    own = row["own"] / row["n"]
    between = (row["away"] - (row["sites"] - 1) * own) / max(row["n"] - row["n2"] / row["n"], 1e-9)
    return min(max(own / between - 1, LEAST_PRIOR), MOST_PRIOR) if between > 0 else MOST_PRIOR


def log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def posteriors(rows: DataFrame) -> DataFrame:
    """(doc_id, host, path, p, host_rate, path_rate, posterior) of rows (doc_id, host, path, p)."""
    paths = staged(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "llm-paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "llm-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = total["s"] / total["n"] if total["n"] else 0.5
    strength = prior_strength(hosts, F.lit(rate))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + strength * rate) / (F.col("n") + strength)).alias("host_rate"))
    sites = staged(paths.join(hosts, same_row(F.col("host"), F.col("h"))).drop("h"), "llm-sites")
    strength = prior_strength(sites, F.col("host_rate"))
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "host_rate")
    found = rows.join(sites, same_row(F.col("host"), F.col("h")) & same_row(F.col("path"), F.col("q")))
    others = (F.col("s") - F.col("p") + strength * F.col("host_rate")) / (F.col("n") - 1 + strength)
    found = found.withColumn("path_rate", others)
    z = log_odds(F.col("p")) + log_odds(F.col("path_rate")) - log_odds(F.lit(rate))
    return found.select("doc_id", "host", "path", "p", "host_rate", "path_rate", (1 / (1 + F.exp(-z))).alias("posterior"))


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, false_rejection: float = FALSE_REJECTION) -> DataFrame:
    """(doc_id, host, path, p, host_rate, path_rate, posterior, kept) of every row of ``docs``."""
    rows = docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    rows = staged(measured(rows, "host", "path"), "llm-counts")
    found = staged(posteriors(staged(with_probability(rows, learned(rows, labels)), "llm-evidence")), "llm-posteriors")
    low = found.join(good_labels(labels).where("good = 1"), "doc_id").agg(F.percentile_approx("posterior", false_rejection, 100_000)).first()[0]
    return found.withColumn("kept", F.col("posterior") >= min(0.5, 0.5 if low is None else low))
