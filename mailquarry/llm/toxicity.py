"""Toxicity by subword bags.

A word is its padded lower-case form and the character n-grams of it, hashed to buckets with an embedding each; the
vector of a word is the mean of those, so an unseen misspelling shares most of its parts with the word
it stands for. A text is cut into segments of ``SEGMENT`` words; the mean of a segment's word vectors goes
into a linear softmax, and embeddings and softmax are trained jointly in numpy (Adagrad on the log loss, with the text's
label for all its segments). A text's evidence is the largest margin of its segments, turned into a
probability by a logistic fit on texts left out of the training, with the true share of toxic labels.

Training takes at most ``MOST_SAMPLED`` labelled texts of each class, the first by a hash of the id; all texts
are scored whole. After training a bucket is one number, its embedding times the softmax weights, so the
model sent to executors has a fixed size.

Cases: a null text, an empty text or one without a letter or digit has no evidence and gets score 0. Repeated rows are answered as often as they occur. A document with several labels is toxic if one of them
says so; null labels say nothing. If a class has no label, every score is the share of toxic labels (0 without labels).
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import in_arrow, list_offsets, mixed, slices, texts_of

BUCKETS, SIZE, SEGMENT = 1 << 17, 8, 6
GRAMS = (3, 4, 5, 6)
#: Labelled texts of each class that are trained on at most.
MOST_SAMPLED = 2_000
EPOCHS, BATCH, RATE, SEED = 5, 256, 0.25, 7
START, STOP = "\x02", "\x03"


@dataclass
class Model:
    """Margin of each bucket, and the logistic fit of a text's evidence."""

    margin: np.ndarray
    bias: float
    fit: tuple[float, float, float]  # of the largest margin, of the logarithm of the segments, constant
    share: float


@dataclass
class Words:
    """The words of some texts and the buckets of the distinct ones."""

    offsets: np.ndarray  # of each text into index
    index: np.ndarray  # distinct word at each place
    buckets: np.ndarray  # of all distinct words
    starts: np.ndarray  # first bucket of each distinct word, and the end


def words_of(texts: pa.Array) -> Words:
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    plain = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), pattern=r"[^\p{L}\p{N}\p{M}]+", replacement="")
    real = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    padded = pc.if_else(pa.array(real), pc.binary_join_element_wise(START, plain, STOP, ""), "")
    chars = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own, bucket = [], []
    for n in GRAMS:
        if len(chars) < n:
            continue
        hashes = np.full(len(chars) - n + 1, n, dtype=np.uint64)
        for at in range(n):
            hashes = hashes * np.uint64(0x100000001B3) + chars[at: at + len(hashes)]
        inside = np.flatnonzero(np.arange(len(hashes)) + n <= ends[owner[: len(hashes)]])
        own.append(owner[inside])
        bucket.append(mixed(hashes[inside]) & np.uint64(BUCKETS - 1))
    # the whole word: a running hash over its characters
    whole = np.flatnonzero(sizes > 0)
    powers = np.power(np.uint64(0x9E3779B1), (np.arange(len(chars)) - np.repeat(ends - sizes, sizes)).astype(np.uint64))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(chars * powers, dtype=np.uint64)))
    own.append(whole)
    bucket.append(mixed((sums[ends[whole]] - sums[(ends - sizes)[whole]]) ^ np.uint64(0x5BD1E995)) & np.uint64(BUCKETS - 1))
    own, bucket = np.concatenate(own), np.concatenate(bucket).astype(np.int64)
    order = np.argsort(own, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(sizes)))))
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kept = real[index] if len(index) else np.zeros(0, dtype=bool)
    return Words(np.concatenate(([0], np.cumsum(kept)))[list_offsets(lists)], index[kept], bucket[order], starts)


def segments_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of the segments; a text's words are split evenly over its segments."""
    sizes = np.diff(offsets)
    counts = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, offsets[text] + nth * sizes[text] // np.maximum(counts[text], 1)


def _means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means of the values between starts, 0 where there are none; the last start is the end."""
    sizes = np.diff(starts)
    out = np.zeros((len(sizes), *values.shape[1:]), dtype=np.float64)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[:-1][some], axis=0)
    return out / np.maximum(sizes, 1).reshape(-1, *[1] * (values.ndim - 1))


def evidence(margin: np.ndarray, bias: float, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(largest margin of its segments, segments) of each text; minus infinity without a word."""
    words = words_of(texts)
    text, first = segments_of(words.offsets)
    own = _means(margin[words.buckets], words.starts)[words.index]
    best = np.full(len(texts), -np.inf)
    if len(text):
        np.maximum.at(best, text, _means(own, np.concatenate((first, [len(own)]))) + bias)
    return best, np.bincount(text, minlength=len(texts))


def trained(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Margins of the buckets and bias, from the segments of labelled texts."""
    words = words_of(pa.array(texts, pa.string()))
    text, first = segments_of(words.offsets)
    stops = np.concatenate((first[1:], [len(words.index)]))
    rng = np.random.default_rng(SEED)
    table, weights, bias = rng.normal(0, 0.1, (BUCKETS, SIZE)), rng.normal(0, 0.1, (SIZE, 2)), np.zeros(2)
    table_sum, weights_sum = np.full(BUCKETS, 1e-6), 1e-6
    target = labels[text]
    for _ in range(EPOCHS):
        order = rng.permutation(len(text))
        for at in range(0, len(order), BATCH):
            rows = order[at: at + BATCH]
            sizes = stops[rows] - first[rows]
            ends = np.cumsum(sizes)
            place = np.repeat(first[rows] - (ends - sizes), sizes) + np.arange(ends[-1])
            word, index = np.unique(words.index[place], return_inverse=True)
            counts = np.diff(words.starts)[word]
            stop = np.cumsum(counts)
            bucket = words.buckets[np.repeat(words.starts[word] - (stop - counts), counts) + np.arange(stop[-1])]
            vectors = _means(table[bucket], np.concatenate(([0], stop)))
            bags = _means(vectors[index], np.concatenate(([0], ends)))
            scores = bags @ weights + bias
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            loss = scores / scores.sum(axis=1, keepdims=True)
            loss[np.arange(len(rows)), target[rows]] -= 1
            to_bags = loss @ weights.T
            to_words = np.stack([np.bincount(index, weights=np.repeat(to_bags[:, d] / sizes, sizes), minlength=len(word)) for d in range(SIZE)], axis=1)
            touched, back = np.unique(bucket, return_inverse=True)
            per_bucket = to_words / np.maximum(counts, 1)[:, None]
            step = np.stack([np.bincount(back, weights=np.repeat(per_bucket[:, d], counts), minlength=len(touched)) for d in range(SIZE)], axis=1)
            table_sum[touched] += (step ** 2).mean(axis=1)
            table[touched] -= RATE * step / np.sqrt(table_sum[touched])[:, None]
            to_weights = bags.T @ loss / len(rows)
            weights_sum += (to_weights ** 2).mean()
            weights -= RATE / 5 * to_weights / np.sqrt(weights_sum)
            bias -= RATE / 5 * loss.mean(axis=0)
    return table @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0])


def logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last column of the features is the constant."""
    beta = np.zeros(features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        slope = features.T @ (weights * (p - labels)) + ridge * beta
        curve = (features * (weights * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fitted(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """The model of sampled texts; ``share`` is the share of toxic labels outside the sample."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, (0.0, 0.0, 0.0), share)
    left_out = np.arange(len(texts)) % 5 == 0
    if len(set(labels[left_out].tolist())) < 2:
        left_out[:] = True
    use = ~left_out if not left_out.all() else left_out
    margin, bias = trained([t for t, u in zip(texts, use, strict=True) if u], labels[use])
    best, count = evidence(margin, bias, pa.array([t for t, o in zip(texts, left_out, strict=True) if o], pa.string()))
    own = labels[left_out]
    real = np.isfinite(best)
    features = np.stack([best, np.log(np.maximum(count, 1)), np.ones(len(best))], axis=1)[real]
    toxic = own[real].mean()
    weights = np.where(own[real] == 1, share / max(toxic, 1e-9), (1 - share) / max(1 - toxic, 1e-9))
    return Model(margin, bias, tuple(logistic(features, own[real], weights)), share)


def learned(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: int = MOST_SAMPLED) -> Model:
    """The model of documents (doc_id, text) and labels (doc_id, toxic); ``usable`` says which labels may be used."""
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    if usable is not None:
        labels = labels.where(usable)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = labels.agg(F.avg("toxic")).first()[0]
    first = [labels.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id")).limit(most) for x in (0, 1)]
    sample = F.broadcast(first[0].unionAll(first[1]))  # at most 2 * most rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(sample, "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(2 * most).select("text", "toxic").collect()
    return fitted([r["text"] for r in rows], np.array([r["toxic"] for r in rows], dtype=np.int64), float(share or 0.0))


def scored(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, the named columns and the score of every row."""
    rows = docs.select("doc_id", *more, F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_id", *more]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                if any(model.fit):
                    best, count = evidence(model.margin, model.bias, texts_of(part))
                    a, b, c = model.fit
                    real = np.isfinite(best)
                    z = a * np.where(real, best, 0.0) + b * np.log(np.maximum(count, 1)) + c
                    score = np.where(real, 1 / (1 + np.exp(-np.clip(z, -700, 700))), 0.0)
                else:
                    score = np.full(part.num_rows, model.share)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + [pa.array(score)], names=[*kept, "score"])

    return in_arrow(rows, run, ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["score double"]))
