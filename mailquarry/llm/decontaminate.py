"""Benchmark decontamination by spaced seeds.

Texts are lower-case tokens without punctuation. A seed is a fixed mask over consecutive tokens: the hash of a
window takes only the tokens where the mask has a 1, so windows still meet when tokens at the other positions
were replaced. The masks have weight 6 and together find, in 25 tokens of which each is replaced with probability
0.2, a common window in 99.8 % of cases. Benchmark texts shorter than the longest mask are found by all of
their tokens.

Windows of the documents are first held against a filter of fixed size of the benchmark's hashes; those
that may be among them are joined with the benchmark's windows exactly. A common window fixes how the two
texts lie on each other, and there the tokens are compared: the overlap is the whole benchmark text if at
least ``IDENTITY`` of its tokens are equal, else the stretch with the most equal tokens, each different one counting
against four equal ones. A document is contaminated by an overlap of at least ``LEAST_OVERLAP``
tokens or of a whole benchmark text, with identity of at least ``IDENTITY``.

Cases: null or empty texts and texts without a letter or digit have no tokens and match nothing, on both
sides. Benchmark rows with the same tokens are one item, named by the smallest item_id. Repeated documents are
answered as often as they occur. Without benchmark rows nothing is contaminated. Extra columns are not read;
the pipeline's filter keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from mailquarry.llm.common import apart, documents_of, hash_filter, in_arrow, list_offsets, mixed, perhaps_in, same_row, slices, texts_of
from mailquarry.sinks.facts import staged

MASKS = ("110100111", "11000101011", "101000011011", "101000100111")
LONGEST = max(map(len, MASKS))
IDENTITY, LEAST_OVERLAP = 0.8, 13
#: What a different token costs against one for an equal one, in the search for the best stretch.
COST = 4


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the tokens of the texts."""
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    plain = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), pattern=r"[^\p{L}\p{N}]+", replacement="").to_pylist()
    own = np.fromiter((xxh64_intdigest(x) for x in plain), dtype=np.uint64, count=len(plain))
    real = np.fromiter(map(bool, plain), dtype=bool, count=len(plain))
    index = coded.indices.to_numpy(zero_copy_only=False)
    kept = real[index]
    return np.concatenate(([0], np.cumsum(kept)))[list_offsets(lists)], own[index][kept]


def window_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the window of each token that has enough tokens after it."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, int(mask, 2) + (len(mask) << 32), dtype=np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ tokens[at: at + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mixed(out)


def windows(tokens: np.ndarray, offsets: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first token in it, hash) of the windows inside each text, by mask."""
    for mask in masks:
        hashes = window_hashes(tokens, mask)
        text = np.searchsorted(offsets, np.arange(len(hashes)), side="right") - 1
        inside = np.flatnonzero(np.arange(len(hashes)) + len(mask) <= offsets[text + 1])
        yield text[inside], inside - offsets[text[inside]], hashes[inside]


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, tokens) of the distinct token sequences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, tokens = token_hashes(texts_of(part))
                lists = [tokens[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id"), pa.array([x.astype(np.int64) for x in lists], pa.list_(pa.int64()))], names=["item_id", "tokens"])

    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    rows = in_arrow(rows, run, f"item_id {dict(rows.dtypes)['item_id']}, tokens array<long>").where(F.size("tokens") > 0)
    return rows.groupBy(F.xxhash64("tokens").alias("item"), "tokens").agg(F.min("item_id").alias("item_id"))


def item_windows(items: DataFrame) -> DataFrame:
    """(hash, item, at, size) of the windows of all items; short items have one, of all their tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, tokens in zip(batch.column("item").to_pylist(), batch.column("tokens"), strict=True):
                own = tokens.values.to_numpy().astype(np.uint64)
                for mask in MASKS if len(own) >= LONGEST else ("1" * len(own),):
                    rows += [(h, item, at, len(own)) for at, h in enumerate(window_hashes(own, mask).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, names=["hash", "item", "at", "size"])

    return in_arrow(items.select("item", "tokens"), run, "hash long, item long, at long, size long").distinct()


def _hits(docs: DataFrame, masks: tuple[str, ...], filled: DataFrame, bits: int) -> DataFrame:
    """(doc_id, text_hash, hash, at) of document windows that may be among the benchmark's."""
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for row in filled.toLocalIterator():  # at most 2**bits / 64 rows
        words[row["_word"]] = np.uint64(row["_bits"] & 0xFFFFFFFFFFFFFFFF)
    sent = docs.sparkSession.sparkContext.broadcast(words)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, tokens = token_hashes(texts_of(part))
                found = []
                for text, at, hashes in windows(tokens, offsets, masks):
                    slot = hashes & np.uint64((1 << bits) - 1)
                    hit = np.flatnonzero(bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                    found.append((text[hit], at[hit], hashes[hit].astype(np.int64)))
                text, at, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(hashes), pa.array(at)], names=["doc_id", "text_hash", "hash", "at"])

    return in_arrow(docs, run, f"doc_id {kind}, text_hash long, hash long, at long")


def _stretches(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item, first, skipped, stretch): the document's tokens where each item would lie, which begin at
    token ``first`` of the document and leave out ``skipped`` tokens of the item before its start."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, tokens = token_hashes(texts_of(part))
                tokens, out = tokens.astype(np.int64), []
                for row, lays in enumerate(part.column("lays").to_pylist()):
                    for lay in lays:
                        first, skipped = max(lay["shift"], 0), max(-lay["shift"], 0)
                        end = min(offsets[row] + first + lay["size"] - skipped, offsets[row + 1])
                        out.append((row, lay["item"], first, skipped, tokens[offsets[row] + first: end]))
                        if len(out) == 10_000:
                            yield _batch(part, out)
                            out = []
                if out:
                    yield _batch(part, out)

    def _batch(part: pa.RecordBatch, out: list) -> pa.RecordBatch:
        row, item, first, skipped, stretch = zip(*out, strict=True)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(item, pa.int64()), pa.array(first, pa.int64()), pa.array(skipped, pa.int64()), pa.array(stretch, pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "item", "first", "skipped", "stretch"])

    return in_arrow(rows, run, f"doc_id {kind}, text_hash long, item long, first long, skipped long, stretch array<long>")


def overlap(stretch: np.ndarray, tokens: np.ndarray, skipped: int) -> tuple[int, int, int]:
    """(start in the stretch, tokens, equal tokens) of the overlap of an item with the tokens where it lies."""
    equal = tokens[skipped: skipped + len(stretch)] == stretch
    if equal.sum() >= IDENTITY * len(tokens):
        return 0, len(tokens), int(equal.sum())
    gain = np.concatenate(([0], np.cumsum(np.where(equal, 1, -COST))))
    rise = gain - np.minimum.accumulate(gain)
    end = int(np.argmax(rise))
    start = int(np.flatnonzero(gain[: end + 1] == gain[: end + 1].min())[-1])
    return start, end - start, int(equal[start:end].sum())


def _verified(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, start, overlap, equal) of the overlaps that contaminate."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, take = [], []
            for row, (first, skipped) in enumerate(zip(batch.column("first").to_pylist(), batch.column("skipped").to_pylist(), strict=True)):
                tokens = batch.column("tokens")[row].values.to_numpy()
                start, size, equal = overlap(batch.column("stretch")[row].values.to_numpy(), tokens, skipped)
                if size and size >= min(len(tokens), LEAST_OVERLAP) and equal >= IDENTITY * size:
                    take.append(row)
                    found.append((first + start, size, equal))
            place = pa.array(take, pa.int64())
            numbers = zip(*found, strict=True) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(place) for c in ("doc_id", "text_hash", "item_id")] + [pa.array(x, pa.int64()) for x in numbers],
                names=["doc_id", "text_hash", "item_id", "start", "overlap", "equal"])

    return in_arrow(rows, run, f"doc_id {kinds['doc_id']}, text_hash long, item_id {kinds['item_id']}, start long, overlap long, equal long")


def overlaps(docs: DataFrame, benchmark: DataFrame, filter_bits: int = 24) -> DataFrame:
    """(doc_id, text_hash, item_id, start, overlap, equal): contaminating overlaps, a row for each way an item lies in a document."""
    docs = documents_of(docs).withColumn("text_hash", F.xxhash64("text"))
    items = staged(items_of(benchmark), "llm-items")
    known = staged(item_windows(items), "llm-item-windows")
    lengths = [r["size"] for r in known.where(F.col("size") < LONGEST).select("size").distinct().collect()]  # below 12 values
    masks = MASKS + tuple("1" * n for n in sorted(lengths))
    filled = hash_filter(known, F.col("hash"), filter_bits)
    hits = staged(_hits(docs, masks, filled, filter_bits), "llm-hits")
    lays = hits.join(known.withColumnRenamed("at", "item_at"), "hash").select(
        "doc_id", "text_hash", "item", "size", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    # of one document: at most a few for each of its tokens
    lays = staged(lays.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "size", "shift")).alias("lays")), "llm-lays")
    held = perhaps_in(docs, F.xxhash64("doc_id", "text_hash"), hash_filter(lays, F.xxhash64("doc_id", "text_hash")))
    held = held.dropDuplicates(["doc_id", "text_hash"])
    lays = lays.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "lays")
    held = held.join(lays, same_row(F.col("doc_id"), F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text_hash", "text", "lays")
    # written, so that no task runs two Python workers at once
    return _verified(staged(_stretches(held), "llm-stretches").join(items, "item"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, contaminated, n_items, item_id, overlap) of every row; item_id has the largest overlap, and
    is the smallest such."""
    best = F.struct((-F.col("overlap")).alias("less"), "item_id")
    found = overlaps(docs, benchmark).groupBy("doc_id", "text_hash", "item_id").agg(F.max("overlap").alias("overlap"))
    found = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), F.min(best).alias("best"))
    found = staged(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_items", F.col("best.item_id").alias("item_id"), (-F.col("best.less")).alias("overlap")), "llm-contaminated")
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    rows = rows.join(found, same_row(F.col("doc_id"), F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return rows.select("doc_id", "text_hash", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all columns."""
    found = staged(overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "llm-contaminated")
    docs, old = apart(docs, "doc_id", "text")
    rows = docs.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
    return rows.join(found, same_row(F.col("doc_id"), F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_anti").select(old)
