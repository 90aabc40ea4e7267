"""Near-duplicate documents by SimHash and Golay-code keys.

A fingerprint has 64 bits, each the majority of the XXH64 hashes of the text's word shingles. It is cut
into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two bits
have a segment without a difference whose next segment has at most one: a key is the one segment
as it is, and a codeword of the binary Golay code [23, 12] near the next one. A segment has one codeword
within distance 3 (the code is perfect) and, if that one is at distance 3, five more at distance 4;
two segments that differ in one bit share at least one of these. Fingerprints that share a key are
compared.

A key that more than ``MOST_IN_KEY`` distinct fingerprints share isn't compared pair by pair. Its
fingerprints go another exact way: each gives itself and its 64 neighbours at one bit as keys. All
that share such a key differ in at most two bits, and any two that differ in at most two bits share one, so
linking each to the smallest of its key finds the same components without pairs.

Cases: a null, empty or blank text has fingerprint 0, linked like any other. Copies have one fingerprint
and are one row from the keys on. A row without doc_id takes part; a component_id is the smallest
doc_id that isn't null, and null if there is none. Repeated rows are answered as often as they occur.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from mailquarry.llm.common import apart, documents_of, in_arrow, same_row, slices, texts_of, with_fields
from mailquarry.llm.components import components
from mailquarry.sinks.facts import staged

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Hashes whose bits are counted at once, 64 bytes each.
BLOCK, SLICE_BYTES = 1 << 17, 1 << 20
MOST_IN_KEY = 64
#: First bit and size of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code [23, 12, 7].
GENERATOR, LENGTH, CHECK_BITS = 0b110001110101, 23, 11


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of a text; fewer words than ``size`` are one shingle, no words none."""
    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    n = max(len(words) - size + 1, min(len(words), 1))
    shingles = zip(*(words[i:] for i in range(min(size, len(words)))), strict=False)
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), dtype=np.uint64, count=n)


def fingerprints(texts: list[str]) -> np.ndarray:
    """SimHash of each text, as unsigned 64-bit integers."""
    hashes = [shingle_hashes(text) for text in texts]
    sizes = np.array([len(x) for x in hashes], dtype=np.int64)
    every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    for start in range(0, len(every), BLOCK):
        mine = owner[start: start + BLOCK]
        first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        bits = np.unpackbits(every[start: start + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[mine[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprint(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """Every row with the fingerprint of its text as a (signed) long."""
    schema = with_fields(docs.schema, (column, T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                new = pa.array(fingerprints(texts_of(part).to_pylist()).astype(np.int64))
                yield pa.RecordBatch.from_arrays([new if n == column else part.column(n) for n in schema.names], names=schema.names)

    return in_arrow(docs, run, schema)


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator: 0 for codewords, one for each pattern of up to 3 errors."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ GENERATOR << (bit - CHECK_BITS), rest)
    return rest


def _error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns that lead to a codeword within distance 3, or with those within 4 where
    the nearest is at 3; and how many."""
    patterns, count = np.zeros((1 << CHECK_BITS, 6), dtype=np.int64), np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for weight in range(5):
        words = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)])
        for word, syndrome in zip(words, syndromes(words), strict=True):
            if weight < 4 or bin(patterns[syndrome, 0]).count("1") == 3:
                patterns[syndrome, count[syndrome]] = word
                count[syndrome] += 1
    return patterns, count


PATTERNS, PATTERN_COUNT = _error_patterns()


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints."""
    parts = [(prints >> np.uint64(start)).astype(np.int64) & (1 << size) - 1 for start, size in SEGMENTS]
    rows, keys = [], []
    for family in range(len(SEGMENTS)):
        near = parts[(family + 1) % len(SEGMENTS)]
        syndrome = syndromes(near)
        for k in range(PATTERNS.shape[1]):
            use = np.flatnonzero(PATTERN_COUNT[syndrome] > k)
            codeword = (near[use] ^ PATTERNS[syndrome[use], k]) >> CHECK_BITS
            rows.append(use)
            keys.append(family << 36 | parts[family][use] << 12 | codeword)
    return np.concatenate(rows), np.concatenate(keys)


def neighbour_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint itself and all that differ from it in one bit."""
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    return np.repeat(np.arange(len(prints)), 65), (prints[:, None] ^ flips).ravel().astype(np.int64)


def _keyed(prints: DataFrame, keys) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy()
            rows, key = keys(own.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[rows])], names=["key", "fp"])

    return in_arrow(prints.select("fp"), run, "key long, fp long")


def links(prints: DataFrame, most_in_key: int = MOST_IN_KEY) -> DataFrame:
    """(a, b): links between the distinct fingerprints (fp) that join the same components as all pairs
    with at most two differing bits; every row is such a pair."""
    keys = staged(_keyed(prints, golay_keys), "llm-golay")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(keys.join(shared, "key"), "llm-shared")
    few = shared.where(F.col("n") <= most_in_key)
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MOST_BITS)
    pairs = few.alias("x").join(few.alias("y"), near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    many = staged(_keyed(shared.where(F.col("n") > most_in_key).select("fp").distinct(), neighbour_keys), "llm-neighbours")
    least = staged(many.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a <> most").select("key", "a"), "llm-least")
    stars = many.join(least, "key").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionAll(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fingerprint, root, component_id) of every row; root is the same for all of a component."""
    rows = documents_of(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = with_fingerprint(rows).select("doc_id", "text_hash", "fingerprint")
    rows = staged(rows, "llm-fingerprints")
    prints = staged(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least_id")), "llm-prints")
    roots = components(links(prints))
    roots = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    roots = staged(roots, "llm-roots")
    least = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = staged(roots.select("fp", "root").join(least, "root").select(F.col("fp").alias("fingerprint"), "root", "component_id"), "llm-components")
    return rows.join(found, "fingerprint").select("doc_id", "text_hash", "fingerprint", "root", "component_id")


def hex_print(fingerprint: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component: that of the smallest doc_id (rows without one come last), and of
    rows with the same doc_id that of the smallest text hash. All columns are kept."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    least = near_duplicates(docs).groupBy("root", rank.alias("rank")).agg(F.count("*").alias("copies"))
    least = least.groupBy("root").agg(F.min(F.struct("rank", "copies")).alias("first"))
    return named_rows(docs, least.select(F.col("first.rank.doc_id").alias("_id"), F.col("first.rank.text_hash").alias("_hash"), F.col("first.copies").alias("_copies")))


def named_rows(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the ids and text hashes (_id, _hash, _copies) of ``named``, once each; all columns are kept."""
    least = staged(named, "llm-firsts")
    docs, old = apart(docs, "doc_id", "text")
    rows = docs.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(least.select("_id", "_hash"), same_row(F.col("doc_id"), F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    if least.where("_copies > 1").limit(1).count():  # the first one is a repeated row
        rows = rows.dropDuplicates(["doc_id", "_text_hash"])
    return rows.select(old)
