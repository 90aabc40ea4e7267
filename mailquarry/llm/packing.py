"""Packing of token ids into sequences by first-fit decreasing.

Every text is encoded and cut into pieces of at most ``CAPACITY`` ids. The pieces are dealt at random (by a hash
of their document and place) over groups of about ``GROUP_BYTES`` of text, and each group is packed on its
own: longest piece first, into the first sequence with room for it. A tournament tree over the room left
in the sequences finds that one in logarithmic time. A sequence that stays more than ``MOST_PADDING``
short of ``CAPACITY`` is cut into sequences whose lengths are powers of two, which need no padding.

A text has at most as many ids as bytes, and one for its end, so the size of a group is bounded by the
bytes dealt to it and not by the corpus. Pieces of one long text go to many groups.

Cases: a null text is an empty one and gives its end id alone. Repeated rows are packed each;
their pieces with the same place go to the same group. Rows without doc_id are packed like others. Extra
columns are not read. No rows give no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import documents_of, in_arrow, slices, texts_of
from mailquarry.llm.tokens import encoder

CAPACITY = 4096
GROUP_BYTES = 2 << 20
MOST_PADDING = 64
SLICE_BYTES = 6 << 20


class FirstFit:
    """Sequences with room left; a complete binary tree holds the most room of each half."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(most - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first sequence with room for ``size``, which is taken from it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        found = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece; equal sizes keep their order."""
    order = np.argsort(-sizes, kind="stable")
    tree, out = FirstFit(len(sizes), capacity), np.zeros(len(sizes), dtype=np.int64)
    for at in order:
        out[at] = tree.place(int(sizes[at]))
    return out


def packed(sizes: np.ndarray, capacity: int = CAPACITY, most_padding: int = MOST_PADDING) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) of all parts of the pieces, in order of sequence and offset."""
    bins = first_fit_decreasing(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    out, sequence, at = [], 0, 0
    while at < len(order):
        stop = at
        while stop < len(order) and bins[order[stop]] == bins[order[at]]:
            stop += 1
        pieces = order[at:stop]
        total = int(sizes[pieces].sum())
        rooms = [capacity] if capacity - total <= most_padding else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        room, offset = iter(rooms), 0
        left = next(room)
        for piece in pieces:
            start, size = 0, int(sizes[piece])
            while size:
                if not left:
                    sequence, offset, left = sequence + 1, 0, next(room)
                length = min(size, left)
                out.append((int(piece), start, length, sequence, offset))
                start, size, offset, left = start + length, size - length, offset + length, left - length
        sequence, at = sequence + 1, stop
    return out


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text_hash, start, doc_tokens, ids) of every piece; ids as little-endian unsigned 32-bit integers."""
    rows = documents_of(docs).withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                offsets, ids = encoder(tokenizer).encode(texts_of(part))
                sizes = np.diff(offsets)
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), counts)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                starts = nth * capacity
                ends = np.minimum(starts + capacity, sizes[row])
                data = ids.astype("<u4").tobytes()
                base = offsets[row]
                cut = [data[4 * a: 4 * b] for a, b in zip(base + starts, base + ends, strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(starts), pa.array(sizes[row]), pa.array(cut, pa.binary())],
                    names=["doc_id", "text_hash", "start", "doc_tokens", "ids"])

    kind = dict(rows.dtypes)["doc_id"]
    return in_arrow(rows, run, f"doc_id {kind}, text_hash long, start long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES, most_padding: int = MOST_PADDING) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the parts of all sequences.

    A sequence is its parts in order of offset; it is padded to ``capacity`` unless its length is a power of two.
    """
    size = documents_of(docs).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).first()["n"] or 0
    groups = max(1, -(-int(size) // group_bytes))
    pieces = pieces_of(docs, tokenizer, capacity).withColumn("group", F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.lit(groups)))
    kind = dict(pieces.dtypes)["doc_id"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("text_hash", "ascending"), ("start", "ascending")])
        ids = table.column("ids").to_pylist()
        parts = packed(np.array([len(x) // 4 for x in ids], dtype=np.int64), capacity, most_padding)
        piece, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True))
        take = pa.array(piece)
        return pa.table({
            "doc_id": table.column("doc_id").take(take), "start": table.column("start").to_numpy()[piece] + start, "length": length,
            "ids": pa.array([ids[p][4 * s: 4 * (s + n)] for p, s, n, _, _ in parts], pa.binary()),
            "doc_tokens": table.column("doc_tokens").take(take), "sequence_id": (key[0].as_py() << 32) + sequence, "offset": offset})

    return pieces.groupBy("group").applyInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(parts: DataFrame) -> DataFrame:
    """The parts with the crc32 of their ids instead of the ids."""
    return parts.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc32_of(ids: list[int]) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers, as :func:`digest` gives it."""
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
