"""Exact search of term tables of any size in texts.

Every term is filed under its rarest gram: of its runs of 32 bytes the one that the fewest terms hold (of 16 or 8 in a shorter
term; one of less than 8 is a gram of its own). Texts are read once; a bit for each filed gram, in a table of bounded size,
keeps most of their grams at home. The others meet the index in an equi join, and a text is searched only for the terms whose gram
it holds. An index of up to ``MOST_SENT`` terms is sent to the tasks instead, and each text is searched where it is read: neither grams
nor texts are shuffled. Containment of UTF-8 bytes is containment of text. Grams of up to 8 bytes are the bytes as a number, longer
ones a hash of them; the search decides.

Cases: a null text is empty; the empty term is in every text, a null term in none. Texts may repeat.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.sinks.facts import staged

#: Lengths of grams; up to 8 bytes fit a number, the longer ones are put together from halves.
SHORT, SIZES = 8, (1, 2, 3, 4, 5, 6, 7, 8, 16, 32)
#: Bytes of text whose grams are held at once, however long a text is.
CHUNK = 1 << 20
#: The bit table has 16 places a term and at most 2**26 (8 MB); a fuller one lets more grams through to the join.
LEAST_BITS, MOST_BITS = 16, 26
#: Terms, or strings of rules, that are sent to every task.
MOST_SENT = 200_000


def body_key(text: Column) -> Column:
    """Equal for equal texts only."""
    return F.sha2(text, 256)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    values = column.cast(pa.large_binary())
    _, ends, data = values.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[values.offset: values.offset + len(values) + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return every[offsets[0]: offsets[-1]], offsets - offsets[0]


def _grams(data: np.ndarray, offsets: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, row, gram) of all grams of these sizes that lie inside a row, by chunk and size."""
    most = max(sizes, default=0)
    for start in range(0, len(data), CHUNK):
        count = min(CHUNK, len(data) - start)
        piece = data[start: start + count + most].astype(np.uint64)
        at = np.searchsorted(offsets, np.arange(start, start + count), side="right")
        room, row = offsets[at] - np.arange(start, start + count), at - 1
        gram = np.zeros(len(piece), dtype=np.uint64)
        for size in (x for x in SIZES if x <= most):
            if size <= SHORT:
                own = piece[size - 1:]
                gram[: len(own)] |= own << np.uint64(8 * (size - 1))
            else:
                half = size // 2
                gram[: max(len(gram) - half, 0)] = _spread(gram[: max(len(gram) - half, 0)], size) + gram[half:]
            if size in sizes:
                inside = np.flatnonzero(room >= size)
                yield size, row[inside], gram[inside]


def _spread(gram: np.ndarray, size: int) -> np.ndarray:
    """Mixed bits of a gram, for its place in the bit table and for longer grams."""
    out = (gram ^ np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def _term_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = batch.column("term")
        data, offsets = _flat(terms)
        length = np.diff(offsets)
        none = np.flatnonzero(length == 0)
        longest = np.array((0, *SIZES))[np.searchsorted(SIZES, length, side="right")]
        for size, row, gram in itertools.chain([(0, none, np.zeros(len(none), dtype=np.uint64))], _grams(data, offsets, set(SIZES))):
            own = np.flatnonzero(longest[row] == size)
            yield pa.RecordBatch.from_arrays(
                [terms.take(pa.array(row[own])), pa.array(np.full(len(own), size), pa.int32()), pa.array(gram[own].astype(np.int64)),
                 pa.array(_spread(gram[own], size).astype(np.int64))], names=["term", "size", "gram", "spread"])


def term_index(terms: DataFrame) -> DataFrame:
    """(term, size, gram, spread) of the distinct terms, each with its rarest gram."""
    distinct = terms.select("term").where("term IS NOT NULL").distinct()
    grams = staged(distinct.mapInArrow(_term_grams, "term string, size int, gram long, spread long"), "term-grams")
    common = grams.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("holders"))
    rarest = F.min(F.struct("holders", "size", "gram", "spread")).alias("g")
    return staged(grams.join(common, ["size", "gram"]).groupBy("term").agg(rarest).select("term", "g.size", "g.gram", "g.spread"), "term-index")


def _gram_hits(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(body, size, gram) of the grams of the texts that may be in the index."""
    bits = min(max(LEAST_BITS, (16 * max(index.count(), 1) - 1).bit_length()), MOST_BITS)
    slot = F.col("spread").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for r in index.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():  # at most 2**bits / 64 rows
        words[r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    sent = texts.sparkSession.sparkContext.broadcast(words)
    sizes = {r.size for r in index.select("size").distinct().collect()}  # at most len(SIZES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = sent.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            body = batch.column("body")
            if 0 in sizes:
                yield _hits(body, np.arange(len(body)), 0, np.zeros(len(body), dtype=np.uint64))
            for size, row, gram in _grams(*_flat(batch.column("text")), sizes - {0}):
                place = _spread(gram, size) & mask
                hit = np.flatnonzero(table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                order = hit[np.lexsort((gram[hit], row[hit]))]
                first = np.ones(len(order), dtype=bool)
                first[1:] = (np.diff(row[order]) != 0) | (gram[order][1:] != gram[order][:-1])
                yield _hits(body, row[order[first]], size, gram[order[first]])

    def _hits(body: pa.Array, row: np.ndarray, size: int, gram: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [body.take(pa.array(row)), pa.array(np.full(len(row), size), pa.int32()), pa.array(gram.astype(np.int64))], names=["body", "size", "gram"])

    return texts.select("body", "text").mapInArrow(run, "body string, size int, gram long").distinct()


class TermSearch:
    """An index of bounded size, searched in a task."""

    def __init__(self, index: pa.Table):
        """``index`` as of :func:`term_index`; a term's number is its row there."""
        self.terms = index.column("term").combine_chunks()
        self.bytes = [t.encode() for t in self.terms.to_pylist()]
        sizes, grams = index.column("size").to_numpy(), index.column("gram").to_numpy().astype(np.uint64)
        self.empty = np.flatnonzero(sizes == 0)
        length = np.array([len(t) for t in self.bytes], dtype=np.int64)
        self.mask = np.uint64((1 << min(max(LEAST_BITS, (16 * max(len(sizes), 1) - 1).bit_length()), MOST_BITS)) - 1)
        self.known, self.filed = np.zeros(int(self.mask) + 1, dtype=bool), {}
        for size in np.unique(sizes[sizes > 0]):
            own = np.flatnonzero(sizes == size)
            own = own[np.argsort(grams[own], kind="stable")]
            distinct, first = np.unique(grams[own], return_index=True)
            self.known[_spread(distinct, size) & self.mask] = True
            self.filed[int(size)] = distinct, np.append(first, len(own)), own
        # a gram of up to 8 bytes that is the whole term needs no further look
        self.whole = (length == sizes) & (length <= SHORT)

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of the terms each text contains, each once, by row."""
        data, offsets = _flat(texts)
        n_terms, found = len(self.bytes), []
        for size, row, gram in _grams(data, offsets, set(self.filed)):
            distinct, first, own = self.filed[size]
            hit = np.flatnonzero(self.known[_spread(gram, size) & self.mask])
            at = np.minimum(np.searchsorted(distinct, gram[hit]), len(distinct) - 1)
            same = distinct[at] == gram[hit]
            key = np.unique(row[hit[same]] * len(distinct) + at[same])
            row, at = key // len(distinct), key % len(distinct)
            count = first[at + 1] - first[at]
            place = np.repeat(first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
            found.append(np.repeat(row, count) * n_terms + own[place])
        found.append((np.arange(len(texts))[:, None] * n_terms + self.empty).ravel())
        key = np.unique(np.concatenate(found))
        row, term = key // max(n_terms, 1), key % max(n_terms, 1)
        sure, open_ = self.whole[term], np.flatnonzero(~self.whole[term])
        for r, start, stop in zip(*_ranges(row[open_])):
            text = data[offsets[r]: offsets[r + 1]].tobytes()
            sure[open_[start:stop]] = [self.bytes[t] in text for t in term[open_[start:stop]]]
        return row[sure], term[sure]


def _ranges(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, stop) of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
    return row[starts], starts, np.append(starts[1:], len(row))[: len(starts)]


def terms_in(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(body, term): the distinct terms each text contains, for ``texts`` with text and its :func:`body_key` as body.

    Repeated texts are one body. Bodies are shuffled only where the index is too large to be sent and has a gram of them.
    """
    index = term_index(terms)
    if index.count() <= MOST_SENT:
        sent = texts.sparkSession.sparkContext.broadcast(index.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = TermSearch(sent.value)
            for batch in batches:
                row, term = search.pairs(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("body").take(pa.array(row)), search.terms.take(pa.array(term))], names=["body", "term"])

        return staged(texts.select("body", "text").mapInArrow(run, "body string, term string").distinct(), "terms-found")
    near = _gram_hits(texts, index).join(index.drop("spread"), ["size", "gram"])
    near = staged(near.groupBy("body").agg(F.collect_set("term").alias("near")), "term-candidates")
    found = texts.select("body", "text").join(near, "body").select(
        "body", F.explode(F.filter("near", lambda t: F.contains(F.col("text"), t))).alias("term"))
    return staged(found.distinct(), "terms-found")


def rules_in(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """(body, rule): the rules that have a string of each of their groups in a text.

    ``strings`` has the distinct (rule, n, at, term) of rules of ``n`` groups, a string ``term`` in group ``at``; ``texts`` as for
    :func:`terms_in`. Up to ``MOST_SENT`` strings are sent to the tasks, and only matched rules leave them.
    """
    strings = staged(strings, "rule-strings")
    if strings.count() > MOST_SENT:
        return terms_in(texts, strings).join(strings, "term").groupBy("body", "rule", "n").agg(
            F.count_distinct("at").alias("met")).filter("met = n").select("body", "rule")
    context = texts.sparkSession.sparkContext
    sent = context.broadcast((term_index(strings).toArrow(), strings.filter("term IS NOT NULL").toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, rows = TermSearch(sent.value[0]), sent.value[1]
        number = {t: i for i, t in enumerate(search.terms.to_pylist())}
        names = rows.column("rule").combine_chunks().dictionary_encode()
        rule, at = names.indices.to_numpy().astype(np.int64), rows.column("at").to_numpy().astype(np.int64)
        term = np.array([number[t] for t in rows.column("term").to_pylist()], dtype=np.int64)
        groups, needed = int(at.max(initial=0)) + 1, np.zeros(len(names.dictionary), dtype=np.int64)
        needed[rule] = rows.column("n").to_numpy()
        order = np.argsort(term, kind="stable")
        first, cell = np.searchsorted(term[order], np.arange(len(number) + 1)), (rule * groups + at)[order]
        for batch in batches:
            row, found = search.pairs(batch.column("text"))
            starts, stops = _ranges(row)[1:]
            bodies, matched = [], []
            for start, stop in zip(starts, stops):
                cells = np.unique(np.concatenate([cell[first[t]: first[t + 1]] for t in found[start:stop]]))
                some, met = np.unique(cells // groups, return_counts=True)
                hit = some[met == needed[some]]
                bodies.append(np.full(len(hit), row[start]))
                matched.append(hit)
            if bodies:
                yield pa.RecordBatch.from_arrays([
                    batch.column("body").take(pa.array(np.concatenate(bodies))), names.dictionary.take(pa.array(np.concatenate(matched)))], names=["body", "rule"])

    return texts.select("body", "text").mapInArrow(run, "body string, rule string").distinct()
